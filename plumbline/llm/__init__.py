"""Operators for corpora that language models train on. Nothing outside this folder imports them."""
