"""LM scoring by subword lattice likelihood.

The pieces of an existing vocabulary, byte pieces included, span a lattice over each word: every way to cut it into
pieces is a path, weighted by the product of the pieces' unigram scores. A forward recursion in log space sums all
paths, so a word's score is its marginal probability, and a text's the product over its words and one end mark. No
other path leads across a word, however often it occurs. The scores of the existing pieces are learned here: starting
from the vocabulary's ranks, rounds of expectation and maximisation over the counts of all training words (forward and
backward recursions) give each piece's expected use; pieces and end mark together are one distribution.

Words are distinct within a chunk of documents, then counted by hash partition; lattices run once for each distinct
word of the corpus, in blocks of words of equal length. The plain base score comes from the same counts.

Defined cases: null text is empty and has the end mark alone. Rows with a null id count as training rows (the hash of
an empty text). Without training rows all counts are zero and pieces keep their starting scores. Repeated rows count
each time. Words of any length are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import gather, in_groups, in_pairs, ipc, pack, parts_for, tables, text_bytes, unipc, unpack
from plumbline.llm.common import Scratch, arrow_type, held_out

#: Words longer than this, in bytes, are scored one by one.
LONG = 48
LN10 = float(np.log(10))


class Pieces:
    """The pieces as bytes (a leading space for a word's start), and a table from prefix hash to piece."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        prefixes = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)})
        h = np.array([self._hash(p) for p in prefixes], np.uint64)
        if len(np.unique(h)) < len(h):
            raise ValueError("two prefixes share a hash")
        self.bits = max(10, int(len(h) * 4 - 1).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -2, np.int32)
        for key, at, p in zip(h.tolist(), self._slot(h).tolist(), prefixes, strict=True):
            while self.values[at] != -2:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, self.number.get(p, -1)

    def _hash(self, p: bytes) -> int:
        h = 0
        for c in p:
            h = (h * int(self.STEP) + c + 1) & (2**64 - 1)
            h ^= h >> 29
        return h

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers; -1 for a prefix that is no piece, -2 for none."""
        at = self._slot(h)
        out = np.where(self.keys[at] == h, self.values[at], -2)
        open_ = np.flatnonzero((self.keys[at] != h) & (self.values[at] != -2))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            hit, empty = self.keys[at] == h[open_], self.values[at] == -2
            out[open_[hit & ~empty]] = self.values[at[hit & ~empty]]
            open_, at = open_[~hit & ~empty], at[~hit & ~empty]
        return out

    def spans(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all pieces in words, a matrix of bytes; ordered by start."""
        n, m = words.shape
        columns, out = [words[:, i].astype(np.uint64) + np.uint64(1) for i in range(m)], []
        for i in range(m):
            rows, h = np.arange(n), np.zeros(n, np.uint64)
            for j in range(i, min(m, i + self.longest)):
                h = h * self.STEP + columns[j][rows]
                h ^= h >> np.uint64(29)
                piece = self.find(h)
                if (alive := piece > -2).sum() < len(rows):
                    rows, h, piece = rows[alive], h[alive], piece[alive]
                if not len(rows):
                    break
                if (some := piece >= 0).all():
                    out.append((i, j + 1, rows, piece))
                elif some.any():
                    out.append((i, j + 1, rows[some], piece[some]))
        return out


def _sum_log(n: int, terms: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log of the sum of exponentials of each row's terms; -inf without any."""
    top = np.full(n, -np.inf)
    for rows, x in terms:
        top[rows] = np.maximum(top[rows], x)
    base, total = np.where(np.isfinite(top), top, 0.0), np.zeros(n)
    for rows, x in terms:
        total[rows] += np.exp(x - base[rows])
    with np.errstate(divide="ignore"):
        return base + np.log(total)


def forward(words: np.ndarray, spans: list, score: np.ndarray) -> np.ndarray:
    """(length + 1, words): log of the summed weight of all paths up to each place."""
    n, m = words.shape
    out = np.full((m + 1, n), -np.inf)
    out[0] = 0.0
    ending: list[list] = [[] for _ in range(m + 1)]
    for s in spans:
        ending[s[1]].append(s)
    for j in range(1, m + 1):
        out[j] = _sum_log(n, [(rows, out[i][rows] + score[piece]) for i, _, rows, piece in ending[j]])
    return out


def expected(words: np.ndarray, spans: list, score: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """How often each piece is used in all words, each counted so often, over all paths."""
    n, m = words.shape
    ahead, back = forward(words, spans, score), np.full((m + 1, n), -np.inf)
    back[m] = 0.0
    starting: list[list] = [[] for _ in range(m + 1)]
    for s in spans:
        starting[s[0]].append(s)
    use = np.zeros(size)
    for i in range(m - 1, -1, -1):
        terms = [(rows, back[j][rows] + score[piece]) for _, j, rows, piece in starting[i]]
        back[i] = _sum_log(n, terms)
        for (rows, x), (_, _, _, piece) in zip(terms, starting[i], strict=True):
            use += np.bincount(piece, np.exp(ahead[i][rows] + x - ahead[m][rows]) * counts[rows], size)
    return use


def one_word(word: bytes, pieces: Pieces, score: np.ndarray) -> tuple[np.ndarray, list]:
    """forward() and spans for a single long word; (start, end, piece)."""
    m, spans = len(word), []
    out = np.full(m + 1, -np.inf)
    out[0] = 0.0
    for j in range(1, m + 1):
        here = [(i, p) for i in range(max(0, j - pieces.longest), j) if (p := pieces.number.get(word[i:j])) is not None]
        x = np.array([out[i] + score[p] for i, p in here])
        top = x.max()
        out[j] = top + np.log(np.exp(x - top).sum())
        spans += [(i, j, p) for i, p in here]
    return out, spans


def by_length(words: list[bytes], block: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(positions, matrix of bytes with a space in front) in blocks of words of one length; no matrix if LONG."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for m in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == m)
        if m > LONG:
            for i in at:
                yield np.array([i]), None
            continue
        for k in range(0, len(at), block):
            part = at[k : k + block]
            raw = np.frombuffer(b"".join([b" " + words[i] for i in part.tolist()]), np.uint8)
            yield part, raw.reshape(len(part), m + 1)


def log_probabilities(words: list[bytes], pieces: Pieces, score: np.ndarray) -> np.ndarray:
    """Marginal log probability of each word."""
    out = np.zeros(len(words))
    for at, matrix in by_length(words):
        if matrix is None:
            out[at] = one_word(b" " + words[at[0]], pieces, score)[0][-1]
        else:
            out[at] = forward(matrix, pieces.spans(matrix), score)[-1]
    return out


def expected_use(words: list[bytes], counts: np.ndarray, pieces: Pieces, score: np.ndarray) -> np.ndarray:
    """Expected use of each piece, summed over words by their counts."""
    use = np.zeros(len(pieces.pieces))
    for at, matrix in by_length(words):
        if matrix is not None:
            use += expected(matrix, pieces.spans(matrix), score, counts[at], len(use))
            continue
        word = b" " + words[at[0]]
        ahead, spans = one_word(word, pieces, score)
        back = np.full(len(word) + 1, -np.inf)
        back[-1] = 0.0
        for i, j, p in reversed(sorted(spans)):
            back[i] = np.logaddexp(back[i], back[j] + score[p])
            use[p] += counts[at[0]] * np.exp(ahead[i] + score[p] + back[j] - ahead[-1])
    return use


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The vocabulary's pieces that a word can hold, and starting weights by their order in it (1 / (rank + 10))."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        if raw and b" " not in raw[1:]:
            found.setdefault(raw, 1.0 / (10 + max(0.0, -model.get_score(i))))
    for c in range(256):
        found.setdefault(bytes([c]), 1e-6)
    return list(found), np.array(list(found.values()))


def score_texts(df: DataFrame, vocabulary_path: str, text: str = "text", key: str = "doc_id", rounds: int = 2, smooth: float = 0.1, chunk_bytes: int = 16 << 20, part_bytes: int = 24 << 20) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    source = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    kind, id_type = source.schema["_id"].dataType.simpleString(), arrow_type(source.schema["_id"].dataType)
    parts = parts_for(text_bytes(source, "_text"), int(spark.conf.get("spark.sql.shuffle.partitions")), part_bytes)
    held = source.select("_id", "_text", held_out(F.col("_id"), 7).alias("_held"))
    names = "chunk long, part int, words binary, counts binary, docs long, state binary"
    arrow = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("docs", pa.int64()), ("state", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def both():
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(2)], ["id", "held"]), b.column(1)], ["key", "text"])

        for chunk, keys, texts in gather(both(), chunk_bytes):
            number: dict[bytes, int] = {}
            per_doc = []
            for t in texts:
                ids = [number.setdefault(w, len(number)) for w in t.lower().split()]
                per_doc.append(np.unique(np.array(ids, np.int64), return_counts=True))
            words = list(number)
            home = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
            order = np.argsort(home, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            counts = np.zeros(len(words), np.int64)
            for k, (ids, n) in zip(keys, per_doc, strict=True):
                if not k["held"]:
                    counts[ids] += n
            docs, cuts = sum(not k["held"] for k in keys), np.searchsorted(home[order], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                mine = order[cuts[p] : cuts[p + 1]]
                if len(mine):
                    rows.append({"chunk": chunk, "part": p, "words": pack(b"\n".join([words[i] for i in mine.tolist()])), "counts": pack(counts[mine])})
            sizes, deltas, times = [], [], []
            for ids, n in per_doc:
                at = np.argsort(place[ids])
                sizes.append(len(ids))
                deltas.append(np.diff(place[ids][at], prepend=0).astype(np.int32))
                times.append(n[at].astype(np.int32))
            blob = pack(np.concatenate([np.array(sizes, np.int32), *deltas, *times])) if sizes else b""
            ids = pa.array([k["id"] for k in keys], id_type)
            rows.append({"chunk": chunk, "part": -1, "words": ipc(a=ids), "counts": pack(np.array([k["held"] for k in keys], np.uint8)), "docs": docs, "state": blob})
            yield from tables(rows, arrow)

    asked = scratch.save(held.mapInArrow(ask, names))
    requests, states = asked.filter("part >= 0").select("chunk", "part", "words", "counts"), asked.filter("part < 0").select("chunk", "words", "counts", "state")
    train_docs = asked.agg(F.sum("docs")).first()[0] or 0

    def count(rows: list[dict]) -> list[dict]:
        total: dict[bytes, int] = {}
        for r in rows:
            for w, c in zip(unpack(r["words"]).split(b"\n"), unpack(r["counts"], "i8").tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        counts = np.fromiter(total.values(), np.int64, len(total))
        return [{"part": rows[0]["part"], "words": pack(b"\n".join(total)), "counts": pack(counts), "n": int(counts.sum()), "known": int((counts > 0).sum())}]

    counted = scratch.save(in_groups(requests, "part", count, "part int, words binary, counts binary, n long, known long", pa.schema([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("known", pa.int64())])))
    n_words, distinct = (x or 0 for x in counted.agg(F.sum("n"), F.sum("known")).first())
    n_tokens, distinct = n_words + train_docs, distinct + (train_docs > 0)
    listed, weight = vocabulary(vocabulary_path)
    pieces = spark.sparkContext.broadcast(listed)  # the vocabulary's size
    score = np.log(weight / weight.sum() * 0.9)
    end = np.log(0.1)
    for _ in range(rounds if n_tokens else 0):
        shared = spark.sparkContext.broadcast(score)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table, use = None, np.zeros(len(pieces.value))
            for b in batches:
                for words, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    table = table or Pieces(pieces.value)
                    c = unpack(counts, "i8")
                    split = unpack(words).split(b"\n")
                    known = np.flatnonzero(c)
                    use += expected_use([split[i] for i in known.tolist()], c[known].astype(np.float64), table, shared.value)
            some = np.flatnonzero(use)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(use[some])], ["piece", "n"])

        use = np.zeros(len(listed))
        for r in counted.select("words", "counts").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # the vocabulary's size
            use[r["piece"]] = r["n"]
        total = use.sum() + smooth * len(use) + train_docs + smooth
        score, end = np.log((use + smooth) / total), float(np.log((train_docs + smooth) / total))
    shared = spark.sparkContext.broadcast(score)

    def answer(rows: list[dict], known: list[dict]) -> list[dict]:
        words, counts = unpack(known[0]["words"]).split(b"\n"), unpack(known[0]["counts"], "i8")
        logs, number = log_probabilities(words, Pieces(pieces.value), shared.value), {w: i for i, w in enumerate(words)}
        out = []
        for r in rows:
            at = np.array([number[w] for w in unpack(r["words"]).split(b"\n")], np.int64)
            out.append({"chunk": r["chunk"], "part": r["part"], "counts": pack(counts[at]), "logs": pack(logs[at])})
        return out

    replies = in_pairs(requests.select("chunk", "part", "words"), counted.select("part", "words", "counts"), "part", answer, "chunk long, part int, counts binary, logs binary", pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("logs", pa.binary())]))
    floor = float(np.log10(n_tokens + distinct + 1))

    def finish(state: list[dict], answers: list[dict]) -> list[dict]:
        out = []
        for s in state:
            ids, held = unipc(s["words"]).column(0).to_pylist(), unpack(s["counts"], "u1")
            blob, n = unpack(s["state"], "i4"), len(held)
            sizes = blob[:n].astype(np.int64)
            total = int(sizes.sum())
            deltas, times = blob[n : n + total].astype(np.int64), blob[n + total :].astype(np.int64)
            answers = sorted(answers, key=lambda r: r["part"])
            counts = np.concatenate([unpack(r["counts"], "i8") for r in answers]) if answers else np.empty(0, np.int64)
            logs = np.concatenate([unpack(r["logs"], "f8") for r in answers]) if answers else np.empty(0)
            bases = np.log10(counts + 1.0) - floor
            tail = np.log10(train_docs + 1.0) - floor
            last = 0
            for i, size in enumerate(sizes.tolist()):
                at, t = np.cumsum(deltas[last : last + size]), times[last : last + size]
                last += size
                out.append({
                    "_id": ids[i], "held_out": bool(held[i]), "n_tokens": int(t.sum()) + 1, "n_known": int(t[counts[at] > 0].sum()) + (train_docs > 0), "train_tokens": n_tokens,
                    "base_score": float((bases[at] * t).sum() + tail), "score": float(((logs[at] * t).sum() + end) / LN10),
                })
        return out

    fields = f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result = pa.schema([("_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return in_pairs(states, replies, "chunk", finish, fields, result).withColumnRenamed("_id", key)


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
