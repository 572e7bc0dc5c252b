"""Language ID by hierarchical discrimination: family first, then one-versus-one linear SVMs within the family.

Features are the square roots of hashed counts of letter 1- to 3-grams (on UTF-8 bytes, other ASCII as space), over
whole texts, scaled to length one. Classifiers are linear support vector machines with squared hinge loss, fitted on
the driver from a bounded sample: `per_language` texts at most of each of `max_languages` languages at most, and
`sample` texts (16 KB of features each at most) in all, picked by a hash of the id. Everything else covers all rows.

Families of known codes are fixed; other codes, in order, form families of about the square root of their number, so
that at the bound of 1,000 languages some 16,000 classifiers of 4,097 numbers (260 MB) are fitted and broadcast, and
seven for four languages. More languages than the bound raise, as the sample could not hold them. A prediction's score is the product of the
logistic scores of the family and of the language in it. Defined cases: null text or text without a letter is `und`
with score 0. Without any labelled text to learn from every row is `und` with score 0. Rows with a null label, a null
text or a null id (which counts as empty text for the split) don't break anything; only the first two never train.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, slices

# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "pl", "cs", "sk", "hr", "sl"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "am", "mt"),
}
UND = "und"
BITS = 12
#: ASCII letters in lower case, any other ASCII as space; bytes of longer characters stay.
LETTERS = bytes((c | 32 if 65 <= c <= 90 else c) if 97 <= (c | 32) <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str, block: int = 1 << 20) -> np.ndarray:
    """2 ** BITS floats of length one (or all zero), summed in blocks so that a long text needs no more memory."""
    data = np.frombuffer(text.encode("utf-8", "replace").translate(LETTERS), np.uint8)
    out = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(data), block):
        b = data[at : at + block + 2].astype(np.uint32)
        n = min(block, len(data) - at)
        grams = [b]
        if len(b) > 1:
            grams.append((b[:-1] << 8 | b[1:]) + 0x1000000)
        if len(b) > 2:
            grams.append((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) + 0x2000000)
        for g in grams:
            out += np.bincount((g[:n] * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    root = np.sqrt(out).astype(np.float32)
    return root / max(float(np.linalg.norm(root)), 1e-9)


def fit_pair(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 120) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, by accelerated gradient steps. y: -1 or 1."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))).astype(np.float32)
    step = 1 / (1 + 2 * c * float(weight.max()) * 2)  # rows with their bias have length sqrt(2)
    w = ahead = np.zeros(x.shape[1] + 1, np.float32)
    for k in range(rounds):
        short = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1])) * weight * y
        then = ahead - step * (ahead - 2 * c * np.append(x.T @ short, short.sum()) / len(y))
        ahead, w = then + k / (k + 3) * (then - w), then
    return w


class Pairs:
    """One-versus-one classifiers over some classes: votes, ties to the larger sum of margins, then the first class."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(itertools.combinations(range(len(self.classes)), 2))
        self.w = np.array([self._fit(x, labels, *p) for p in self.pairs], np.float32).reshape(len(self.pairs), x.shape[1] + 1)

    def _fit(self, x: np.ndarray, labels: np.ndarray, i: int, j: int) -> np.ndarray:
        one, two = labels == self.classes[i], labels == self.classes[j]
        return fit_pair(x[one | two], np.where(one[one | two], 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class, and the logistic score of its smallest margin (1 if there is one class)."""
        margin = x @ self.w[:, :-1].T + self.w[:, -1]
        votes, sums = (np.zeros((len(x), len(self.classes))) for _ in range(2))
        least = np.full((len(x), len(self.classes)), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            for c, m in ((i, margin[:, k]), (j, -margin[:, k])):
                votes[:, c] += m >= 0 if c == i else m > 0
                sums[:, c] += m
                least[:, c] = np.minimum(least[:, c], m)
        best = np.argmax(votes + 1e-3 * np.tanh(sums), axis=1)
        return best, 1 / (1 + np.exp(-4 * np.clip(least[np.arange(len(x)), best], -50, 50)))


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        of = {code: name for name, codes in FAMILIES.items() for code in codes}
        rest = sorted({c for c in langs if c not in of})
        each = math.isqrt(len(rest)) or 1
        of |= {c: f"other {i // each}" for i, c in enumerate(rest)}
        langs_at, families = np.array(langs, object), np.array([of[c] for c in langs], object)
        self.top = Pairs(x, families)
        self.within = [Pairs(x[families == f], langs_at[families == f]) for f in self.top.classes]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, score = [UND] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for k in range(0, len(at), 256):
            part = at[k : k + 256]
            x = np.stack([features(texts[i]) for i in part])
            family, sure = self.top.predict(x)
            for f, pairs in enumerate(self.within):
                if (mine := np.flatnonzero(family == f)).size:
                    lang, then = pairs.predict(x[mine])
                    for m, c, s in zip(mine.tolist(), lang.tolist(), (sure[mine] * then).tolist(), strict=True):
                        out[part[m]], score[part[m]] = pairs.classes[c], float(s)
        return out, score


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", per_language: int = 500, max_languages: int = 1_000, sample: int = 10_000) -> Model | None:
    """A model of the labelled rows that are not held out, or None if there are none."""
    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).filter("_lang is not null and _text is not null").filter(~held_out(F.col("_id"), 4))
    counts = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return None
    per_language = max(2, min(per_language, sample // len(counts)))
    # Twice as many as wanted by a threshold on the hash, so that only those few are ranked.
    place = F.xxhash64(F.lit(4), F.col("_id"))
    share = F.coalesce(*[F.when(F.col("_lang") == r["_lang"], F.lit(min(1.0, 2 * per_language / r["n"]))) for r in counts])
    few = rows.filter(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30)).withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy(place, "_id", F.xxhash64("_text")))).filter(F.col("_n") <= per_language)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [features(t.as_py()).astype(np.float16).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], ["x", "lang"])

    got = few.select("_text", "_lang").mapInArrow(work, "x binary, lang string").collect()
    got = sorted((r["lang"], bytes(r["x"])) for r in got)
    return Model(np.stack([np.frombuffer(x, np.float16) for _, x in got]).astype(np.float32), [c for c, _ in got])


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred and score added (columns of those names are replaced); narrow."""
    names = [c for c in df.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most what the docstring says

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            pred, score = model.predict(texts) if model else ([UND] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(work, f"{schema}, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")
