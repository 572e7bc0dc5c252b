"""Best-fit packing of documents into sequences of a fixed number of tokens, large items matched first.

Documents are tokenised once into pieces; only those longer than a sequence are cut, the first piece taking the rest.
Packing needs only how many pieces there are of each length (at most `capacity` numbers): pieces above a third of the
capacity are matched greedily, largest with the largest that fits, so at most two share a bin; the others, from large
to small, go where the gap is tightest. The plan is a list of runs (length, ranks, sequences, offset), made on the
driver from those counts alone, and each piece finds its run by its rank within its length. Ranks come from windows
over (length, bucket), so no length gathers in one task however common it is.

Defined cases: null text counts as empty, and an empty text is the end token alone. Rows that share a key are packed
one by one. An empty table packs into nothing.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, partitions, slices


def tokenizer(ranks_path: str, full_path: str):
    """A function from text to ids, as `tokenizers` gives them for full_path without added special tokens.

    The rank file holds the same vocabulary, and is several times faster; texts that hold a special token's string
    go to the full tokenizer, which turns it into that token.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = []

    def encode(text: str) -> list[int]:
        if "<|" not in text:
            return fast.encode_ordinary(text)
        if not full:
            from tokenizers import Tokenizer

            full.append(Tokenizer.from_file(full_path))
        return full[0].encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: whole sequences, after a first piece with what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n else []


def pieces(df: DataFrame, ranks_path: str, full_path: str, text: str = "text", key: str = "doc_id", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32) for every piece of every document."""
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(ranks_path, full_path)
        for b in slices(batches):
            at, out = [], []
            for i, t in enumerate(b.column(1)):
                ids = np.array(encode(t.as_py() or "") + [end_id], "<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    at.append(i)
                    out.append((k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(work, f"_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: Sequence[int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, offset), and the number of sequences.

    counts[n] is the number of pieces of length n. A run's ranks go up to the next run of that length; its sequences
    are consecutive.
    """
    left, used, runs, bins = list(counts), [0] * (capacity + 1), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], first, offset))
        used[length] += n
        left[length] -= n

    for a in range(capacity, capacity // 3, -1):  # 3 a > capacity
        b = min(a, capacity - a)
        while left[a]:
            while 3 * b > capacity and left[b] - (a == b) <= 0:
                b -= 1
            if 3 * b > capacity:
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, n, bins, 0)
                put(b, n, bins, a)
                gap = capacity - a - b
            else:
                n, gap = left[a], capacity - a
                put(a, n, bins, 0)
            if gap:
                gaps.setdefault(gap, []).append((bins, n))
            bins += n

    def fill(s: int, gap: int, first: int, n: int) -> None:
        """As many of length s as fit in each of n bins, or what is left of them in one."""
        each = gap // s
        whole = min(n, left[s] // each)
        if not whole:
            whole, each = 1, left[s]
        for k in range(each):
            put(s, whole, first, capacity - gap + k * s)
        if whole < n:
            gaps.setdefault(gap, []).append((first + whole, n - whole))
        if rest := gap - each * s:
            gaps.setdefault(rest, []).append((first, whole))

    for s in range(capacity // 3, 0, -1):
        while left[s]:
            tight = min((g for g in gaps if g >= s and gaps[g]), default=0)
            if tight:
                first, n = gaps[tight].pop()
                if not gaps[tight]:
                    del gaps[tight]
                fill(s, tight, first, n)
            else:
                n = max(1, left[s] // (capacity // s))
                fill(s, capacity, bins, n)
                bins += n
    return sorted(runs), bins


def pack(df: DataFrame, ranks_path: str, full_path: str, text: str = "text", key: str = "doc_id", capacity: int = 2048, end_id: int = 0, per_bucket: int = 50_000) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    cuts = scratch.save(pieces(df, ranks_path, full_path, text, key, capacity, end_id).withColumn("_uid", F.monotonically_increasing_id()))
    buckets = partitions(spark, cuts.count(), per_bucket)
    cuts = cuts.withColumn("_bucket", F.pmod(F.xxhash64("_uid"), F.lit(buckets)).cast("int"))
    sizes = scratch.save(cuts.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")))
    counts = [0] * (capacity + 1)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    runs, _ = plan(counts, capacity)
    before = sizes.select("length", "_bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).alias("_before"))
    ranked = cuts.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_uid")).cast("long") - 1)
    ranked = ranked.hint("merge").join(before.hint("merge"), ["length", "_bucket"]).select("_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    lengths, ranks, sequences, offsets = (np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else [[]] * 4))
    shared = spark.sparkContext.broadcast((lengths * (1 << 44) + ranks, ranks, sequences, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ranks, sequences, offsets = shared.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(starts, length * (1 << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = df.schema[key].dataType.simpleString()
    out = ranked.mapInArrow(place, f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", key)


def packed_documents(df: DataFrame) -> DataFrame:
    """pack() with the production parameters: the public byte-level vocabulary and 2048 tokens."""
    import public_tokenizers

    return pack(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
