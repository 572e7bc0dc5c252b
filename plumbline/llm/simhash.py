"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its segments. The Manhattan distance of two such vectors never
exceeds the Hamming distance of their fingerprints, so a grid range-join under it finds every pair in reach, and the
exact distance decides. Two lattice points at Manhattan distance 2 at most have a lattice point at distance 1 at most
from both, so each fingerprint enters its own cell and the cells one step away, and pairs meet in a shared cell.
Distinct fingerprints only are joined; links are then closed into components.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case. Defined cases: null text counts as empty; a text
without words has fingerprint zero, linked like any other; fewer words than a shingle make one shingle. Copies and
repeated rows share a fingerprint and so a component. Rows with a null doc_id take part, but name no component unless
all of it are null.

Two bits hold what is nearly equal; texts with a similarity (Jaccard, of distinct shingles) of 0.8 differ in about ten,
at which counts of bits rule out next to nothing. Given a similarity, fingerprints beyond the grid's reach are paired
by bands of least shingle hashes instead, and their texts verified exactly (`similar`). Texts without words then meet
by their fingerprint alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, packed, slices
from plumbline.llm.components import components
from plumbline.llm.exact_dedup import filter_size, hit_cells, marked

SEED = 42
#: Two texts at a similarity of 0.8 share a band of 5 least hashes with probability 0.33, one of 20 bands with 0.9996.
BANDS, ROWS = 20, 5
#: Bits of a parity signature: bit i tells whether an odd number of distinct shingle hashes fall in cell i.
SIGN_BITS = 1024
#: With so many strays at most, a bucket's strays compare with all its rows at once.
FEW = 64


def shingle_hashes(text: bytes, words: int, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of one text, repeats included, in blocks; none if it has no words."""
    import xxhash

    tokens = text.lower().split()  # on bytes: only A-Z are lowered, and only the six white spaces split
    if not tokens:
        return
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, block):
        pairs = zip(starts[at : min(n, at + block)].tolist(), last[at : at + block].tolist(), strict=False)
        yield np.array([digest(line[i:j], SEED) for i, j in pairs], np.uint64)


def fingerprint_of(hashes: Iterator[np.ndarray]) -> int:
    n, votes = 0, np.zeros(64, np.int64)
    for h in hashes:
        n += len(h)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, words: int = 3, block: int = 1 << 16) -> int:
    """The fingerprint of one text; its shingles are hashed and summed in blocks, so memory follows the text."""
    return fingerprint_of(shingle_hashes(text, words, block))


def sketch_of(hashes: list[np.ndarray], block: int = 256) -> tuple[list[int], list[int], int, int]:
    """A key for each band (a hash of its ROWS least values of the shingle hashes times an odd factor each), the parity
    signature of the distinct hashes, their number, and a name of the set of them; no keys without hashes."""
    import xxhash

    distinct = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
    parity = np.bincount((distinct >> np.uint64(64 - SIGN_BITS.bit_length() + 1)).astype(np.int64), minlength=SIGN_BITS) % 2
    sign = np.packbits(parity.astype(bool), bitorder="little").view("<i8").tolist()
    name = xxhash.xxh64_intdigest(distinct.tobytes(), SEED) - (1 << 63)
    if not len(distinct):
        return [], sign, 0, name
    odd = np.random.default_rng(SEED).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(distinct), block):
        least = np.minimum(least, (distinct[at : at + block, None] * odd).min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist(), sign, len(distinct), name


def in_reach(a: str, b: str, similarity: float) -> Column:
    """Whether texts with signatures {a}_sign, {b}_sign of {a}_size, {b}_size hashes can have this similarity.

    Signatures differ in no more bits than the sets in members, and a similarity of s leaves (1 - s) / (1 + s) of both
    sizes to differ; so no pair that has the similarity is ruled out.
    """
    apart = sum((F.bit_count(F.col(f"{a}_sign")[i].bitwiseXOR(F.col(f"{b}_sign")[i])) for i in range(SIGN_BITS // 64)), F.lit(0))
    sizes = F.col(f"{a}_size") + F.col(f"{b}_size")
    return F.greatest(apart, F.abs(F.col(f"{a}_size") - F.col(f"{b}_size"))) <= sizes * F.lit((1 - similarity) / (1 + similarity) + 1e-9)


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, sketch: bool = False) -> DataFrame:
    """(key, fp long) for each row; with sketch also bands and sign array<long>, size and name long and
    the text."""
    kind = df.schema[key].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp, sketches = [], []
            for t in b.column(1).cast(pa.binary()):
                hashes = shingle_hashes(t.as_py() or b"", words)
                if sketch:
                    hashes = list(hashes)
                    sketches.append(sketch_of(hashes))
                fp.append(fingerprint_of(hashes))
            columns = {"_id": b.column(0), "fp": pa.array(fp, pa.int64())}
            if sketch:
                bands, sign, size, name = zip(*sketches) if sketches else ((), (), (), ())
                columns |= {"bands": pa.array(bands, pa.list_(pa.int64())), "sign": pa.array(sign, pa.list_(pa.int64())), "size": pa.array(size, pa.int64()), "name": pa.array(name, pa.int64()), "_text": b.column(1)}
            yield pa.RecordBatch.from_pydict(columns)

    fields = f"_id {kind.simpleString()}, fp long" + ", bands array<long>, sign array<long>, size long, name long, _text string" * sketch
    return df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(work, fields)


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v, similar) for pairs (u, v) of nodes; texts: (node, _text). Compares the sets of shingle hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingles(text: bytes | None) -> np.ndarray:
            return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text or b"", words)]))

        last, right = None, None
        for b in slices(batches, 64):
            out, v = [], b.column(1).to_pylist()
            for i, (x, y) in enumerate(zip(b.column(2).cast(pa.binary()), b.column(3).cast(pa.binary()), strict=True)):
                if v[i] != last:  # rows come sorted by v, so a common one is taken apart once
                    last, right = v[i], shingles(y.as_py())
                left = shingles(x.as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                out.append(both >= similarity * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], ["u", "v", "similar"])

    rows = pairs.hint("merge").join(texts.select(F.col("node").alias("u"), F.col("_text").alias("_a")).hint("merge"), "u")
    rows = rows.hint("merge").join(texts.select(F.col("node").alias("v"), F.col("_text").alias("_b")).hint("merge"), "v")
    return rows.select("u", "v", "_a", "_b").mapInArrow(work, "u long, v long, similar boolean")


def similar(scratch: Scratch, prints: DataFrame, near: DataFrame, words: int, similarity: float, few: int | None = None) -> DataFrame:
    """Links (u, v) that join the fingerprints of all texts that share a band and have this similarity or more.

    prints: rows of fingerprints() with sketch; near: links found otherwise. In each bucket of a band all compare with
    one row, which joins most of a group at one comparison a row. What is left open is a bucket whose rows are in more
    than one component: its strays, all rows outside its largest component, compare with every row of another
    component. Up to few strays that is linear in the rows. Beyond, the bucket is split by further bands, level by
    level, to join strays cheaply; once a level joins less than an eighth of them, the strays left compare with all rows
    after all. So no bucket leaves a pair of different components without a comparison, and only groups that stay
    apart although they share a band cost more than linear work. Comparisons go by signature first, inside the join;
    only pairs in reach are emitted, and verified on their texts.
    """
    few = FEW if few is None else few
    # A text's node in the graph is its fingerprint; where different texts share one, each has a node of its own,
    # linked with the fingerprint.
    sets = prints.groupBy("fp", "name").agg(F.min("bands").alias("bands"), F.min("sign").alias("sign"), F.min("size").alias("size"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("fp")) > 1
    sketch = scratch.save(sets.withColumn("shared", shared).withColumn("node", F.when(F.col("shared"), F.xxhash64("fp", "name")).otherwise(F.col("fp"))))
    near = near.unionByName(sketch.filter("shared").select(F.col("node").alias("u"), F.col("fp").alias("v")))
    every = scratch.save(sketch.filter(F.size("bands") > 0).select("node", "name", F.posexplode("bands").alias("band", "key")))
    # Saved, so that the joins below have plain exchanges on both sides and a bucket with many rows can be split.
    buckets = scratch.save(every.groupBy("key").agg(F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = scratch.save(every.hint("merge").join(buckets.hint("merge"), "key"))
    scratch.drop(every, buckets)
    # Only texts that some bucket pairs are shuffled.
    names = scratch.save(members.select("node", "name").distinct().withColumn("_sha", F.col("name").cast("string")))
    bits = filter_size(names.count())
    rows = marked(prints.select("name", "_text", F.col("name").cast("string").alias("_sha")), [scratch.save(hit_cells(names, half, bits, 1)) for half in (0, 1)], bits)
    texts = scratch.save(rows.filter("_maybe").groupBy("name").agg(F.min("_text").alias("_text")).hint("merge").join(names.select("node", "name").hint("merge"), "name").select("node", "_text"))
    signs = [sketch.select(F.col("node").alias(x), F.col("sign").alias(f"{x}_sign"), F.col("size").alias(f"{x}_size")) for x in "uv"]
    seen = None

    def decide(pairs: DataFrame) -> None:
        """Verifies the distinct pairs in reach that were not seen before."""
        nonlocal seen
        new = scratch.save(pairs if seen is None else pairs.hint("merge").join(seen.select("u", "v").hint("merge"), ["u", "v"], "left_anti"))
        if not new.isEmpty():
            found = scratch.save(verified(new, texts, words, similarity))
            seen = found if seen is None else seen.unionByName(found)

    def apart(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def signed(pairs: DataFrame) -> DataFrame:
        """The distinct pairs whose signatures are in reach."""
        pairs = scratch.save(apart(pairs))
        for x, sign in zip("uv", signs, strict=True):
            pairs = pairs.hint("merge").join(sign.hint("merge"), x)
        return pairs.filter(in_reach("u", "v", similarity)).select("u", "v")

    decide(signed(members.filter("node <> v").select(F.col("node").alias("u"), "v")))
    members, before = members.select("key", "band", "node"), None
    for level in range(1, BANDS + 1):
        linked = near if seen is None else near.unionByName(seen.filter("similar").select("u", "v"))
        labels = components(scratch, linked)
        known = scratch.save(members.hint("merge").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")))
        parts = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        left = scratch.save(parts.groupBy("key").agg(F.max(F.struct("c", "label"))["label"].alias("main"), (F.sum("c") - F.max("c")).alias("strays")).filter("strays > 0"))
        open_, strays = left.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("strays") > few, F.col("strays"))), F.lit(0))).first()
        if not open_:
            break
        known = scratch.save(known.hint("merge").join(left.hint("merge"), "key"))
        last = level == BANDS or before is not None and strays > before * 7 / 8
        closing = known if last else known.filter(F.col("strays") <= few)
        closing = scratch.save(closing.hint("merge").join(sketch.select("node", "sign", "size").hint("merge"), "node"))
        u, v = (closing.select("key", "label", "main", *[F.col(c).alias(f"{x}_{c}" if c != "node" else x) for c in ("node", "sign", "size", "label")]) for x in "uv")
        u = u.filter(F.col("u_label") != F.col("main")).select("key", "u", "u_label", "u_sign", "u_size")
        v = v.select(F.col("key").alias("v_key"), "v", "v_label", "v_sign", "v_size")
        decide(u.hint("merge").join(v.hint("merge"), (F.col("key") == F.col("v_key")) & (F.col("u_label") != F.col("v_label")) & in_reach("u", "v", similarity)).transform(apart))
        if last or not strays:
            break
        before = strays
        members = scratch.save(known.filter(F.col("strays") > few).select("key", "band", "node", "label"))
        # Sub-buckets: rows that also agree in as many further bands as there were levels.
        further = [f"bands[(band + {i}) % {BANDS}]" for i in range(1, level + 1)]
        parts = scratch.save(members.hint("merge").join(sketch.select("node", "bands").hint("merge"), "node").select("node", "label", F.xxhash64("key", *map(F.expr, further)).alias("part")))
        leaders = scratch.save(parts.groupBy("part").agg(F.min(F.struct(F.xxhash64("node", "part"), "node", "label")).alias("o")).select("part", F.col("o.node").alias("v"), F.col("o.label").alias("v_label")))
        decide(signed(parts.hint("merge").join(leaders.hint("merge"), "part").filter("label <> v_label").select(F.col("node").alias("u"), "v")))
        members = members.select("key", "band", "node")
    return near if seen is None else near.unionByName(seen.filter("similar").select("u", "v"))


def cells(fp: Column, segments: int) -> Column:
    """Array of struct(cell, step): the popcount cell itself (step 0), and each cell one step away inside the grid."""
    width = 64 // segments
    bits = width.bit_length()
    counts = [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))) for i in range(segments)]

    def held(i: int, count: Column) -> Column:
        return F.shiftleft(count.cast("long"), bits * i)

    own = reduce(Column.bitwiseOR, [held(i, c) for i, c in enumerate(counts)])

    def at(cell: Column, step: int) -> Column:
        return F.struct(cell.alias("cell"), F.lit(step).alias("step"))

    steps = [at(own, 0)]
    for i, c in enumerate(counts):
        rest = own.bitwiseXOR(held(i, c))
        steps += [F.when(c < width, at(rest.bitwiseOR(held(i, c + 1)), 2 * i + 1)), F.when(c > 0, at(rest.bitwiseOR(held(i, c - 1)), 2 * i + 2))]
    return F.array_compact(F.array(*steps))


def links(distinct: DataFrame, n: int, distance: int = 2) -> DataFrame:
    """(u, v) with u < v: every two different fingerprints (fp) at this Hamming distance (2 at most) or less.

    More rows get more segments: more cells each, but fewer rows that share one. Every choice finds the same links.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the grid's steps cover distances 0 to 2")
    segments = 8 if n < 4_000_000 else 16 if n < 400_000_000 else 32
    spread = distinct.select("fp", F.explode(cells(F.col("fp"), segments)).alias("c")).select("fp", "c.cell", "c.step")
    a, b = (spread.select("cell", F.col("fp").alias(x), F.col("step").alias(f"{x}_step")) for x in "uv")
    # Both took the same step: they were in one cell before, where step 0 compares them.
    met = (F.col("u") < F.col("v")) & ((F.col("u_step") != F.col("v_step")) | (F.col("u_step") == 0)) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
    return a.hint("merge").join(b.hint("merge"), "cell").filter(met).select("u", "v")


def near_dups(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, distance: int = 2, similarity: float | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(key, fp, component_id) for each row: the least key of all rows whose fingerprints are linked with its own; with
    a similarity, also of those whose texts have it."""
    scratch = scratch or Scratch(df.sparkSession)
    prints = scratch.save(fingerprints(df, text, key, words, similarity is not None))
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("_id").alias("first")))
    linked = links(distinct.select("fp"), distinct.count(), distance)
    if similarity is not None:
        linked = similar(scratch, prints, scratch.save(linked), words, similarity)
    labels = components(scratch, linked)
    joined = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    of = scratch.save(joined.join(least, "label").select("fp", "component_id"))
    scratch.drop(distinct)
    return prints.hint("merge").join(of.hint("merge"), "fp").select(F.col("_id").alias(key), "fp", "component_id")


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, distance: int = 2, similarity: float | None = 0.8) -> DataFrame:
    """The rows of df that stay, one of each component: that with its least key, nulls last, then the least digest of
    its text.

    A row is told from others by key and text (128 bits of SHA-256, null as empty), whatever other rows share its key.
    Rows that share both differ in nothing that decides, and any one of them stays.
    """
    scratch = Scratch(df.sparkSession)

    def name(key: Column, text: Column) -> Column:
        return F.struct(key.isNull().alias("none"), key.alias("key"), F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16).alias("sha"))

    named = df.select(F.col(text).alias("_text"), name(F.col(key), F.col(text)).alias("_id"))
    found = near_dups(named, "_text", "_id", words, distance, similarity, scratch)
    # Names whose rows all go, and names of several rows, of which one stays.
    rows_of = found.groupBy("_id").agg(F.first(F.col("_id") != F.col("component_id")).alias("_gone"), F.count(F.lit(1)).alias("_n"))
    unsure = scratch.save(rows_of.filter("_gone or _n > 1").select(F.col("_id").alias("_sha"), "_gone"))
    # Rows that a Bloom filter of those names rules out pass straight through; only the others shuffle with their text.
    bits = filter_size(unsure.count())
    maps = [scratch.save(hit_cells(unsure, half, bits, 1)) for half in (0, 1)]
    scratch.keep(unsure, *maps)  # fingerprints, sketches and texts of pairs aren't read again
    rows = marked(packed(df).withColumn("_sha", name(F.col(f"_row.{key}"), F.col(f"_row.{text}"))), maps, bits)
    once = rows.filter("_maybe").dropDuplicates(["_sha"])  # folds within tasks, so a row repeated often shuffles little
    stay = once.hint("merge").join(unsure.filter("_gone").select("_sha").hint("merge"), "_sha", "left_anti")
    return rows.filter("not _maybe").select("_row.*").unionByName(stay.select("_row.*"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_dups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
