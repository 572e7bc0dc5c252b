"""Exact dedup by two passes over Bloom filters, in DataFrame operations only.

Pass one hashes each normalised text and marks, in two bit tables, the cells that two or more rows hit. Pass two
tests every row against both tables. A row that misses in either is unique and passes straight through; only the
others shuffle, are grouped by SHA-256 and joined back. The tables are bitmaps of 4 KB a row, broadcast; their bound
is filter_bits / 4 bytes together (64 MB by default). Beyond the rows that this serves, some 17 million, digests fall
into ranges of a hash, each written to a folder of its own without a shuffle and filtered by its own two tables; so
the share of rows that shuffle stays the same at any number of rows, and so does what is broadcast at once.

Defined cases: null text counts as empty. A null doc_id never wins over another; if a group has only null ids,
keep_id is null. Rows that share text and doc_id tie: each is marked kept, and `keep_first` returns the one whose
columns have the least SHA-256, so that reruns agree. Empty tables give empty results. Other columns of the input are
untouched and may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, packed, power_of_two

#: One run of these becomes one space.
SPACES = r"[\x20\x09-\x0D]+"
CELLS = 32768


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ").cast("binary"), 256)


def _cell(half: int, bits: int) -> Column:
    h = F.xxhash64("_sha")
    return (F.shiftrightunsigned(h, 32) if half else h).bitwiseAND(F.lit(bits - 1).cast("long"))


def hit_cells(rows: DataFrame, half: int, bits: int, least: int = 2) -> DataFrame:
    """(bucket, bitmap) of the cells that least rows or more hit; counts are folded before they shuffle."""
    cells = rows.select(_cell(half, bits).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return cells.groupBy(F.expr(f"cell div {CELLS}").alias(f"_bucket{half}")).agg(F.bitmap_construct_agg(F.col("cell") % CELLS).alias(f"_map{half}"))


def _bit(half: int, bits: int) -> Column:
    at = (_cell(half, bits) % CELLS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(f"_map{half}"), F.expr("1") + F.floor(at / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1, F.lit(False))


def filter_size(n: int, filter_bits: int = 1 << 28) -> int:
    return min(filter_bits, max(CELLS, power_of_two(16 * n)))


def marked(rows: DataFrame, maps: list[DataFrame], bits: int) -> DataFrame:
    """rows (with _sha) plus _maybe: whether both its cells are in the two tables (maps), of bits cells each."""
    out = rows
    for half in (0, 1):
        out = out.withColumn(f"_bucket{half}", F.floor(_cell(half, bits) / CELLS)).join(F.broadcast(maps[half]), f"_bucket{half}", "left")
    return out.withColumn("_maybe", _bit(0, bits) & _bit(1, bits)).drop("_bucket0", "_bucket1", "_map0", "_map1")


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", filter_bits: int = 1 << 28, carry: bool = False) -> DataFrame:
    """One row for each row of df: key, keep_id, group_size, kept, text_sha256; with carry also _row, all of df.

    Digests are taken once and kept in the shared folder; texts are read again only if the rows are to be carried.
    """
    scratch = Scratch(df.sparkSession)
    n = df.count()
    ranges = power_of_two(-(-16 * n // filter_bits))
    bits = filter_size(-(-n // ranges), filter_bits)
    more = ["_row"] * carry
    rows = packed(df).select(F.col(f"_row.{key}").alias("_id"), digest(F.col(f"_row.{text}")).alias("_sha"), *more)
    if ranges > 1:
        every = scratch.save(rows.withColumn("_range", F.pmod(F.xxhash64(F.lit(ranges), "_sha"), F.lit(ranges)).cast("int")), by="_range")
        split = [every.filter(F.col("_range") == r).drop("_range") for r in range(ranges)]
        return reduce(DataFrame.unionByName, [_dedup(scratch, part.select("_id", "_sha"), part, bits, key, more) for part in split])
    digests = scratch.save(rows.select("_id", "_sha"))
    return _dedup(scratch, digests, rows if carry else digests, bits, key, more)


def _dedup(scratch: Scratch, digests: DataFrame, rows: DataFrame, bits: int, key: str, more: list[str]) -> DataFrame:
    """exact_dedup of rows, whose digests are digests, by two tables of bits cells."""
    maps = [scratch.save(hit_cells(digests, half, bits)) for half in (0, 1)]
    groups = scratch.save(marked(digests, maps, bits).filter("_maybe").groupBy("_sha").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    known = marked(rows, maps, bits)
    alone = known.filter(~F.col("_maybe")).select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha", *more)
    # Both sides of this sort-merge join are plain exchanges, so adaptive execution can split a hot key.
    several = known.filter("_maybe").drop("_maybe").hint("merge").join(groups.hint("merge"), "_sha")
    several = several.select("_id", "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "_sha", *more)
    return alone.unionByName(several).select(F.col("_id").alias(key), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"), *more)


def keep_first(df: DataFrame, text: str = "text", key: str = "doc_id", filter_bits: int = 1 << 28) -> DataFrame:
    """The rows of df that stay, one for each text, with df's own columns."""
    kept = exact_dedup(df, text, key, filter_bits, carry=True).filter("kept")
    alone, several = kept.filter("group_size = 1"), kept.filter("group_size > 1")
    first = several.groupBy("text_sha256").agg(F.min_by("_row", F.sha2(F.to_json("_row"), 256)).alias("_row"))
    return alone.select("_row.*").unionByName(first.select("_row.*"))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
    WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM n
    WINDOW w AS (PARTITION BY text_sha256)"""
