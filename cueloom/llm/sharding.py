"""Proportional stratified interleaving of rows into equal shards.

Rows of a stratum (source) are ranked in a seeded shuffle; rank r of n rows stands at the fraction
(r - 1 + u) / n, with one seeded offset u per stratum so that small strata do not meet at one point.
All rows are ordered by that fraction and the order is cut into shards whose counts differ by one at
most: every run of the order, and so every shard, has the mixture of the whole.

Ranks are made in blocks: draws are uniform, so a stratum of n rows is cut into about n / T even
blocks, counts of blocks give the ranks before them, and only one block is sorted by a task. The same
holds for the fractions. No stratum, however large, meets in one task.

Defined results: a null source is a stratum of its own; null text has 0 bytes and the checksum of the
empty text; null ids and repeated rows are placed one by one (equal rows are interchangeable); an
empty table gives no rows. Equal texts are not kept together: the law is `rows`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.common import hex_number, small_side, stored

SEED = "interleave-1"
#: Least rows of a block that one task sorts; blocks grow with the square root of the table.
BLOCK = 2_000


def _draw(*parts: Column) -> Column:
    """52 seeded bits as a long."""
    return hex_number(F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 13)


def _numbered(rows: DataFrame, keys: list[str], block: str, order: list[str], name: str) -> DataFrame:
    """rows plus name: the 0-based position by (block, order) within keys, without sorting more than a block."""
    counts = rows.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, block).orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(inner) - 1)
    return ranked.join(small_side(stored(base)), [*keys, block]).withColumn(name, F.col("_base") + F.col("_r")).drop("_r", "_base", block)


def interleave(docs: DataFrame, shards: int = 40, source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) and the carried columns, one row per row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    slim = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            crc.alias("text_crc32"),
            F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")).alias("_stratum"),
            _draw(F.col("doc_id"), crc).alias("_draw"),
            *[F.col(c).alias(f"_own_{c}") for c in carry],
        )
    )
    total = slim.count()
    block = max(BLOCK, math.isqrt(total))
    sizes = small_side(stored(slim.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_rows"))))
    span = float(1 << 52)
    rows = slim.join(sizes, "_stratum").withColumn("_part", F.floor(F.col("_draw") / F.lit(span) * F.ceil(F.col("_rows") / block)))
    ranked = _numbered(rows, ["_stratum"], "_part", ["_draw", "doc_id", "text_crc32"], "_rank")
    at = (F.col("_rank") + _draw(F.col("_stratum")) / F.lit(span)) / F.col("_rows")
    placed = stored(ranked.withColumn("_at", at).withColumn("_all", F.lit(0)).withColumn("_part", F.floor(F.col("_at") * max(1, math.ceil(total / block)))))
    ordered = _numbered(placed, ["_all"], "_part", ["_at", "_stratum", "_rank"], "_pos")
    shard = F.expr(f"(_pos * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(_shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return ordered.withColumn("_shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_pos") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_own_{c}").alias(c) for c in carry],
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, source: str = "source") -> None:
    """All rows with all columns as one folder per shard, in slot order."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    out = interleave(docs, shards, source, carry)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
