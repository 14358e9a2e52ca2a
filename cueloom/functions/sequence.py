"""Ordered-sequence helpers that never put one whole track into one task.

Every helper splits a track into blocks of its order column, works inside
``(keys, block)`` and passes only a block summary across blocks. A track that
holds a third of all rows is therefore spread over as many tasks as it has
blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
BLOCK_MS = 3_600_000


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def once(value: Column) -> Column:
    """Evaluate a costly expression once: a generator stops projections from being merged."""
    return F.explode(F.array(value))


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    *,
    lag: Mapping[str, str | Column] | None = None,
    lead: Mapping[str, str | Column] | None = None,
    offset: int = 1,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Values of the row ``offset`` rows before and after; the order may have holes and start anywhere.

    Windows stay inside ``(keys, block)``; the edge rows of a block take the last row
    of the nearest earlier block, or the first row of the nearest later one, from a
    summary with one row per block. Wider offsets copy the edge rows of renumbered blocks.
    """
    if offset > 1:
        spread, w, own = with_halo(df, keys, idx, offset, block)
        far = {name: F.lag(_col(c), offset).over(w) for name, c in (lag or {}).items()}
        far |= {name: F.lead(_col(c), offset).over(w) for name, c in (lead or {}).items()}
        return spread.withColumns(far).where(own).drop("_blk", "_home", "_pos")
    outs = {**(lag or {}), **(lead or {})}
    cells = F.struct(*[_col(c).alias(name) for name, c in outs.items()])
    base = df.withColumn("_cells", cells).withColumn("_blk", F.floor(F.col(idx) / F.lit(block)))
    edges = base.groupBy(*keys, "_blk").agg(F.min_by("_cells", idx).alias("_head"), F.max_by("_cells", idx).alias("_tail"))
    outer = Window.partitionBy(*keys).orderBy("_blk")
    edges = edges.select(*keys, "_blk", F.lag("_tail").over(outer).alias("_before"), F.lead("_head").over(outer).alias("_after"))
    inner = Window.partitionBy(*keys, "_blk").orderBy(idx)
    near = base.withColumns({"_pc": F.lag("_cells").over(inner), "_nc": F.lead("_cells").over(inner)}).join(edges, [*keys, "_blk"])
    values = {name: F.coalesce("_pc", "_before")[name] for name in (lag or {})}
    values |= {name: F.coalesce("_nc", "_after")[name] for name in (lead or {})}
    return near.select(*[c for c in df.columns if c not in values], *[v.alias(name) for name, v in values.items()])


def with_halo(df: DataFrame, keys: Sequence[str], idx: str, reach: int, block: int = BLOCK_ROWS) -> tuple[DataFrame, Window, Column]:
    """Rows plus copies within ``reach`` rows of a block edge: (frame, window, keep-filter).

    Rows are numbered through first, so holes in the order do not shorten the reach.
    """
    placed = scan(df, keys, idx, {"_pos": ("count", F.lit(1))}, block=block)
    home = F.floor(F.col("_pos") / F.lit(block))
    place = F.pmod(F.col("_pos"), F.lit(block))
    copies = F.array_compact(F.array(home, F.when(place >= block - reach, home + 1), F.when(place < reach, home - 1)))
    spread = placed.withColumn("_home", home).withColumn("_blk", F.explode(copies))
    return spread, Window.partitionBy(*keys, "_blk").orderBy("_pos"), F.col("_blk") == F.col("_home")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outs: Mapping[str, tuple[str, str | Column]],
    *,
    ties: Sequence[str] = (),
    reverse: bool = False,
    inclusive: bool = False,
    block: int = BLOCK_ROWS,
    block_by: Column | None = None,
) -> DataFrame:
    """Prefix aggregates over an integer order; sparse orders are allowed.

    ``outs`` maps a new column to ``(op, column)`` with op one of ``max``,
    ``min``, ``sum``, ``last`` (nearest non-null value before the row) or
    ``count``. Exclusive by default; ``reverse`` scans from the end, so ``last``
    then means the nearest non-null value after the row. ``block_by`` replaces the
    block number by any expression that grows with ``(order, ties)``.
    """
    names = {f"_v{i}": (out, op, _col(c)) for i, (out, (op, c)) in enumerate(outs.items())}
    base = df.withColumns({v: c for v, (_, _, c) in names.items()})
    base = base.withColumn("_blk", F.floor(F.col(order) / F.lit(block)) if block_by is None else block_by)
    spot = F.struct(F.col(order), *[F.col(t) for t in ties])

    def summary(v: str, op: str) -> Column:
        if op == "last":
            pick = F.min_by if reverse else F.max_by
            return pick(F.col(v), F.when(F.col(v).isNotNull(), spot))
        return {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[op](v)

    def merge(v: str, op: str, w: Window) -> Column:
        if op == "last":
            return F.last(v, ignorenulls=True).over(w)
        # block counts are added up across blocks
        return {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}[op](v).over(w)

    def local(v: str, op: str, w: Window) -> Column:
        if op == "count":
            return F.count(v).over(w)
        return merge(v, op, w)

    def both(op: str, carried: Column, here: Column) -> Column:
        if op == "max":
            return F.greatest(carried, here)
        if op == "min":
            return F.least(carried, here)
        if op == "last":
            return F.coalesce(here, carried)
        return F.coalesce(carried, F.lit(0)) + F.coalesce(here, F.lit(0))

    def way(c: str) -> Column:
        return F.col(c).desc() if reverse else F.col(c).asc()

    outer = Window.partitionBy(*keys).orderBy(way("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*keys, "_blk").orderBy(*[way(c) for c in [order, *ties]])
    inner = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    sums = base.groupBy(*keys, "_blk").agg(*[summary(v, op).alias(v) for v, (_, op, _) in names.items()])
    carried = sums.select(*keys, "_blk", *[merge(v, op, outer).alias(f"{v}c") for v, (_, op, _) in names.items()])
    here = base.withColumns({f"{v}h": local(v, op, inner) for v, (_, op, _) in names.items()})
    joined = here.join(carried, [*keys, "_blk"], "left")
    done = joined.withColumns({out: both(op, F.col(f"{v}c"), F.col(f"{v}h")) for v, (out, op, _) in names.items()})
    return done.select(*df.columns, *outs)


def islands(df: DataFrame, keys: Sequence[str], idx: str, starts: str | Column, out: str = "island", block: int = BLOCK_ROWS) -> DataFrame:
    """Number runs: the count of ``starts`` flags up to and including the row."""
    flag = F.when(_col(starts), 1).otherwise(0).cast("bigint")
    return scan(df, keys, idx, {out: ("sum", flag)}, inclusive=True, block=block)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    bucket_ms: int = 60_000,
) -> DataFrame:
    """Pairs whose half-open spans overlap (``min(end) > max(start)``).

    Both sides are copied to the time buckets they touch and joined on
    ``(keys, bucket)``; a pair is kept in the first bucket both share, so no
    ``distinct`` is needed and a hot track is split by time.
    """

    def bucketed(df: DataFrame, span: tuple[str, str], first: str) -> DataFrame:
        lo = F.floor(F.col(span[0]) / F.lit(bucket_ms))
        hi = F.greatest(lo, F.floor(F.col(span[1]) / F.lit(bucket_ms)))
        return df.withColumn(first, lo).withColumn("_bucket", F.explode(F.sequence(lo, hi)))

    pairs = bucketed(left, left_span, "_lb").join(bucketed(right, right_span, "_rb"), [*keys, "_bucket"])
    overlap = F.least(left_span[1], right_span[1]) > F.greatest(left_span[0], right_span[0])
    return pairs.where((F.col("_bucket") == F.greatest("_lb", "_rb")) & overlap).drop("_lb", "_rb", "_bucket")


def point_join(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    at: str,
    span: tuple[str, str],
    *,
    bucket_ms: int = 60_000,
) -> DataFrame:
    """Points inside half-open spans ``[start, end)``; only spans are copied."""
    lo = F.floor(F.col(span[0]) / F.lit(bucket_ms))
    hi = F.greatest(lo, F.floor(F.col(span[1]) / F.lit(bucket_ms)))
    wide = spans.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    narrow = points.withColumn("_bucket", F.floor(F.col(at) / F.lit(bucket_ms)))
    inside = (F.col(at) >= F.col(span[0])) & (F.col(at) < F.col(span[1]))
    return narrow.join(wide, [*keys, "_bucket"]).where(inside).drop("_bucket")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    payload: Sequence[str],
    out: str,
    *,
    direction: str = "backward",
    block: int = BLOCK_MS,
) -> DataFrame:
    """Nearest right row at or before (``backward``) or at or after the left row.

    Both sides are stacked and scanned; ``out`` is a struct of ``payload`` or NULL.
    """
    forward = direction == "forward"
    tie = "_side"
    first_right, first_left = (1, 0) if forward else (0, 1)
    rows = left.select(*keys, F.col(left_at).alias("_at"), F.lit(first_left).alias(tie), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*payload).alias("p")).schema["p"].dataType).alias("_hit"))
    hits = right.select(*keys, F.col(right_at).alias("_at"), F.lit(first_right).alias(tie), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.struct(*payload).alias("_hit"))
    found = scan(rows.unionByName(hits), keys, "_at", {out: ("last", "_hit")}, ties=[tie], reverse=forward, block=block)
    return found.where(F.col("_row").isNotNull()).select("_row.*", out)


def rank_pick(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    position: Mapping[str, Column],
    *,
    block: int = 1024,
) -> DataFrame:
    """Order statistics by 0-based position, exact and without a global sort.

    ``position`` maps an output name to an expression over ``n`` (group size).
    Equal values are counted first, so a block holds distinct values only.
    ``value`` must be an integer column.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    ranked = scan(counts, keys, value, {"_before": ("sum", "_c")}, block=block)
    ranked = ranked.join(sizes, list(keys)) if keys else ranked.crossJoin(F.broadcast(sizes))
    picks = [
        F.max(F.when((p >= F.col("_before")) & (p < F.col("_before") + F.col("_c")), F.col(value))).alias(name)
        for name, p in position.items()
    ]
    return ranked.groupBy(*keys).agg(F.first("n").alias("n"), *picks)
