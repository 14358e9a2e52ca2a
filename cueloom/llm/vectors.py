"""Embedding near-duplicates by lattice hashing: E8 cells of random projections, neighbouring cells, exact cosine.

Each of TABLES tables projects a unit vector by a seeded Gaussian matrix to BLOCKS blocks of eight numbers and
decodes every block to the nearest point of the lattice E8 (the nearer of D8 and D8 + 1/2); the points name the
vector's home cell. A vector also probes the PROBES cells one minimal vector of the lattice away that lie nearest
to it. Two vectors meet where the home cell of one is the home or a probed cell of the other; what meets is
verified by its cosine in double precision.

Dense groups are not compared pair by pair. Cells of the first tables that hold many vectors give a pivot, the
mean of their vectors, and vectors within half the linking angle of a pivot form a core: by the triangle
inequality of angles every two of them are linked. A core is one entry of a cell, however many vectors it has,
and its own links are counted by its size. Cores that may touch another core or a single vector are compared
vector by vector in blocks of bounded size; of single vectors in a crowded cell, blocks meet blocks. A task
gives counts per vector and a spanning forest of the links it saw, never the links themselves. A pair that meets
in several cells is counted in the one of the least key.

Pairs at the threshold meet with a chance above 0.99 (the tests measure the recall against brute force), closer
pairs almost surely.

Defined results: a vector that is null, zero or holds null or non-finite components has no links, is its own
component and kept; vectors of different lengths have no links; rows that share a vec_id are one vector (the
greatest of them); a null vec_id links with nothing, has no component and is kept; equal vectors are linked; an
empty table gives no rows. Extra columns do not matter: only vec_id and the vector are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import small_side, stored
from cueloom.llm.neardup import components

COSINE = 0.95
TABLES, BLOCKS, PROBES = 8, 2, 4
#: Edge of the lattice in units of a projection's deviation over all unit vectors.
SCALE = 2.0
#: Tables whose cells give pivots, and vectors that such a cell holds at least.
PIVOT_TABLES, PIVOT_ROWS = 4, 8
#: Entries or vectors that are compared as one block.
BLOCK = 256
#: Pairs whose vectors are multiplied at once.
PAIRS = 1 << 15
SEED = 8
_U = np.uint64


def _minimal() -> np.ndarray:
    """The 240 vectors of E8 of length sqrt(2)."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if np.prod(v) > 0]
    return np.array(out)


MINIMAL = _minimal()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Integer points of even sum next to y: rounded, and where the sum is odd the worst coordinate the other way."""
    near = np.rint(y)
    rest = y - near
    rows = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(rest[rows]).argmax(axis=1)
    near[rows, worst] += np.where(rest[rows, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The lattice point next to each row of y."""
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1))[:, None], whole, half)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(8)
def _projection(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, size])
    columns = TABLES * BLOCKS * 8
    # entries of deviation 1: a projected unit vector has deviation 1 in every coordinate
    return rng.normal(size=(size, columns)) / SCALE, rng.uniform(0, 2, columns)


def cells(units: np.ndarray) -> np.ndarray:
    """Keys (n, TABLES, 1 + PROBES) of unit vectors: home cell first, then the probed ones."""
    n, size = units.shape
    matrix, shift = _projection(size)
    y = (units @ matrix + shift).reshape(n * TABLES * BLOCKS, 8)
    home = nearest_e8(y)
    gain = ((y - home) @ MINIMAL.T).reshape(n * TABLES, BLOCKS * len(MINIMAL))
    # the cells a minimal vector away by their distance: the greater the product, the nearer
    best = np.argpartition(-gain, PROBES - 1, axis=1)[:, :PROBES]
    block, vector = best // len(MINIMAL), best % len(MINIMAL)
    points = np.repeat(np.rint(2 * home).astype(np.int64).reshape(n * TABLES, 1, BLOCKS, 8), 1 + PROBES, axis=1)
    rows = np.arange(n * TABLES)[:, None]
    points[rows, 1 + np.arange(PROBES), block] += np.rint(2 * MINIMAL[vector]).astype(np.int64)
    flat = points.reshape(n, TABLES, 1 + PROBES, BLOCKS * 8).view(np.uint64)
    keys = np.broadcast_to((np.arange(TABLES, dtype=np.uint64) + _U(1)).reshape(1, TABLES, 1) + _U(size << 8), flat.shape[:3]).copy()
    for i in range(BLOCKS * 8):
        keys = _mix(keys * _U(0x9E3779B97F4A7C15) + flat[..., i])
    return keys.view(np.int64)


def _units(lists: pa.Array) -> np.ndarray:
    """Unit vectors of lists of one length."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of the lists that can have links, one length after the other."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        some = lists.take(pa.array(rows))
        values = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)
        good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
        if good.any():
            yield rows[good], _units(some.filter(pa.array(good)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, units in _by_length(batch.column("v")):
            for at in range(0, len(rows), 1024):
                keys = cells(units[at : at + 1024])
                own = batch.take(pa.array(rows[at : at + 1024]))
                n = len(keys)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k.shape[1]), pa.array(k.ravel())) for k in (np.ascontiguousarray(keys[:, :, 0]), np.ascontiguousarray(keys[:, :, 1:]).reshape(n, -1))]
                yield pa.record_batch([own.column("vec_id"), own.column("v"), *lists], ["vec_id", "v", "homes", "probes"])


def half_angle(cosine: float) -> float:
    return float(np.arccos(cosine) / 2 - 1e-6)


def cores(keyed: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Stored (vec_id, core) and (core, n, pivot, radius) of the cores; a core is named by its least vec_id."""
    placed = keyed.select("vec_id", F.explode(F.slice("homes", 1, PIVOT_TABLES)).alias("cell"))
    crowded = small_side(stored(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PIVOT_ROWS).select("cell")))
    rows = keyed.select("vec_id", "v", F.explode(F.slice("homes", 1, PIVOT_TABLES)).alias("cell")).join(crowded, "cell", "left_semi")
    longest = keyed.agg(F.max(F.size("v"))).first()[0] or 1
    mean = [F.avg(F.get("v", F.lit(i)).cast("double") / F.col("size")).alias(f"m{i}") for i in range(longest)]
    # scaled by the greatest component first, so that no length overflows
    top = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    scaled = rows.select("cell", F.transform("v", lambda x: x.cast("double") / top).alias("v"))
    sized = scaled.withColumn("size", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    means = sized.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *mean)
    pivots = small_side(stored(means.select("cell", "n", F.array_compact(F.array(*[f"m{i}" for i in range(longest)])).alias("pivot")).where(F.exists("pivot", lambda x: x != 0))), 20_000)
    limit = half_angle(cosine)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            angle = np.full(batch.num_rows, np.pi)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                some = batch.take(pa.array(at))
                dot = np.einsum("ij,ij->i", _units(some.column("v")), _units(some.column("pivot")))
                angle[at] = np.arccos(np.clip(dot, -1, 1))
            near = pa.array(angle <= limit)
            yield pa.record_batch([batch.column(c).filter(near) for c in ("vec_id", "cell", "n")] + [pa.array(angle).filter(near)], ["vec_id", "cell", "n", "angle"])

    near = rows.join(pivots, "cell").select("vec_id", "v", "cell", "n", "pivot").mapInArrow(measure, "vec_id bigint, cell bigint, n bigint, angle double")
    taken = stored(near.groupBy("vec_id").agg(F.max_by(F.struct("cell", "angle"), F.struct("n", "cell")).alias("t")).select("vec_id", "t.*"))
    groups = taken.groupBy("cell").agg(F.min("vec_id").alias("core"), F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).where("n > 1")
    named = stored(groups.join(pivots.select("cell", "pivot"), "cell"))
    return stored(taken.join(small_side(named.select("cell", "core")), "cell").select("vec_id", "core")), named.select("core", "n", "pivot", "radius")


_FOUND = "kind int, a bigint, b bigint, n bigint"
COUNT, LINK, TOUCH = 0, 1, 2


def _found(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
    n = np.zeros(len(a), np.int64) if n is None else n
    return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n)], ["kind", "a", "b", "n"])


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least member of the component of each of n items under links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _counted(ids: np.ndarray, i: np.ndarray, j: np.ndarray, names: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Counts per id and a spanning forest of the links (i, j); names: what the forest's ends are called."""
    if not len(i):
        return
    counts = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    some = np.flatnonzero(counts)
    yield _found(COUNT, ids[some], ids[some], counts[some])
    label = _forest(i, j, len(ids))
    ends = np.flatnonzero(label != np.arange(len(ids)))
    names = ids if names is None else names
    yield _found(LINK, names[ends], names[label[ends]])


def _first_meeting(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least key of the cells in which vectors i and j meet, one of them at home."""
    x, y = keys[i], keys[j]
    top = np.iinfo(np.int64).max
    out = np.full(len(i), top)
    for p in range(1 + PROBES):
        for q in range(1 + PROBES) if p == 0 else (0,):
            out = np.minimum(out, np.where(x[:, :, p] == y[:, :, q], x[:, :, p], top).min(axis=1))
    return out


class _Entries:
    """Entries of cells: what they stand for, whether at home, pivot and radius."""

    def __init__(self, items: pa.Array):
        flat = items.flatten()
        self.core, self.home, self.radius = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("core", "home", "radius"))
        self.units = _units(flat.field("v"))
        self.sizes = pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64)


def _met(a: _Entries, b: _Entries, i: np.ndarray, j: np.ndarray, cosine: np.ndarray, bucket: np.ndarray, limit: float) -> Iterator[pa.RecordBatch]:
    """What pairs (i of a, j of b) of one cell say; bucket: the cell of each pair."""
    reach = a.radius[i] + b.radius[j]
    single = reach == 0
    touch = ~single & (np.arccos(np.clip(cosine, -1, 1)) <= np.arccos(limit) + reach + 1e-6)
    if touch.any():
        pairs = np.unique(np.sort(np.stack([a.core[i[touch]], b.core[j[touch]]], axis=1), axis=1), axis=0)
        yield _found(TOUCH, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
    link = np.flatnonzero(single & (cosine >= limit))
    for at in range(0, len(link), PAIRS):
        some = link[at : at + PAIRS]
        x, y = np.unique(i[some], return_inverse=True), np.unique(j[some], return_inverse=True)
        keys = np.concatenate([cells(a.units[x[0]]), cells(b.units[y[0]])])
        ids = np.concatenate([a.core[x[0]], b.core[y[0]]])
        first = _first_meeting(keys, x[1], len(x[0]) + y[1]) == bucket[some]
        names, place = np.unique(ids, return_inverse=True)
        yield from _counted(names, place[x[1][first]], place[len(x[0]) + y[1][first]])


def _within(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, items, bucket in _same_length(batch, ("items",)):
                e = _Entries(items[0])
                ends = np.repeat(np.cumsum(e.sizes), e.sizes)
                here = np.arange(len(ends))
                later = ends - here - 1
                cell = np.repeat(bucket, e.sizes)
                cuts = np.append(np.searchsorted(np.cumsum(later), np.arange(0, later.sum(), PAIRS), "left"), len(here))
                for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                    own = here[begin:end]
                    i, j = np.repeat(own, later[own]), _ragged(own + 1, later[own])
                    keep = e.home[i] | e.home[j]
                    i, j = i[keep], j[keep]
                    yield from _met(e, e, i, j, np.einsum("ij,ij->i", e.units[i], e.units[j]), cell[i], limit)

    return run


def _same_length(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[int, int, list[pa.Array], np.ndarray]]:
    """Runs of rows whose entries' vectors have one length (cells hold one length; hashes may meet by chance)."""
    buckets = batch.column("bucket").to_numpy()
    first = [int(batch.column(names[0])[r].values.field("v").value_lengths()[0].as_py()) for r in range(batch.num_rows)]
    at = 0
    while at < batch.num_rows:
        end = at + 1
        while end < batch.num_rows and first[end] == first[at]:
            end += 1
        yield at, end, [batch.column(c)[at:end] for c in names], buckets[at:end]
        at = end


def _across(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = _Entries(batch.column("items")[row : row + 1]), _Entries(batch.column("others")[row : row + 1])
                cosine = a.units @ b.units.T
                reach = a.radius[:, None] + b.radius[None, :]
                far = np.minimum(np.arccos(limit) + reach + 2e-6, np.pi)
                i, j = np.nonzero((cosine >= np.cos(far)) & (a.home[:, None] | b.home[None, :]))
                yield from _met(a, b, i, j, cosine[i, j], np.full(len(i), batch.column("bucket")[row].as_py()), limit)

    return run


def _cell_links(keyed: DataFrame, named: DataFrame, groups: DataFrame, limit: float) -> DataFrame:
    """Stored findings of all cells: counts and links of single vectors, and pairs that may touch with a core."""
    who = F.coalesce("core", "vec_id").alias("core")
    with_core = keyed.join(named, "vec_id", "left")
    spots = F.concat(F.transform("homes", lambda k: F.struct(k.alias("bucket"), F.lit(True).alias("home"))), F.transform("probes", lambda k: F.struct(k.alias("bucket"), F.lit(False).alias("home"))))
    entries = stored(with_core.select(who, F.explode(spots).alias("s")).groupBy(F.col("s.bucket").alias("bucket"), "core").agg(F.bool_or("s.home").alias("home")))
    live = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("home").alias("_h")).where("_n > 1 AND _h").select("bucket", F.ceil(F.col("_n") / BLOCK).alias("blocks"))
    singles = keyed.join(named, "vec_id", "left_anti").select(F.col("vec_id").alias("core"), F.transform("v", lambda x: x.cast("double")).alias("v"), F.lit(0.0).alias("radius"))
    pivots = singles.unionByName(groups.select("core", F.col("pivot").alias("v"), F.greatest("radius", F.lit(1e-9)).alias("radius")))
    placed = entries.join(live, "bucket").join(pivots, "core").withColumn("block", F.pmod(F.xxhash64("core"), F.col("blocks")))
    boxes = stored(placed.repartition("bucket", "block").groupBy("bucket", "blocks", "block").agg(F.collect_list(F.struct("core", "home", "radius", "v")).alias("items")), "lz4")
    inner = boxes.where(F.size("items") > 1).select("bucket", "items").mapInArrow(_within(limit), _FOUND)
    crowded = boxes.where("blocks > 1")
    pairs = crowded.where(F.col("block") + 1 < F.col("blocks")).select("bucket", "block", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("other"))
    left = crowded.select("bucket", "block", "items")
    right = crowded.select("bucket", F.col("block").alias("other"), F.col("items").alias("others"))
    outer = pairs.join(left, ["bucket", "block"]).join(right, ["bucket", "other"]).select("bucket", "items", "others").mapInArrow(_across(limit), _FOUND)
    return stored(inner.unionByName(outer))


def _core_links(touching: DataFrame, keyed: DataFrame, named: DataFrame, groups: DataFrame, limit: float) -> DataFrame:
    """Counts and links between the vectors of touching entries (a, b); the smaller sides of a larger core go together."""
    count = lambda end: F.coalesce(f"n{end}", F.lit(1))
    sized = touching.join(groups.select(F.col("core").alias("a"), F.col("n").alias("na")), "a", "left").join(groups.select(F.col("core").alias("b"), F.col("n").alias("nb")), "b", "left")
    a_is_big = F.struct(count("a"), "a") > F.struct(count("b"), "b")
    sided = stored(sized.select(F.when(a_is_big, F.col("a")).otherwise(F.col("b")).alias("big"), F.when(a_is_big, F.col("b")).otherwise(F.col("a")).alias("core")))
    members = keyed.join(named, "vec_id", "left").select("vec_id", F.coalesce("core", "vec_id").alias("core"), "v")

    def boxes(side: DataFrame, name: str) -> DataFrame:
        # hashed, so a box has about BLOCK vectors whatever the size of the core
        counts = small_side(stored(side.groupBy("big").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_k"))))
        placed = side.join(counts, "big").withColumn(f"{name}_box", F.pmod(F.xxhash64("vec_id"), F.col("_k")))
        # dealt out by box: a partitioning by core alone would do for the grouping, with one task for a large core
        return stored(placed.repartition("big", f"{name}_box").groupBy("big", f"{name}_box").agg(F.collect_list(F.struct("vec_id", "core", "v")).alias(name)), "lz4")

    small = boxes(members.join(sided, "core").select("big", "vec_id", "core", "v"), "few")
    large = boxes(members.join(sided.select("big").distinct(), F.col("core") == F.col("big")).select("big", "vec_id", "core", "v"), "many")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                few, many = batch.column("few")[row].values, batch.column("many")[row].values
                i, j = np.nonzero(_units(few.field("v")) @ _units(many.field("v")).T >= limit)
                ids, names = (np.concatenate([few.field(c).to_numpy(), many.field(c).to_numpy()]) for c in ("vec_id", "core"))
                yield from _counted(ids, i, len(few) + j, names)

    met = small.select("big", "few_box").join(large.select("big", "many_box"), "big")
    return stored(met.join(small, ["big", "few_box"]).join(large, ["big", "many_box"]).select("few", "many").mapInArrow(compare, _FOUND))


def near_vectors(rows: DataFrame, vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    slim = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).alias("v"))
    one = slim.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).groupBy("vec_id").agg(F.max("v").alias("v"))
    kind = dict(slim.dtypes)["v"]
    keyed = stored(one.mapInArrow(_keyed, f"vec_id bigint, v {kind}, homes array<bigint>, probes array<bigint>"))
    named, groups = cores(keyed, cosine)
    found = _cell_links(keyed, named, groups, cosine)
    more = _core_links(stored(found.where(F.col("kind") == TOUCH).select("a", "b").distinct()), keyed, named, groups, cosine)
    both = found.unionByName(more)
    counts = both.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("_more"))
    labels = components(both.where(F.col("kind") == LINK).select("a", "b"))
    own = keyed.select("vec_id").join(named.join(groups.select("core", "n"), "core"), "vec_id", "left").join(counts, "vec_id", "left")
    links = own.select("vec_id", F.coalesce("core", "vec_id").alias("core"), (F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("_links"))
    done = links.join(labels.withColumnRenamed("node", "core"), "core", "left").select("vec_id", "_links", F.coalesce("label", "core").alias("_component"))
    out = slim.select("vec_id").join(done, "vec_id", "left").select("vec_id", F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
