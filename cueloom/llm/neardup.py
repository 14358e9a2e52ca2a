"""Near-duplicates by MinHash bands, odd sketches and exact confirmation.

A document's set holds its distinct 2-word shingles as 64-bit hashes. Documents with equal sets form a
class (one representative); classes are nodes. Of 256 MinHash samples, 32 bands of 4 make candidate
buckets (a pair of similarity 0.8 shares none of them with a chance of 5e-8), and all samples folded
into a parity bitmap of 1,024 bits make an odd sketch: the popcount of the XOR of two sketches estimates
a similarity near 1 so well that a bound five standard deviations off 0.8 settles which candidates are
confirmed on their full sets.

No bucket is expanded into its pairs of rows. In each round a bucket elects one pivot, and only members that
are not yet in the pivot's component meet it; then components are joined anew and settled buckets
drop out. Components that are still apart but share a bucket are found by blocks of the bucket's nodes against
blocks, whose sizes, sketches and first common band tell which may be linked; what may be is compared in full, so
that no link between classes is lost: single nodes by sketch and set, others in blocks of nodes against blocks of
the larger component, of which only the links leave the task.

Defined results: null, empty and wordless texts have an empty set, no links and are kept; rows with
one doc_id are one document; rows with a null doc_id are measured, never linked and kept; a very long text
is cut into words as a whole, its set worked on in pieces; equal sizes and sketches fall to the lesser id; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import small_side, stored, unused

SHINGLE = 2
BANDS, ROWS = 32, 4
#: The bands use the first samples, the sketch all of them.
SAMPLES = 256
SKETCH_WORDS = 16
#: Similarity in percent.
THRESHOLD = 80
#: Differing sketch bits up to which a pair is confirmed: 93 are expected at 0.8, with a deviation of 11.2.
SKETCH_LIMIT = 149
PIVOT_ROUNDS = 2
#: Nodes of the smaller and of the larger side that are compared as one block.
BLOCK_A, BLOCK_B = 64, 256
#: Bytes of text and set elements that a task works on at once.
TEXT_BYTES = 2 << 20
CHUNK = 1 << 16

_U = np.uint64
_rng = np.random.default_rng(20_240_229)
_XOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of consecutive runs of texts."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES, "right")))
        run = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts[at:end].cast(pa.string()), "")))
        lists = pc.ascii_split_whitespace(run)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[coded.indices.to_numpy(zero_copy_only=False)]
        pairs = _mix(_mix(h[:-1]) * _U(0x9E3779B97F4A7C15) + h[1:])
        out = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if b - a >= SHINGLE:
                out.append(np.unique(pairs[a : b - 1]))
            else:
                out.append(_mix(h[a:b] + _U(1)) if len(run[i].as_py()) else h[:0])
        yield out
        at = end


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Set size, two set fingerprints, sketch words and band keys of non-empty sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    one = np.add.reduceat(_mix(flat + _U(0x51)), starts)
    two = np.add.reduceat(_mix(flat ^ _U(0xA5A5A5A5A5A5A5A5)), starts)
    low = (flat >> _U(32)).astype(np.uint32)
    mins = np.full((SAMPLES, n), np.iinfo(np.uint32).max, np.uint32)
    first = 0
    while first < n:  # runs of sets that stay in the processor's cache; a larger set is taken in pieces
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK, "left")))
        last = min(last, n)
        end = int(starts[last - 1] + sizes[last - 1])
        for a in range(int(starts[first]), end, CHUNK) if last == first + 1 else (int(starts[first]),):
            part = low[a : min(a + CHUNK, end)] if last == first + 1 else low[a:end]
            where = np.zeros(1, np.int64) if last == first + 1 else starts[first:last] - a
            for k in range(SAMPLES):
                m = np.minimum.reduceat((part ^ _XOR[k]) * _MUL[k], where)
                np.minimum(mins[k, first:last], m, out=mins[k, first:last])
        first = last
    keys = np.empty((BANDS, n), np.uint64)
    for b in range(BANDS):
        key = np.full(n, b + 1, np.uint64)
        for r in range(ROWS):
            key = _mix(key * _U(0x9E3779B97F4A7C15) + mins[b * ROWS + r])
        keys[b] = key
    sketch = np.zeros((n, SKETCH_WORDS), np.uint64)
    rows = np.arange(n)
    for k in range(SAMPLES):
        bit = _mix(mins[k].astype(np.uint64) + (_U(k + 1) << _U(33))) % _U(64 * SKETCH_WORDS)
        sketch[rows, (bit >> _U(6)).astype(np.int64)] ^= _U(1) << (bit & _U(63))
    return sizes, one.view(np.int64), two.view(np.int64), sketch.view(np.int64), np.ascontiguousarray(keys.T).view(np.int64)


_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
_SIGNED = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, " + ", ".join(f"{s} bigint" for s in _SKETCH) + ", bands array<bigint>"


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of docs: set size, fingerprints, sketch words and band keys (null where the set is empty)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column("text")):
                ids = batch.column("doc_id")[at : at + len(sets)].cast(pa.int64())
                at += len(sets)
                full = [s for s in sets if len(s)]
                sizes = np.array([len(s) for s in sets], np.int64)
                columns: list[pa.Array] = [ids, pa.array(sizes)]
                if full:
                    _, one, two, sketch, keys = _signatures(full)
                    place = pa.array(np.cumsum(sizes > 0) - 1, mask=sizes == 0)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                    columns += [pa.array(x).take(place) for x in (one, two, *[np.ascontiguousarray(c) for c in sketch.T])] + [lists.take(place)]
                else:
                    columns += [pa.nulls(len(sets), pa.int64())] * (2 + SKETCH_WORDS) + [pa.nulls(len(sets), pa.list_(pa.int64()))]
                yield pa.record_batch(columns, ["doc_id", "n_shingles", "f1", "f2", *_SKETCH, "bands"])
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(sign, _SIGNED)


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles): the whole set of each row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column("text")):
                ids = batch.column("doc_id")[at : at + len(sets)].cast(pa.int64())
                at += len(sets)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, np.int64)
                yield pa.record_batch([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "shingles"])
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id bigint, shingles array<bigint>")


def _close(a: str, b: str) -> Column:
    """Sizes and sketches allow the similarity."""
    bits = F.expr(" + ".join(f"bit_count({a}.{s} ^ {b}.{s})" for s in _SKETCH))
    ratio = (F.col(f"{a}.n_shingles") * 100 >= THRESHOLD * F.col(f"{b}.n_shingles")) & (F.col(f"{b}.n_shingles") * 100 >= THRESHOLD * F.col(f"{a}.n_shingles"))
    return ratio & (bits <= SKETCH_LIMIT)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable over links (a, b), by alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = mark(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small)
        now = mark(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the stored distinct ids; rows that share an id are one document, and one set speaks for all."""
    return stored(full_sets(docs.select("doc_id", "text").join(small_side(ids), "doc_id", "left_semi")).groupBy("doc_id").agg(F.max("shingles").alias("shingles")), "lz4")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of stored pairs (a, b), those whose full sets have the similarity."""
    ids = pairs.select(F.col("a").alias("doc_id")).distinct().unionByName(pairs.select(F.col("b").alias("doc_id")).distinct())
    sets = _sets_of(stored(ids.distinct()), docs)
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_x")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_y")), "b")
    shared = F.size(F.array_intersect("_x", "_y")).cast("long")
    counted = two.select("a", "b", shared.alias("_i"), (F.size("_x") + F.size("_y")).cast("long").alias("_n"))
    return counted.where(100 * F.col("_i") >= THRESHOLD * (F.col("_n") - F.col("_i"))).select("a", "b")


def _links_between(pairs: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """All links (a, b) between the nodes of stored component pairs (la, lb).

    The nodes of the smaller sides that meet a larger component are taken together, in blocks.
    """
    sizes = stored(known.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    sized = pairs.join(sizes.select(F.col("label").alias("la"), F.col("n").alias("na")), "la").join(sizes.select(F.col("label").alias("lb"), F.col("n").alias("nb")), "lb")
    singles = _confirmed(stored(sized.where("na = 1 AND nb = 1").select(F.col("la").alias("a"), F.col("lb").alias("b"))), docs)
    a_is_big = F.struct("na", "la") > F.struct("nb", "lb")
    sided = sized.where("na > 1 OR nb > 1").select(F.when(a_is_big, F.col("la")).otherwise(F.col("lb")).alias("big"), F.when(a_is_big, F.col("lb")).otherwise(F.col("la")).alias("label"))
    small = stored(sided.join(known, "label").select("big", "node").distinct())
    large = stored(small.select("big").distinct().join(known.select(F.col("label").alias("big"), "node"), "big"))
    sets = _sets_of(stored(small.select(F.col("node").alias("doc_id")).unionByName(large.select(F.col("node").alias("doc_id"))).distinct()), docs)

    def blocks(side: DataFrame, rows: int, name: str) -> DataFrame:
        counts = side.groupBy("big").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_k"))
        full = side.join(counts, "big").join(sets, F.col("node") == F.col("doc_id"))
        # hashed, so a block has about that many rows; its size does not depend on the component's
        placed = full.withColumn(f"{name}_block", F.pmod(F.xxhash64("node"), F.col("_k")))
        return stored(placed.groupBy("big", f"{name}_block").agg(F.collect_list("node").alias(f"{name}_ids"), F.collect_list("shingles").alias(f"{name}_sets")), "lz4")

    a, b = blocks(small, BLOCK_A, "a"), blocks(large, BLOCK_B, "b")
    # block numbers first: the blocks themselves then travel by (component, block)
    met = a.select("big", "a_block").join(b.select("big", "b_block"), "big")
    return singles.unionByName(met.join(a, ["big", "a_block"]).join(b, ["big", "b_block"]).select("a_ids", "a_sets", "b_ids", "b_sets").mapInArrow(_compare_blocks, "a bigint, b bigint"))


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            a_ids, b_ids = (batch.column(c)[row].values.to_numpy() for c in ("a_ids", "b_ids"))
            a_sets, b_sets = (batch.column(c)[row].values for c in ("a_sets", "b_sets"))
            flat = b_sets.flatten().to_numpy()
            sizes = np.diff(b_sets.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            out_a, out_b = [], []
            for k, own in enumerate(a_sets):
                one = np.sort(own.values.to_numpy())
                place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
                shared = np.add.reduceat((one[place] == flat).astype(np.int64), starts)
                near = b_ids[100 * shared >= THRESHOLD * (len(one) + sizes - shared)]
                out_a += [int(a_ids[k])] * len(near)
                out_b += near.tolist()
            yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    signed = stored(signatures(docs))
    sized = signed.where(F.col("f1").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(sized.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")))
    heads = sized.join(classes, ["f1", "f2"]).where(F.col("doc_id") == F.col("rep")).dropDuplicates(["doc_id"])
    heads = stored(heads.select(F.col("doc_id").alias("node"), "n_shingles", *_SKETCH, "bands"))
    sketches = heads.drop("bands")
    exploded = heads.select("node", F.explode("bands").alias("band"))
    # written first, so that both sides of the joins on a band are plain shuffles whose large partitions Spark splits
    shared = stored(exploded.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("band"))
    members = stored(exploded.join(shared, "band"))
    nodes = sketches.select("node", F.col("node").alias("label"))
    links = None
    apart = members.withColumn("label", F.col("node"))
    for number in range(PIVOT_ROUNDS):
        order = F.struct(F.xxhash64(F.lit(number), "node").alias("h"), "node", "label") if number else F.struct(F.col("node").alias("h"), "node", "label")
        pivots = stored(apart.groupBy("band").agg(F.min(order).alias("p")))
        met = apart.join(pivots, "band").where(F.col("label") != F.col("p.label"))
        stars = met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        found = _link(stars, sketches, docs)
        links = found if links is None else stored(links.unionByName(found))
        labels = components(links)
        nodes = labels
        named = members.join(labels, "node", "left").select("node", "band", F.coalesce("label", "node").alias("label"))
        open_bands = stored(named.groupBy("band").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("band"))
        apart = stored(named.join(open_bands, "band"))
    known = stored(sketches.select("node").join(nodes, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    more = _links_between(stored(_label_pairs(apart, heads)), known, docs)
    links = stored(links.unionByName(more))
    labels = components(links)
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("f1", "f2", F.coalesce("label", "rep").alias("_component"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    # a document of several rows takes the least component of them
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _label_pairs(apart: DataFrame, heads: DataFrame) -> DataFrame:
    """(la, lb): pairs of components that share a bucket and may have a link between their nodes in it.

    A bucket is split into blocks of nodes by hash, and blocks meet blocks in tasks of their own: a bucket is
    never one join key. Two nodes count in the first band that both have, if sizes and sketches allow a link;
    a task gives every pair of components once.
    """
    own = heads.select("node", F.struct("node", "n_shingles", F.array(*_SKETCH).alias("sketch"), "bands").alias("own"))
    counts = small_side(stored(apart.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_B).alias("blocks"))))
    placed = apart.join(counts, "band").join(own, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # dealt out by block: a partitioning by band alone would do for the grouping, with one task for a large bucket
    boxes = stored(placed.repartition("band", "block").groupBy("band", "blocks", "block").agg(F.collect_list(F.struct("label", "own")).alias("items")), "lz4")
    inner = boxes.where(F.size("items") > 1).select("band", "items", F.col("items").alias("others"))
    crowded = boxes.where("blocks > 1")
    turns = crowded.where(F.col("block") + 1 < F.col("blocks")).select("band", "block", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("other"))
    left, right = crowded.select("band", "block", "items"), crowded.select("band", F.col("block").alias("other"), F.col("items").alias("others"))
    outer = turns.join(left, ["band", "block"]).join(right, ["band", "other"]).select("band", "items", "others")
    return inner.unionByName(outer).mapInArrow(_close_labels, "la bigint, lb bigint").distinct()


def _close_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def side(items: pa.StructArray) -> tuple[np.ndarray, ...]:
        own, n = items.field("own"), len(items)
        flat = lambda c: own.field(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        return items.field("label").to_numpy(), own.field("n_shingles").to_numpy(), flat("sketch").view(np.uint64), flat("bands")

    for batch in batches:
        for row in range(batch.num_rows):
            label, size, sketch, bands = side(batch.column("items")[row].values)
            label2, size2, sketch2, bands2 = side(batch.column("others")[row].values)
            like = (size[:, None] * 100 >= THRESHOLD * size2[None, :]) & (size2[None, :] * 100 >= THRESHOLD * size[:, None]) & (label[:, None] != label2[None, :])
            i, j = np.nonzero(like)
            near = np.bitwise_count(sketch[i] ^ sketch2[j]).sum(axis=1, dtype=np.int64) <= SKETCH_LIMIT
            i, j = i[near], j[near]
            both = bands[i] == bands2[j]
            first = np.where(both, bands[i], np.iinfo(np.int64).max).min(axis=1) == batch.column("band")[row].as_py()
            pairs = np.unique(np.sort(np.stack([label[i[first]], label2[j[first]]], axis=1), axis=1), axis=0)
            yield pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["la", "lb"])


def _link(pairs: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links of candidate pairs (a, b)."""
    a, b = sketches.alias("p"), sketches.alias("q")
    close = pairs.join(a, F.col("a") == F.col("p.node")).join(b, F.col("b") == F.col("q.node")).where(_close("p", "q")).select("a", "b")
    return stored(_confirmed(stored(close), docs))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each group (the one of the least id); all columns kept."""
    (name,) = unused(docs, "_id")
    gone = stored(near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(small_side(gone), docs["doc_id"] == F.col(name), "left_anti")
