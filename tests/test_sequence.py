"""Block and bucket helpers equal their nested-loop definitions."""

import random

from pyspark.sql import functions as F

from cueloom.functions import sequence as S


def spans(seed, n=60):
    rng = random.Random(seed)
    out = []
    for m in (1, 2):
        for i in range(n):
            start = rng.randrange(0, 5000)
            out.append((m, i, start, start + rng.randrange(1, 400)))
    return out


def test_scan_and_neighbours_cross_block_edges(spark):
    rows = [(1, i, (i * 37) % 23) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, i bigint, v bigint")
    got = {r.i: r for r in S.scan(df, ["k"], "i", {"m": ("max", "v"), "s": ("sum", "v"), "l": ("last", F.when(F.col("v") % 2 == 0, F.col("v")))}, block=7).collect()}
    back = {r.i: r.l for r in S.scan(df, ["k"], "i", {"l": ("last", "v")}, reverse=True, block=7).collect()}
    near = {r.i: r for r in S.neighbours(df, ["k"], "i", lag={"a": "v"}, lead={"b": "v"}, offset=2, block=7).collect()}
    v = [x[2] for x in rows]
    for i in range(50):
        assert got[i].m == (max(v[:i]) if i else None)
        assert got[i].s == sum(v[:i])
        assert got[i].l == next((x for x in reversed(v[:i]) if x % 2 == 0), None)
        assert back[i] == (v[i + 1] if i < 49 else None)
        assert near[i].a == (v[i - 2] if i > 1 else None) and near[i].b == (v[i + 2] if i < 48 else None)


def test_interval_point_and_asof_joins(spark):
    a, b = spans(1), spans(2)
    left = spark.createDataFrame(a, "k int, i int, s bigint, e bigint")
    right = spark.createDataFrame(b, "k int, j int, rs bigint, re bigint")
    got = {(r.k, r.i, r.j) for r in S.interval_join(left, right, ["k"], ("s", "e"), ("rs", "re"), bucket_ms=100).collect()}
    assert got == {(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2])}
    pts = {(r.k, r.i, r.j) for r in S.point_join(left, right, ["k"], "s", ("rs", "re"), bucket_ms=100).collect()}
    assert pts == {(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] <= x[2] < y[3]}
    for way in ("backward", "forward"):
        rows = S.asof_join(left, right, ["k"], "s", "rs", ["rs"], "hit", direction=way, block=300).collect()
        for r in rows:
            near = [y[2] for y in b if y[0] == r.k and (y[2] <= r.s if way == "backward" else y[2] >= r.s)]
            want = (max(near) if way == "backward" else min(near)) if near else None
            assert (r.hit.rs if r.hit else None) == want


def test_rank_pick_is_nearest_rank(spark):
    v = [(x * 7919) % 101 for x in range(333)]
    df = spark.createDataFrame([(1, x) for x in v], "k int, v bigint")
    r = S.rank_pick(df, ["k"], "v", {"p": F.floor(F.col("n") * 95 / 100)}, block=5).first()
    assert r.p == sorted(v)[int(333 * 0.95)]
