import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import vectors

pytestmark = pytest.mark.usefixtures("spark")


def brute(rows, limit=0.95):
    """(n_links, component) by id over all pairs."""
    best = {}
    for i, v in rows:
        if i is not None and v is not None:
            best[i] = max(best.get(i, v), v, key=lambda x: [(y is not None, math.inf if y is not None and math.isnan(y) else y) for y in x])
    good = {i: np.array(v, float) for i, v in best.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    good = {i: v / np.abs(v).max() for i, v in good.items()}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    ids = sorted(good)
    near = {i: [j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= limit] for i in ids}
    label = {}
    for i in ids:
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += near[x]
    return {i: (len(near.get(i, [])), label.get(i, i)) for i, _ in rows if i is not None}


def around(rng, centre, angle):
    z = rng.normal(size=len(centre))
    z -= z @ centre * centre
    return math.cos(angle) * centre + math.sin(angle) * z / np.linalg.norm(z)


def unit(rng, n=64):
    x = rng.normal(size=n)
    return x / np.linalg.norm(x)


def result(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id bigint, embedding array<{kind}>, core string")
    return {r.vec_id: r for r in vectors.near_vectors(df).collect()}


def test_dense_core_wide_shell_and_chain_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    tight, shell = unit(rng), unit(rng)
    rows += [around(rng, tight, math.radians(rng.uniform(5, 8))) for _ in range(400)]
    rows += [around(rng, tight, math.radians(rng.uniform(10, 22))) for _ in range(40)]  # strays around the core
    rows += [around(rng, shell, math.radians(11.3)) for _ in range(320)]  # linked in pairs, too wide for a core
    at = unit(rng)
    for _ in range(12):  # a chain whose ends are not linked
        at = around(rng, at, math.acos(0.97))
        rows.append(at)
    rows += [unit(rng) for _ in range(300)]
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    want, got = brute(rows), result(spark, rows)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(600):
        x = unit(rng)
        rows += [(2 * k, x.tolist()), (2 * k + 1, around(rng, x, math.acos(0.9502)).tolist())]
    got = result(spark, rows, "double")
    assert sum(r.n_links for r in got.values()) >= 0.97 * len(rows)
    assert all(r.n_links <= n for (r, n) in ((got[i], brute(rows[i // 2 * 2 : i // 2 * 2 + 2])[i][0]) for i in range(0, 100)))


def test_odd_rows(spark):
    one = [1.0] + [0.0] * 63
    rows = [(1, one), (2, one), (2, one), (3, None), (4, [0.0] * 64), (5, [float("nan")] + one[1:]), (6, [None] + one[1:]), (7, []), (8, [1.0, 0.0]), (9, [2.0, 0.0]),
            (10, [float("inf")] + one[1:]), (None, one), (11, [-x for x in one]), (12, [1e30 * x for x in one])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, label int")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect())
    assert got == sorted([(-1, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True),
                          (8, 1, 8, True), (9, 1, 8, False), (10, 0, 10, True), (11, 0, 11, True), (12, 2, 1, False)])
    assert vectors.near_vectors(df.where("false")).count() == 0
    assert vectors.near_vectors(df.where(F.col("embedding").isNull())).count() == 1


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(200, 8)) * 2
    near = vectors.nearest_e8(y)
    doubled = np.rint(2 * near).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(axis=1) & (near.sum(axis=1) % 2 == 0)).all()
    own = ((y - near) ** 2).sum(axis=1)
    others = ((y[:, None] - near[:, None] - vectors.MINIMAL[None]) ** 2).sum(axis=2)
    assert (own[:, None] <= others + 1e-9).all()
