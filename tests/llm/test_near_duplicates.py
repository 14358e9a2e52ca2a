"""Near-duplicate groups against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cueloom.llm import neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def groups(docs):
    """doc_id -> (set size, component) by every pair of sets."""
    sets = {d: shingles(t) for d, t in docs if d is not None}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def edited(words, share, seed):
    r = random.Random(seed)
    return [f"n{r.random()}" if r.random() < share else w for w in words]


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    docs = [" ".join(base)] + [" ".join(edited(base, r.uniform(0, 0.25), i)) for i in range(150)]
    chain = [r.choice(vocabulary) for _ in range(90)]
    for i in range(25):  # neighbours are near, ends are far apart
        chain = edited(chain, 0.03, 1000 + i)
        docs.append(" ".join(chain))
    for i in range(120):
        docs.append(" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 30, 200]))))
    docs += [docs[0]] * 30 + [docs[0].upper()] * 3 + ["a b c", "A  b\tc\n", "x", "X", "", None, "  ", "é É", "nbsp one", "nbsp one"]
    order = list(range(len(docs)))
    r.shuffle(order)
    return [(i, docs[k]) for i, k in enumerate(order)]


def result(spark, rows):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, label string, n_shingles int")
    return docs, neardup.near_duplicates(docs)


def test_groups_are_those_of_all_pairs(spark):
    rows = corpus()
    _, out = result(spark, rows)
    want = groups(rows)
    got = out.collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_bucket_without_pivot_rounds_is_still_complete(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PIVOT_ROUNDS", 1)
    rows = corpus()[:220]
    _, out = result(spark, rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == groups(rows)


def test_null_and_repeated_ids(spark):
    text = "one two three four five"
    rows = [(None, text), (None, text), (None, None), (5, text), (5, text), (7, text), (9, None), (9, "")]
    docs, out = result(spark, rows)
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=repr)
    assert got == sorted([(-1, 4, None, True)] * 2 + [(-1, 0, None, True)] + [(5, 4, 5, True)] * 2 + [(7, 4, 5, False)] + [(9, 0, 9, True)] * 2, key=repr)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == 7


def test_no_rows_and_no_links(spark):
    docs, out = result(spark, [(1, "a b"), (2, "c d")])
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 2)]
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_long_set_is_signed_in_pieces():
    rng = np.random.default_rng(1)
    big = np.unique(rng.integers(0, 1 << 63, 3 * neardup.CHUNK, dtype=np.uint64))
    small = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 700)]
    together = neardup._signatures([small[0], big, small[1], small[2]])
    for i, s in enumerate([small[0], big, small[1], small[2]]):
        alone = neardup._signatures([s])
        assert all((a[i] == b[0]).all() for a, b in zip(together, alone, strict=True))
        low = (s >> np.uint64(32)).astype(np.uint32)
        assert len(low) and alone[0][0] == len(s)


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_sketches_pass_what_is_near(similarity):
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = 300
        shared = int(round(2 * n * similarity / (1 + similarity)))
        pool = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        *_, sketch, keys = neardup._signatures([np.unique(pool[:n]), np.unique(pool[n - shared :])])
        bits = int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum())
        assert bits <= neardup.SKETCH_LIMIT and (keys[0] == keys[1]).any()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(900, 901)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 901: 900}


def test_words_split_as_in_the_contract():
    sets = next(neardup.shingle_sets(pa.array(["A b\x0bC", "a B\tc", "a\x1cb", None])))
    assert sets[0].tolist() == sets[1].tolist() and len(sets[0]) == 2 and len(sets[2]) == 1 and len(sets[3]) == 0
