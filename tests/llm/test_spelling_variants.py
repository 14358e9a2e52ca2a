import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cueloom.llm import spelling

pytestmark = pytest.mark.usefixtures("spark")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def result(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n int").withColumnRenamed("n", "word")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}


def corpus(seed, letters, words, draws):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(words)]
    rows = []
    for doc in range(draws):
        out = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.15)), len(base) - 1)]
            if rng.random() < 0.25:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            out.append(w.title() if rng.random() < 0.2 else w)
        rows.append((doc, rng.choice([" ", ", ", "\n", "-"]).join(out)))
    return rows


@pytest.mark.parametrize("block", [6_000, 7])
def test_equal_to_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = corpus(1, "abcéÀß", 30, 150) + [(7, "xxxxxx " * 9 + "xxxxxxx " * 60), (8, "xxxxxxxx " * 400)]
    want = brute(rows)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[1] not in (w, v[0]) for w, v in want.items())
    assert result(spark, rows) == want


def test_odd_rows(spark):
    long_word = "ab" * 20_000
    rows = [(1, None), (2, ""), (None, "window " * 6), (None, "windov " * 6), (3, "12 ab ab"), (4, f"{long_word} {long_word}c\n" * 5), (4, "÷×÷×÷× " * 5)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, [(1, None)]) == {}
    assert result(spark, []) == {}


def test_index_finds_every_near_word():
    rng = np.random.default_rng(2)
    for symbols, length in ((3, 7), (5, 8)):
        words = list({tuple(rng.integers(1, symbols, rng.integers(6, length + 1)).tolist()) for _ in range(200)})
        index = spelling.Index([np.array(w) for w in words], symbols)
        q, w = spelling.near_by_first_half(index, [np.array(x) for x in words])
        got = set(zip(q.tolist(), w.tolist(), strict=True))
        want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if a[: len(a) // 2] == b[: len(a) // 2] and one_edit(a, b)}
        assert got == want and want
