"""Edit distances and tokens of windows: bit vectors against the plain tables, at the cost of bits."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.operators import align as A
from cueloom.operators import compare as C


def table(a, b):
    out = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, out[i][j + 1] + 1, out[i][j] + (x != y)))
        out.append(row)
    return out


def by_table(ref, hyp):
    cost, at, lost, added, pairs = table(ref, hyp), (len(ref), len(hyp)), 0, 0, []
    while at != (0, 0):
        i, j = at
        drop, add = i > 0 and cost[i - 1][j] < cost[i][j], j > 0 and cost[i][j - 1] < cost[i][j]
        level = i > 0 and j > 0 and cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]) == cost[i][j]
        if level and (ref[i - 1] == hyp[j - 1] or not (drop or add) or A._alike(ref[i - 1], hyp[j - 1])):
            pairs += [{"ref": ref[i - 1], "hyp": hyp[j - 1]}] * (ref[i - 1] != hyp[j - 1])
            at = i - 1, j - 1
        else:
            lost, added, at = lost + drop, added + (not drop), (i - 1, j) if drop else (i, j - 1)
    return len(pairs), lost, added, pairs


def test_word_and_character_edits_are_those_of_the_table():
    draw = random.Random(5)
    stock = ["cat", "cart", "car", "dog", "dig", "house", "é", "x"]
    for _ in range(3000):
        ref, hyp = (draw.choices(stock[: draw.choice([1, 2, 8])], k=draw.randint(0, 12)) for _ in range(2))
        assert A._word_edits(ref, hyp) == by_table(ref, hyp), (ref, hyp)
        a, b = " ".join(ref), " ".join(hyp)
        assert C._edit_distance(a, b) == table(a, b)[-1][-1], (a, b)


def test_a_window_costs_bits_and_no_table():
    # 2,000 words a side: four million cells of a table were 16 MB
    ref, hyp = [f"w{i}" for i in range(2000)], [f"w{i * 7 % 2000}" for i in range(2000)]
    tracemalloc.start()
    A._word_edits(ref, hyp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000, peak


@pytest.mark.parametrize("text", ["", "  ", " a\xa0b\n", "a_1 (x) [y] <i>b</i> {n} c", "♪ a-b ♫", "（x）é​z", None])
def test_words_and_tokens_in_one_pass(spark, text):
    d = spark.createDataFrame([(text,)], "t string")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    split = lambda c: F.when(strip(c) == "", F.array().cast("array<string>")).otherwise(F.split(strip(c), r"(?U)\s+"))
    bare = F.regexp_replace(F.lower("t"), r"\([^)]*\)|\[[^\]]*\]|<[^>]+>|\{[^}]*\}|（[^）]*）|[♪♫]", " ")
    row = d.select(X.strip("t").alias("a"), strip("t").alias("b"), X.words("t").alias("c"), split(F.col("t")).alias("d"), C.normalize_tokens(F.col("t"), "en").alias("e"), split(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " ")).alias("f")).first()
    assert (row.a, row.c, row.e) == (row.b, row.d, row.f)


def test_ascii_does_not_reach_the_normal_form(spark):
    d = spark.createDataFrame([("plain",), ("ｆｕｌｌ",), (None,)], "t string")
    assert [r.t for r in d.select(X.nfkc("t").alias("t")).collect()] == ["plain", "full", None]
    plan = d.select(X.nfkc(F.col("t")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan
