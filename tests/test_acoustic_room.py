"""Acoustic groups shuffle no texts; turns are the same over block edges."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cueloom.functions.sequence import BLOCK_ROWS
from cueloom.operators import layout, segment


def _room(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(at, name)) for f in folders for at, _, names in os.walk(f.getPath()) for name in names)


@pytest.fixture
def shuffled_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_shuffles_carry_no_words(spark, shuffled_joins):
    n, i = 20_000, F.col("id")
    words = spark.range(n).select(F.floor(i / 1000).alias("media_id"), (i % 1000).alias("word_idx"), F.concat(*[F.sha2(F.concat(i.cast("string"), F.lit(k)), 256) for k in "abcd"], F.when(i % 12 == 0, ".").otherwise("")).alias("text"), (400 * (i % 1000) + F.xxhash64("id") % 50).alias("start_ms"))
    words = words.withColumn("end_ms", F.col("start_ms") + 250)
    before = _room(spark)
    assert layout.acoustic_groups(words, segment.heuristic_turns(words)).count() > n / 20
    assert _room(spark) - before < 110 * n


def test_turns_over_block_edges(spark):
    rng, want = random.Random(5), set()
    at, t, track = BLOCK_ROWS - 60, 0, []
    for _ in range(120):
        at, t = at + rng.choice([1, 1, 1, 2, BLOCK_ROWS // 8]), t + rng.choice([300, 500, 650, 950])
        track.append((at, rng.choice(["a", "b.", "c?", "d!", "e"]), t, t + 250))
    for k, (_, text, _, end) in enumerate(track[:-1]):
        gap, rest = track[k + 1][2] - end, [r[1] for r in track[k + 1 : k + 4]]
        short = any(x[-1] in ".?!" for x in rest[:2]) or len(rest) < 3
        if text[-1] in ".?!" and (gap >= 600 or (gap >= 150 and (text[-1] == "?" or short))):
            want.add((track[k + 1][0], track[k + 1][2]))
    rows = [(1, *r) for r in track]
    words = spark.createDataFrame(rows, "media_id bigint, word_idx bigint, text string, start_ms bigint, end_ms bigint")
    assert {(r.word_idx, r.start_ms) for r in segment.heuristic_turns(words).collect()} == want
