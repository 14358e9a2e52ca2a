"""Cuts of the lineage take little room, and rows per token do not go through the driver."""

import os

from pyspark.sql import functions as F

from cueloom.operators import align as A
from cueloom.session import cut_lineage


def _bytes(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder.removeprefix("file:")) for name in names)


def test_a_cut_takes_less_room_than_its_rows(spark):
    cut_lineage(spark.range(1))
    folder = spark.sparkContext.getCheckpointDir()
    before = _bytes(folder)
    d = cut_lineage(spark.range(200_000).select("id", F.lit("token").alias("token"), F.floor(F.col("id") / 100).alias("track")))
    assert d.count() == 200_000 and d.agg(F.sum("id")).first()[0] == 199_999 * 100_000
    assert _bytes(folder) - before < 3_200_000  # less than two longs a row


def test_heard_times_meet_cues_by_a_shuffle(spark):
    cues = spark.createDataFrame([(1, c, 4000 * c, 4000 * c + 2000, f"alpha{c} beta{c} gamma{c} delta{c}") for c in range(200)], "media_id long, cue_idx long, start_ms long, end_ms long, text string")
    said = [w for c in range(200) for w in (f"alpha{c}", f"beta{c}", f"gamma{c}", f"delta{c}")]
    words = spark.createDataFrame([(1, i, 1000 * i + 700, 1000 * i + 900, w) for i, w in enumerate(said)], "media_id long, word_idx long, start_ms long, end_ms long, text string")
    found = A.find_anchors(cues, words)
    rows = found.orderBy("cue_idx").collect()
    # heard at 1000 * i + 800, read at 4000 * c + 250, 750, 1250, 1750
    assert [(r.cue_idx, r.idx, r.at_ms, r.offset_ms) for r in rows] == [(c, c, 4000.0 * c + 1000, 1300.0) for c in range(200)]
    assert "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()
