"""Token windows: what waits beside a UDF or crosses the shuffle is a cue's own text."""

import re

from pyspark.sql import functions as F

from cueloom.operators import compare as C
from cueloom.plans.compare import tokens
from cueloom.plans.fixtures import Fixtures


def test_no_cue_carries_its_track_beside_a_udf(spark, tmp_path):
    text = " ".join(f"w{i}é" for i in range(23))
    spark.createDataFrame([(1, text, "fr", "x"), (2, " one ", "en", "x")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    fx = Fixtures(spark, str(tmp_path))
    w = C.token_windows(fx.cues, tokens())
    plan = w._jdf.queryExecution().executedPlan().toString()
    waiting = plan[plan.index("ArrowEvalPython") :].splitlines()[1]
    assert "Generate" in waiting and not re.search(r"\[[^\[\]]*\ba#", waiting), waiting
    assert [r.tokens for r in w.orderBy("media_id").collect()] == [text.split(), ["one"]]
    words = text.split()
    got = [(r.cue_idx, r.start_ms, r.end_ms, r.text) for r in fx.cues.where("media_id = 1").orderBy("cue_idx").collect()]
    at = lambda i: 400 * i + 1000 * (i // 17) + 300 * (i // 7)
    assert got == [(k, at(7 * k), at(min(7 * k + 6, 22)) + 300, " ".join(words[7 * k : 7 * k + 7])) for k in range(4)]


def test_tokens_come_back_as_they_were(spark):
    cues = [(1, 3, ["c", ""]), (1, 1, ["a"]), (1, 2, []), (1, 1, ["a", "b"]), (2, 0, []), (3, 0, ["x\u0001y", "z"]), (3, 1, ["q"]), (4, 0, None), (4, 1, ["q"]), (5, 0, ["a", None]), (6, 0, [""])]
    d = spark.createDataFrame([(m, i, 0, 10, t) for m, i, t in cues], "media_id bigint, cue_idx bigint, start_ms bigint, end_ms bigint, t array<string>")
    got = {r.media_id: r.tokens for r in C.token_windows(d, F.col("t")).collect()}
    assert got == {1: ["a", "a", "b", "c", ""], 2: [], 3: ["x\u0001y", "z", "q"], 4: None, 5: ["a", None], 6: [""]}
