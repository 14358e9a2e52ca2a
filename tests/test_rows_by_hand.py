"""Operators without SQL text, held against plain Python on small tracks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cueloom.operators import align as A
from cueloom.operators import compare as C
from cueloom.operators import layout as L
from cueloom.streaming import progress as P

pytestmark = pytest.mark.usefixtures("spark")

WINDOWS = [
    (1, 0, "where is the old house".split(), "where was the old mouse".split()),
    (1, 1, "we will meet again".split(), "we meet again soon".split()),
    (2, 0, "hello there".split(), []),
    (2, 1, [], "noise".split()),
    (3, 0, "where is the house".split(), "where is the mouse".split()),
]


def windows(spark):
    return spark.createDataFrame(WINDOWS, "media_id bigint, minute bigint, ref array<string>, hyp array<string>")


def test_rates_and_substitutions(spark):
    aligned = A.align_windows(windows(spark))
    rows = {(r.media_id, r.minute): r for r in aligned.collect()}
    want = {(1, 0): (2, 0, 0), (1, 1): (0, 1, 1), (2, 0): (0, 2, 0), (2, 1): (0, 0, 1), (3, 0): (1, 0, 0)}
    assert {k: (r.subs, r.dels, r.inss) for k, r in rows.items()} == want
    pairs = Counter((p.ref, p.hyp) for r in rows.values() for p in r.pairs)
    assert pairs == {("is", "was"): 1, ("house", "mouse"): 2}
    assert [tuple(r) for r in A.top_substitutions(aligned, 1).collect()] == [("house", "mouse", 2)]
    r = C.error_rates(C.char_errors(aligned)).first()
    n = sum(len(x[2]) for x in WINDOWS)
    assert r.ref_words == n
    assert (r.wer, r.subst, r.missed, r.extra) == pytest.approx((100 * 8 / n, 100 * 3 / n, 100 * 3 / n, 100 * 2 / n))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    refs, hyps = zip(*[(" ".join(x[2]), " ".join(x[3])) for x in WINDOWS], strict=True)
    assert r.cer == pytest.approx(100 * sum(map(distance, refs, hyps)) / sum(map(len, refs)))


def test_lyrics_coverage(spark):
    schema = "media_id bigint, cue_idx bigint, start_ms bigint, end_ms bigint, text string"
    ref = spark.createDataFrame([(1, 0, 1_000, 2_000, "♪ moon over water"), (1, 1, 61_000, 62_000, "♪ silver light"), (1, 2, 63_000, 64_000, "Who sings there?"), (2, 0, 0, 1_000, "♪ lost song")], schema)
    hyp = spark.createDataFrame([(1, 0, 1_000, 2_000, "moon under water"), (1, 1, 61_000, 62_000, "silver light")], schema)
    got = A.lyrics_coverage(ref, hyp, C.normalize_tokens(F.col("text"), "en")).first()
    # the second minute is spoken too, so its sung words count as not heard; the second track heard nothing
    assert (got.lyric_words, got.lyric_hits) == (7, 2)


def test_bootstrap_intervals(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.randint(0, 4), 20, rng.randint(2, 9), 20) for i in range(200)]
    d = spark.createDataFrame(rows, "media_id bigint, minute bigint, err_a bigint, n_a bigint, err_b bigint, n_b bigint")
    got, again = C.bootstrap_delta(d, ["media_id", "minute"]).first().asDict(), C.bootstrap_delta(d.repartition(7), ["media_id", "minute"]).first().asDict()
    assert got == pytest.approx(again)
    means = sorted(
        100 * (sum(rows[k][4] for k in pick) - sum(rows[k][2] for k in pick)) / (20 * len(pick)) for pick in ([rng.randrange(200) for _ in range(200)] for _ in range(1_000))
    )
    low, high = sorted(v for v in got.values() if isinstance(v, float))[0], sorted(v for v in got.values() if isinstance(v, float))[-1]
    assert low == pytest.approx(means[25], abs=0.6) and high == pytest.approx(means[974], abs=0.6)
    same = C.bootstrap_delta(d.select("media_id", "minute", "err_a", "n_a", F.col("err_a").alias("err_b"), F.col("n_a").alias("n_b")), ["media_id", "minute"]).first().asDict()
    assert all(v == 0 for v in same.values() if isinstance(v, float))
    pairs = spark.createDataFrame([(1, i, f"line number {i} of it", f"line number {i} of it", f"lime nomber {i}") for i in range(60)], "media_id bigint, idx bigint, ref string, hyp_a string, hyp_b string")
    worse = C.bootstrap_chrf(pairs, ["media_id", "idx"]).first().asDict()
    assert all(-100 < v < -10 for v in worse.values() if isinstance(v, float))


def test_turn_scores(spark):
    points = lambda rows: spark.createDataFrame(rows, "media_id bigint, at_ms bigint")
    ref = points([(1, 1_000), (1, 5_000), (1, 9_000), (2, 100)])
    hyp = points([(1, 1_200), (1, 1_300), (1, 9_400), (1, 20_000), (3, 50)])
    got = {r.media_id: (r.status, r.tp, r.precision, r.recall) for r in A.score_turns(hyp, ref, tol_ms=350).collect()}
    assert got[1] == ("scored", 1, 0.25, pytest.approx(1 / 3)) and got[2] == ("scored", 0, 0.0, 0.0)
    assert got[3] == ("no_ground_truth", 0, None, None)


def test_scorecard(spark):
    schema = "media_id bigint, cue_idx bigint, start_ms bigint, end_ms bigint, text string, lines array<string>"
    cue = lambda m, i, s, e, *lines: (m, i, s, e, " ".join(lines), list(lines))
    ref = spark.createDataFrame([cue(1, 0, 0, 1_000, "Oh no."), cue(1, 1, 2_000, 3_000, "Come here"), cue(1, 2, 4_000, 6_000, "x" * 50)], schema)
    hyp = spark.createDataFrame([cue(1, 0, 0, 1_000, "Oh no."), cue(1, 1, 2_000, 6_000, "Come", "here", "now")], schema)
    r = A.segmentation_scorecard(hyp, ref, C.normalize_tokens(F.col("text"), "en")).first()
    assert (r.boundary_precision, r.boundary_recall) == (1.0, 0.5)
    assert (r.sys_over_box, r.ref_over_box) == (0.5, pytest.approx(1 / 3)) and (r.sys_cues, r.ref_cues) == (2, 3)
    assert (r.sys_mid_sentence, r.ref_mid_sentence) == (0.5, pytest.approx(2 / 3)) and r.sys_mean_ms == 2_500


def test_blind_sample(spark):
    a = spark.createDataFrame([(i, f"a{i}" if i % 3 else f"same{i}") for i in range(60)], "id bigint, text string")
    b = spark.createDataFrame([(i, f"b{i}" if i % 3 else f"same{i}") for i in range(60)], "id bigint, text string")
    sheet, key = C.blind_sample(a, b, ["id"], "text", 12)
    rows, which = {r.id: r for r in sheet.collect()}, {r.id: r.a_is for r in key.collect()}
    assert len(rows) == 12 and rows.keys() == which.keys() and all(i % 3 for i in rows)
    for i, r in rows.items():
        assert (r.side_a, r.side_b) == ((f"a{i}", f"b{i}") if which[i] == "first" else (f"b{i}", f"a{i}"))
    assert set(which.values()) == {"first", "second"}
    assert sorted(r.id for r in C.blind_sample(b, a, ["id"], "text", 12)[0].collect()) == sorted(rows)


def test_thin_progress(spark):
    rng = random.Random(9)
    rows, ts = [], 0
    for job in (1, 2):
        for stage, name in (("asr", "ASR"), ("translation", "TRANSLATION")):
            rows.append((job, len(rows), ts := ts + 1_000, f"{name}_STARTED", stage, None, None, 10.0))
            level = 10.0
            for k in range(1, 61):
                level += rng.choice([0.0, 0.2, 0.3, 0.7])
                rows.append((job, len(rows), ts := ts + rng.randint(1, 900_000), f"{name}_PROGRESS", stage, k, 60, level))
    d = spark.createDataFrame(rows, "job_id bigint, event_id bigint, ts_us bigint, name string, stage string, position bigint, total bigint, progress double")
    got = {r.event_id: (r.logged, r.written) for r in P.thin_progress(d).collect()}
    last, seen = {}, {}
    for job, event, _, name, stage, position, total, progress in rows:
        tick = name.endswith("_PROGRESS")
        step = 100 * position // total // 5 if tick and position < total else None
        logged = step is None or step > seen.get((job, name), -1)
        if step is not None:
            seen[job, name] = max(step, seen.get((job, name), -1))
        before = last.get(job, (None, -1.0))
        written = not tick or stage != before[0] or abs(progress - before[1]) >= 0.5
        if written:
            last[job] = (stage, progress)
        assert got[event] == (logged, written), event


def test_short_cues_merge(spark):
    schema = "media_id bigint, lang string, cue_idx bigint, start_ms bigint, end_ms bigint, text string, boundary_before string"
    rows = [
        (1, "en", 0, 0, 300, "so", None), (1, "en", 1, 400, 2_000, "we went there.", "display_split"),  # forward
        (1, "en", 2, 2_100, 2_400, "Yes.", "sentence_end"),  # finished: stays
        (1, "en", 3, 2_500, 2_700, "and", "display_split"), (1, "en", 4, 9_000, 9_200, "but", "display_split"),  # back to a finished short cue; too far
        (1, "en", 5, 9_300, 9_400, "no", "utterance_end"),  # a real boundary
        (2, "ja", 0, 0, 100, "あ", None), (2, "ja", 1, 200, 900, "そう", "display_split"),
    ]
    got = [(r.media_id, r.cue_idx, r.start_ms, r.end_ms, r.text) for r in L.merge_short_cues(spark.createDataFrame(rows, schema)).orderBy("media_id", "start_ms").collect()]
    assert got == [(1, 0, 0, 2_000, "so we went there."), (1, 2, 2_100, 2_700, "Yes. and"), (1, 4, 9_000, 9_200, "but"), (1, 5, 9_300, 9_400, "no"), (2, 0, 0, 900, "あそう")]
