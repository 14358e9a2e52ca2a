"""Literal cases per operator."""

import random

from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.operators import align as A
from cueloom.operators import anomaly, cast, entities, layout, mining, qc
from cueloom.operators import compare as C
from cueloom.operators import segment as S
from cueloom.sources import subtitles


def one(spark, column, *args, schema="t string"):
    return spark.createDataFrame([args], schema).select(column.alias("x")).first().x


def test_turkish_and_unspaced_tokens(spark):
    tr = lambda t: one(spark, C.normalize_tokens(F.col("t"), "tr"), t)
    assert tr("1998") == ["bin", "dokuz", "yüz", "doksan", "sekiz"]
    assert tr("0") == ["sıfır"] and tr("100") == ["yüz"] and tr("25") == ["yirmi", "beş"]
    assert tr("Saat 10'da geldim.") == tr("Saat onda geldim.")
    assert tr("(Eda) SERKAN'IN İşi, herhâlde!") == ["serkanın", "işi", "herhalde"]
    assert tr("Valla abicim baya") == tr("Vallahi abiciğim bayağı")
    ja = lambda t: one(spark, C.normalize_tokens(X.nfkc("t"), "ja"), t)
    assert ja("（笑）今日は、いい天気ですね！") == list("今日はいい天気ですね") and ja("カナコ") == ja("かなこ")
    assert one(spark, C.normalize_tokens(X.nfkc("t"), "th"), "<i>สวัสดี</i> ครับ") == list("สวัสดีครับ")


def test_chrf(spark):
    def score(*pairs):
        return C.chrf(spark.createDataFrame(list(pairs), "hyp string, ref string")).first().chrf

    assert abs(score(("Where is Eda?", "Where is Eda?")) - 100) < 1e-9 and score(("xyz", "abc")) == 0
    assert score(("I'm very tired today.", "I'm really tired today.")) > score(("The weather is nice.", "I'm really tired today."))


def test_names_and_glossary(spark):
    g = entities.assign_placeholders(spark.createDataFrame([(1, "Eda", "Eda", 0), (1, "Eda Yıldız", "Eda Yıldız", 1), (1, "eda", "Eda", 2)], "series int, form string, canonical string, form_order bigint"))
    g = g.withColumns({"case_sensitive": F.lit(False), "turkish_case_suffixes": F.col("form") == "Eda"})
    lines = spark.createDataFrame([(1, "Eda Yıldız geldi, EDA gitti. Edaya Edagül", "Eda came")], "series int, text string, translated string")
    r = entities.protected_lines(entities.with_glossary(lines, g)).select("protected", entities.restore("protected").alias("back"), entities.recover_entities().alias("rec")).first()
    assert r.protected == "Xab geldi, Xaa gitti. Xaaya Edagül"
    assert r.back.startswith("Eda Yıldız geldi, Eda gitti.")
    assert one(spark, entities.repair_placeholders(F.lit("Xaz came"), F.col("t")), "Xab geldi") == "Xab came"
    assert one(spark, mining.is_title_case("t"), "Made By The Crew") and not one(spark, mining.is_title_case("t"), "Made by The Crew")
    ko = [r["token"] for r in one(spark, mining.hangul(F.col("t")), "은결이는 지훈에게서 왔다")]
    assert "은결이" in ko and "지훈" in ko
    credit = one(spark, cast.parse_credit("t"), 'Dr. Engin "Ferit" Şimşek Bey / Other')
    assert (credit.given, credit.full_name, credit.nicknames) == ("Engin", "Engin Şimşek", ["Ferit"])
    assert one(spark, cast.parse_credit("t"), "Self") is None


def test_source_cues(spark):
    def cues(texts, lang, step=0.2, start=0.0):
        rows = [(1, lang, i, t, int(1000 * (start + i * step)), int(1000 * (start + i * step + step * 0.8)), False) for i, t in enumerate(texts)]
        w = spark.createDataFrame(rows, "media_id bigint, lang string, word_idx bigint, text string, start_ms bigint, end_ms bigint, joins_previous boolean")
        return layout.build_cues(w).orderBy("cue_idx").collect()

    out = cues(["Tamam.", "Gidelim", "hadi."], "tr")
    assert [c.text for c in out] == ["Tamam.", "Gidelim hadi."] and out[1].boundary_before == "sentence_end"
    assert [c.text for c in cues(["Dr.", "Serkan", "geldi."], "tr")] == ["Dr. Serkan geldi."]
    long = "Sana bunu söylemek istemiyordum ama artık gerçeği bilmen gerekiyor bence çünkü bu böyle devam edemez.".split()
    out = cues(long, "tr", 0.25)
    assert len(out) > 1 and all(len(c.text) <= 84 for c in out) and " ".join(c.text for c in out).split() == long


def test_span_distribution_and_target_layout(spark):
    def runs(text, weights):
        d = spark.createDataFrame([(text, weights)], "t string, w array<int>")
        return [tuple(r) for r in d.select(layout.distribute_span_text("t", "w").alias("x")).first().x]

    assert runs("Hey, can you read it?", [1, 1, 1]) == [(0, 3, "Hey, can you read it?")]
    assert runs("- Good morning.\n- Good morning to you too.", [2, 5]) == [(0, 1, "- Good morning."), (1, 2, "- Good morning to you too.")]
    assert runs("Short. And a much longer second sentence here.", [2, 2, 9]) == [(0, 1, "Short."), (1, 3, "And a much longer second sentence here.")]
    d = spark.createDataFrame([(1, "I went home. Then I slept well.", 0, 10000), (2, "- Good morning, Mr. Serkan.\n- Good morning, Mr. Serkan.", 10000, 12000)], "id int, text string, start_ms bigint, end_ms bigint")
    out = layout.layout_target(d, ["id"]).orderBy("id", "piece_idx").collect()
    assert [c.text for c in out if c.id == 1] == ["I went home.", "Then I slept well."] and out[1].end_ms == 10000
    assert [c.lines for c in out if c.id == 2] == [["- Good morning, Mr. Serkan.", "- Good morning, Mr. Serkan."]]


def test_block_alignment(spark):
    schema = "media_id bigint, cue_idx bigint, start_ms bigint, end_ms bigint, text string"
    gen = spark.createDataFrame([(1, 0, 20000, 24000, "I am going home now to sleep"), (2, 0, 0, 2000, "hello there friend"), (2, 1, 4000, 6000, "goodbye for now"), (3, 0, 50000, 52000, "The cat sat quietly on the mat")], schema)
    ref = spark.createDataFrame([(1, 0, 20000, 22000, "I am going home"), (1, 1, 22000, 24000, "now to sleep"), (2, 0, 0, 2000, "hello there friend"), (2, 1, 2000, 4000, "completely unrelated inserted aardvark content"), (2, 2, 4000, 6000, "goodbye for now"), (3, 0, 50000, 52000, "The cat knocked the lamp off the table")], schema)
    out = {}
    for r in C.classify_blocks(A.align_tracks(gen, ref)).collect():
        out.setdefault(r.media_id, []).append(r.category)
    assert out[1] == ["SEGMENTATION_DIFFERENCE"] and out[3] == ["SUBSTITUTION"]
    assert sorted(out[2]) == ["CORRECT", "CORRECT", "DROPPED_UTTERANCE"]


def test_retiming(spark):
    rng, t, cues, words = random.Random(3), 5.0, [], []
    for i in range(120):
        ws = [f"kelime{rng.randrange(600)}" for _ in range(rng.randint(4, 9))]
        d = rng.uniform(1.5, 3.5)
        cues.append((i, t, t + d, " ".join(ws)))
        words += [(w, t + d * k / len(ws), t + d * (k + 1) / len(ws)) for k, w in enumerate(ws)]
        t += d + rng.uniform(0.3, 3.0)
    moves = {1: lambda x: x + 5.1, 2: lambda x: x, 3: lambda x: x * 23.976 / 25, 4: lambda x: x + (4.0 if x > cues[60][1] else 0.0)}
    c = [(m, i, int(1000 * f(s)), int(1000 * f(e)), x) for m, f in moves.items() for i, s, e, x in cues]
    w = [(m, k, x, int(1000 * s), int(1000 * e)) for m in moves for k, (x, s, e) in enumerate(words)]
    new, report = A.retime(spark.createDataFrame(c, "media_id bigint, cue_idx bigint, start_ms bigint, end_ms bigint, text string"), spark.createDataFrame(w, "media_id bigint, word_idx bigint, text string, start_ms bigint, end_ms bigint"))
    assert {r.media_id: r.method for r in report.collect()} == {1: "constant offset", 2: "aligned", 3: "linear drift", 4: "stepped"}
    err = [abs(r.start_ms / 1000 - cues[r.cue_idx][1]) for r in new.collect()]
    assert sum(err) / len(err) < 0.2


def test_points_and_mentions(spark):
    p = lambda xs: spark.createDataFrame([(1, x) for x in xs], "media_id bigint, at_ms bigint")
    r = A.match_points(p([1000, 1300, 9000]), p([1200, 1500, 5000]), 400).first()
    assert (r.tp, r.ref_n, r.hyp_n) == (2, 3, 3)
    schema = "media_id bigint, cue_idx bigint, start_ms bigint, end_ms bigint, text string"
    prod = spark.createDataFrame([(1, 0, 0, 2000, "Ayşe geldi."), (1, 1, 6000, 8000, "Cankaya")], schema)
    ref = spark.createDataFrame([(1, 0, 0, 2000, "Ayşe'yi gördüm."), (1, 1, 3000, 5000, "Mehmet geldi."), (1, 2, 6000, 8000, "Can geldi.")], schema)
    forms = spark.createDataFrame([("Ayşe", "Ayşe"), ("Ayşe", "Ayşe'yi"), ("Mehmet", "Mehmet"), ("Can", "Can")], "canonical string, form string")
    got = {r.form: r for r in A.mention_recall(prod, ref, forms).collect()}
    assert got["Ayşe'yi"].exact_form_mismatch == 1 and got["Mehmet"].absent_content == 1 and got["Can"].name_absent == 1


def test_quality_rules(spark):
    ok = lambda t: one(spark, X.unbalanced_brackets("t"), t)
    assert ok("(a]") and ok("(") and not ok("([x])") and not ok("plain")
    p = spark.createDataFrame([(1, 0, "Merhaba", ""), (1, 1, "Merhaba", "Xab came"), (1, 2, "bir iki üç dört beş altı yedi sekiz", "one two three four")], "media_id int, idx bigint, source string, translated string")
    assert [r.category for r in qc.qc_translation(p).orderBy("index").collect()] == ["translation_error", "entity_error", "translation_error"]
    assert one(spark, anomaly.compression_score(F.col("t")), 7.4, schema="t double") == 0.75
    assert one(spark, anomaly.is_loop_shaped("t"), "hahahahahahaha")


def test_srt_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([(7, 1, 3000, 4000, ["b", "c"]), (7, 0, 1000, 2000, ["a"])], "media_id bigint, cue_idx bigint, start_ms bigint, end_ms bigint, lines array<string>")
    subtitles.write_cues(cues, str(tmp_path / "out"))
    back = subtitles.read_cues(spark, str(tmp_path / "out" / "media_id=7")).orderBy("cue_idx").collect()
    assert [(r.start_ms, r.end_ms, r.lines) for r in back] == [(1000, 2000, ["a"]), (3000, 4000, ["b", "c"])]


def test_context_spans_and_turns(spark):
    rows = [(1, i, 1000 * i, 1000 * i + 900, "a b", "display_split") for i in range(14)]
    c = spark.createDataFrame(rows, "media_id bigint, cue_idx bigint, start_ms bigint, end_ms bigint, text string, boundary_before string")
    assert sorted(r.cue_idx for r in layout.context_spans(c).collect()) == [0, 6, 12]
    assert sorted(r.cue_idx for r in layout.merge_groups(c).collect()) == [0, 7]
    assert one(spark, S.strip_affix(F.col("t"), F.lit("come in."), F.lit(True)), "Come in, everything") == "everything"
