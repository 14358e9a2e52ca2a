"""Quality rules and decontamination against plain Python."""

import hashlib
import re

import pytest

from cueloom.llm import common, decontaminate, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], 1, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def measured(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None,
    "",
    " \t\r\n",
    "one",
    "a b c a b c x",
    "a a a a a a",
    "é 日本 # * x|y <b>\nline\nline\n \nline",
    "x y z " * 40,
    " ".join(f"word{i}" for i in range(60)),
    " ".join(f"word{i}" for i in range(60)),
    "word " * 30_000,
    " nbsp is no gap　here",
]


def test_measures(spark):
    got = {r.doc_id: r for r in quality.quality(frame(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        n, chars, symbols, dups, repeat = measured(text) if i != 10 else (30_000, 120_000, 0, 0, 30_000)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeat), text
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
    # most texts of this only host are too short, so its verdict takes the good ones along
    assert not got[8].base_failed and not got[9].base_failed and not any(r.host_kept for r in got.values())


def test_host_verdict_is_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"word{i}" for i in range(60)) + " ###" * 10
    texts = [good] * 60 + [bad] * 30 + [bad] + [good]
    sources = [f"g{i % 3}" for i in range(60)] + ["spam"] * 30 + ["g0"] + [None]
    docs = frame(spark, texts, sources)
    measures = quality.measures(docs)
    rates = {(r["host"], r["rule"]): r["rate"] for r in quality.host_rates(measures).collect()}
    assert rates["spam", "symbols"] > 0.9 and 0 < rates["g1", "symbols"] < 0.1  # no host is at exactly 0 or 1
    got = quality.quality(docs).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(60, 90))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60)) | {90, 91}
    assert kept.first().kept == "clash"


def test_quality_of_nothing(spark):
    docs = frame(spark, ["x"]).where("false")
    assert quality.quality(docs).count() == 0 and quality.keep_good(docs).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    out = {}
    for d, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for item, body in items:
            b = words_of(body)
            n = min(13, len(b))
            for s in range(len(b) - n + 1) if n else []:
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[s : s + n]:
                        hit |= set(range(i, i + n))
                        ids.add(str(item))
        ids = sorted(ids)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


P = [f"p{i}" for i in range(40)]
ITEMS = [(1, " ".join(P)), (2, "Short ITEM, ünique!"), (3, None), (4, "..."), (5, " ".join(P)), (6, "solo"), (7, "r " * 20), (10, " ".join(P[5:18]))]
BODIES = [
    None,
    "",
    "!!!",
    "x " * 30 + " ".join(P[3:20]) + " y" * 30,
    "P3, p4; " + " ".join(P[5:17]) + " end",
    "here a short item: Ünique and SHORT item, ünique",
    "solo " * 5 + "other " * 200,
    "r " * 40,
    " ".join(P[5:17]),
    "q " * 5000 + " ".join(P) + " q" * 5000,
    "clean words only",
    "clean words only",
]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def test_contamination(spark):
    docs = frame(spark, BODIES)
    got = {r.doc_id: tuple(r)[2:] for r in decontaminate.scan(docs, bench(spark)).select("fp", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert got == brute(list(enumerate(BODIES)), ITEMS)
    out = decontaminate.drop_contaminated(docs, bench(spark))
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {d for d, v in brute(list(enumerate(BODIES)), ITEMS).items() if not v[4]}


def test_contamination_shuffle_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "small_side", lambda df, bound=0: df)
    docs = frame(spark, BODIES)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.scan(docs, bench(spark)).collect()}
    assert got == {d: v[:3] for d, v in brute(list(enumerate(BODIES)), ITEMS).items()}


def test_contamination_of_equal_rows_and_null_ids(spark):
    rows = [(None, BODIES[3]), (None, BODIES[3]), (None, "clean"), (1, BODIES[3]), (1, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.contaminated) for r in decontaminate.scan(docs, bench(spark)).collect())
    assert got == [(-1, False), (-1, True), (-1, True), (1, False), (1, True)]
    assert decontaminate.drop_contaminated(docs, bench(spark)).count() == 2


def test_many_grams_are_shuffled_with_few_words(spark, monkeypatch):
    """Beyond the bound of a broadcast: the same result, and no row wider than 25 words."""
    docs = frame(spark, [*BODIES, "lead in words " * 40 + " ".join(P[:13]) + " lead out words" * 40])
    want = sorted(map(tuple, decontaminate.scan(docs, bench(spark)).collect()), key=repr)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = decontaminate.scan(docs, bench(spark))
    assert sorted(map(tuple, got.collect()), key=repr) == want and any(r[5] for r in want)


@pytest.mark.parametrize("items", [[], [(3, None)], [(4, "...")]])
def test_nothing_to_find(spark, items):
    docs = frame(spark, BODIES)
    got = decontaminate.scan(docs, bench(spark, items) if items else bench(spark).where("false")).collect()
    assert len(got) == len(BODIES) and not any(r.contaminated for r in got)
    assert decontaminate.scan(docs.where("false"), bench(spark)).count() == 0


def test_spans_are_cut_out(spark):
    docs = frame(spark, ["Start here: " + ", ".join(P[:13]) + ". The End!", None, "clean"])
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench(spark)).collect()}
    assert got == {0: "Start here: The End!", 1: None, 2: "clean"}


def test_hosts_on_both_sides_of_the_bound(spark):
    rows = [(h, 10, 50 if i < failed else 0) for h, failed in (("under", 75), ("over", 85), ("good", 2)) for i in range(100)]
    measures = spark.createDataFrame([(h, 100, 500, s, n, 0, 0) for h, n, s in rows], "source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    rates = {r["host"]: r["rate"] for r in quality.host_rates(measures).where("rule = 'symbols'").collect()}
    assert 0.5 < rates["under"] < 0.8 < rates["over"] < 0.9
    assert sorted(r["_host"] for r in quality.bad_hosts(measures).collect()) == ["over", "under"]
    assert [r["_host"] for r in quality.bad_hosts(measures, max_rate=0.8).collect()] == ["over"]
