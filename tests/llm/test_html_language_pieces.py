"""HTML text, language identification and the SentencePiece scan."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from cueloom.llm import htmltext, language, queries, spm
from cueloom.llm.queries import table, tokenizer_path

DATA = "/root/testdata/sf0.001"
A, B = "This paragraph is long enough, with commas, to count as text.", "A second one, just as long, and with a few commas too."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (f"<nav>Home, about, contact and all the rest</nav><article><h1>T&eacute;</h1><p>{A}<p>{B}</article><footer>foot</footer>", f"Té\n\n{A}\n\n{B}"),
        (f"<body><header><h1>Site</h1></header><div class='main-content'><p>{A}</p>\n<p>{B}</p><p>short.</p></div><div id=comments><p>{A}</p></div></body>", f"{A}\n\n{B}\n\nshort."),
        (f"<article><p>{A}<script>var x='</p><p>no';</script> end<br>of it</p><div class='ad-box'>buy, buy</div><form>Mail: <input></form><p>{B}</article>", f"{A} end of it\n\n{B}"),
        (f"<main><header><h1>Kept</h1></header><p>{A}</p><aside>{B}</aside><ul class=menu><li>x</ul><ul><li>item one<li>item two</ul></main>", f"Kept\n\n{A}\n\nitem one\n\nitem two"),
        (f"<div class='cookie-consent'>{A}</div><div><div><p>{B}</p></div></div>", B),
        (f"<article><p>{A}<!-- comment <p>no</p> --></p><p>5 &lt; 6 &amp;&nbsp;&nbsp;7 &#x1F600;</p><style>p{{}}</style>", f"{A}\n\n5 < 6 & 7 \U0001f600"),
        (f"<article><p>{A}</p><ul><li><a href=1>One link</a><li><a href=2>Two link</a></ul></article><p>cut off <a hre", A),
        ("<html><head><title>No</title></head><body><p>Tiny.</p><footer>x</footer></body></html>", "Tiny."),
        ("<nav>only</nav>", ""),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_hostile_markup_is_read_in_time():
    for page in ("<" * 200_000, "<div>" * 50_000 + A, "<a title=\"" * 50_000, "<!--" + "x" * 500_000, "&" * 300_000, "</p>" * 100_000):
        htmltext.main_text(page)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{A}</article>", "x"), (1, "u", f"<article><p>{A}</article>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in htmltext.extract(pages).collect()), key=repr)
    assert got == [(0, None, "", 0), (1, "u", A, len(A)), (1, "u", A, len(A))]
    assert htmltext.extract(pages.where("false")).count() == 0
    whole = htmltext.extract(table(spark, DATA, "pages")).collect()
    assert len(whole) == 50 and all("track(" not in r.text and "&copy;" not in r.text and r.n_chars == len(r.text) for r in whole)


def test_language_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_labels_of_held_out_rows_are_not_used(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in language.identify(other).collect()}


def test_language_of_odd_rows(spark):
    rows = [(i, t, lang, "clash") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chien et le chat", "fr")] * 8)]
    odd = [(100, None, "en", "c"), (101, "", "en", "c"), (102, "12 34 !?", None, "c"), (None, "the dog", None, "c"), (104, "the cat " * 300_000, None, "c"), (104, "the cat", None, "c")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert len(got) == 24 + 5 and language.identify(docs).count() == 30
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[None].lang_pred == "en" and got[104].lang_pred == "en" and not got[None].held_out
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 27 and kept.first().score == "clash"
    unlabelled = docs.withColumn("lang", docs["doc_id"].cast("string").substr(9, 1)).where("doc_id = 1").selectExpr("doc_id", "text", "nullif(lang, '') AS lang")
    assert language.identify(unlabelled).first().lang_pred == "und"
    assert language.identify(docs.where("false")).count() == 0
    one = docs.where("lang = 'en' AND text IS NOT NULL")
    assert {r.lang_pred for r in language.identify(one).collect()} == {"en", "und"}


MODEL = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "a  b", " lead", "tail ", "a\nb", "a \n b\n\nc", "héllo wörld", "日本語 テキスト", "\U0001f642 ok", "x" * 100, "a\tb", "tie " * 50]


def pieces_of(texts):
    encode, out = spm.merge_encoder(MODEL), []
    for ids, sizes in encode(pa.array(texts)):
        out += [x.astype(np.int64) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    return out


def test_neighbours_alone_tell_the_cut_of_the_library():
    model, r = spm.merge_encoder(MODEL).model, random.Random(7)
    texts = [c * n for c in "xse-1▁" for n in (1, 2, 15, 16, 17, 33, 100)]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 50))) for letters in ("ab", "aaab", "thein", "▁the", "etaoinshrdlu", "lL1|", "=-_*") for _ in range(60)]
    for text in texts:
        piece, size = model.chain(text, 0, None, len(text))
        out, end = [], len(text)
        while end:
            out, end = [piece[end], *out], end - size[end]
        assert out == model.library.encode(text)


def test_decode_gives_the_text():
    model = spm.merge_encoder(MODEL).model
    assert [model.decode(x) for x in pieces_of(ODD)] == ODD


def test_many_blocks_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(spm, "BLOCK", 4)
    text = "internationalization of the foxes " * 40
    docs = spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")
    got = spm.encode_merges(docs, MODEL, chunk=11).collect()
    whole = pieces_of([text])[0].tolist()
    assert len(got) == 3 and sorted(len(r.ids) for r in got) == [0, len(whole), len(whole)] and all(r.round_trip for r in got)
    assert spm.encode_merges(docs.where("false"), MODEL).count() == 0


@pytest.mark.parametrize("chunk", [3, 7, 50, spm.CHUNK])
def test_merges_give_the_ids_of_the_library(spark, chunk):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(chunk)
    texts = ODD + [None, "<s> </s> <unk> <0x0A>", "  \n\n  x ▁y▁", "\0 a\r\n", "internationalization of unbelievably overlazy foxes " * 9, "日本語のテキスト" * 40, "thethe" * 60]
    texts += ["".join(r.choice("thea in\n,é日") for _ in range(300)) for _ in range(20)] + ["x" * 400, " " * 90, "ab" * 150, "".join(r.choice("aab") for _ in range(500)), "\n" * 40]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = spm.encode_merges(docs, MODEL, chunk=chunk).orderBy("doc_id").collect()
    assert [r.ids for r in got] == library.encode([t or "" for t in texts]) and all(r.n_tokens == len(r.ids) for r in got)


def test_query_gives_the_ids_of_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").collect()}
    got = {r.doc_id: r.ids for r in queries.QUERIES["op6_sentencepiece"](spark, DATA).collect()}
    assert got == dict(zip(texts, library.encode(list(texts.values())), strict=True))


LINKS = "<ul><li><a href=1>A report of the commission on inland waters, 2019</a><li><a href=2>Minutes of the second meeting on the same</a></ul>"


@pytest.mark.parametrize(
    "page,text",
    [
        *[(f"<body><div class='{c}'><article><p>{A}</p></article></div></body>", A) for c in ("content has-sidebar", "no-sidebar", "elementor-widget-container", "social-enabled", "widget", "sidebarWrapper")],
        (f"<body><div class='content has-sidebar'><p>{A}</p><p>{B}</p></div></body>", f"{A}\n\n{B}"),
        (f"<body><div class='widget'><p>{A}</p><p>{B}</p></div><div class='site-sidebar'><p>{B}</p></div></body>", f"{A}\n\n{B}"),
        (f"<article class='post comments-open'><p>{A}</p></article><div id=comments><article class=comment-body><p>{B}</p><p>{B}</p></article></div>", A),
        (f"<div id=page><p>{A}</p></div><div class=related><article><p>{B}</p><p>{B}</p></article></div>", A),
        (f"<article><p>{A} <svg-icon name=x></svg-icon> end</p><title-bar>x</title-bar><svg width=1 /><p>{B}</p></article>", f"{A} end\n\nx\n\n{B}"),
        (f"<article><p>{A}<script>var x</script > end</p></article>", f"{A} end"),
        (f"<article><p>{A}</p>{LINKS}</article>", f"{A}\n\nA report of the commission on inland waters, 2019\n\nMinutes of the second meeting on the same"),
        (f"<body><div id=x><p>{A}</p><div>Short one.</div>Bare words<div class=ad>buy</div><p>{B}</p></div></body>", f"{A}\n\nShort one.\n\nBare words\n\n{B}"),
        (f"<body><form id=aspnetForm><div><h1>Title</h1><p>{A}</p><p>{B}</p></div></form></body>", f"Title\n\n{A}\n\n{B}"),
        (f"<article><p>{A}</p><form><p>Subscribe to our letter, it is good for you.</p></form></article>", A),
        (f"<article><p>{A}</p><section id=login><h2>Login</h2><p>{B} {B}</p></section></article>", f"{A}\n\nLogin\n\n{B} {B}"),
        (f"<article><p>{A}</p><div class='related-work'><p>{B}</p></div></article>", f"{A}\n\n{B}"),
        (f"<article><p>{A}</p><div class='related-posts'><p>{B}</p></div></article>", A),
        (f"<body><nav><ul><li><a href=1>Home</a></ul><div><h1>Title</h1><p>{A}</p><p>{B}</p></div></body>", f"Title\n\n{A}\n\n{B}"),
        (f"<body><p>{A}</p><div>Short one.</div>Bare words<div class=ad>buy</div><p>{B}</p></body>", f"{A}\n\nShort one.\n\nBare words\n\n{B}"),
    ],
)
def test_article_text_is_not_lost(page, text):
    assert htmltext.main_text(page) == text
