"""Sharding, token packs and token counts against plain Python."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cueloom.llm import encoding, lengths, sharding, tokenfile
from cueloom.llm.common import shared_folder
from cueloom.llm.queries import tokenizer_path

PATH = tokenizer_path()
ODD = [
    None, "", " ", "a  b", "a \n b", "\n\n b c", "x" * 3000 + " y", "don't stop 's  ", "a\x1c b \x1cc", " lead", "tail ", "a　b c",
    "é è  ñ", "<|endoftext|> x", "1 2  3\t4 5", "a\n b\n  c", "\nB", "\n", "a\nb\n\nc\n", " \nq", "x\t\ny\n\tz", "a \n\nb", "\r\nx.\nY z \nw", "many words here " * 2000, "日本語のテキスト",
]


def whole(texts):
    tokenizer = encoding.unit_encoder(PATH).tokenizer
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("group,units", [(1 << 22, 1 << 20), (64, 40)])
def test_units_give_the_ids_of_the_whole_text(monkeypatch, group, units):
    monkeypatch.setattr(encoding, "GROUP", group)
    monkeypatch.setattr(encoding, "CACHE_UNITS", units)
    encode = encoding.UnitEncoder(PATH)
    got = []
    for _ in range(2):
        got = []
        for ids, sizes in encode(pa.array(ODD)):
            got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == whole(ODD)


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "s", 5, "clash") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, start long, shard string")


def test_token_file_round_trip(spark):
    texts = ODD + [f"text number {i} of some length" for i in range(300)]
    path = shared_folder(spark)
    tokenfile.write(docs_of(spark, texts).repartition(3), path, PATH)
    got = tokenfile.read(spark, path, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(got, whole(texts), strict=True):
        raw = np.array([*ids, 0], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids) + 1, zlib.crc32(raw), raw)
        start += len(ids) + 1
    few = {r.doc_id: r.ids for r in tokenfile.fetch(spark, path, [3, 23, 310]).collect()}
    assert few == {i: [*whole([texts[i]])[0], 0] for i in (3, 23, 310)}
    pack = bytes(spark.read.parquet(f"{path}/packs").first()["pack"])
    with pytest.raises(ValueError):
        tokenfile.frames_of(pack, b"\0" * 32)


def test_token_file_of_null_and_equal_ids(spark):
    docs = docs_of(spark, ["b", "a", "a", None], [None, 4, 4, None])
    got = tokenfile.round_trip(docs, PATH).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 4, 4] and [r.start for r in got] == [0, got[0].n_tokens, sum(r.n_tokens for r in got[:2]), sum(r.n_tokens for r in got[:3])]
    assert tokenfile.round_trip(docs.where("false"), PATH).count() == 0


def test_counts_for_every_limit(spark):
    texts = ODD + ["one two three"] * 5
    sizes = [len(x) for x in whole(texts)]
    sums = lengths.suffix_sums(lengths.histogram(docs_of(spark, texts), PATH)).cache()
    for r in sums.collect():
        n = r.n_tokens
        assert (r.n_docs, r.tokens) == (sizes.count(n), n * sizes.count(n))
        assert (r.docs_from, r.tokens_from) == (sum(s >= n for s in sizes), sum(s for s in sizes if s >= n))
        assert (r.docs_upto, r.tokens_upto) == (sum(s <= n for s in sizes), sum(s for s in sizes if s <= n))
        assert r.truncated_total == sum(min(s, n) for s in sizes)
    got = {r.context: (r.docs_cut, r.truncated_total, r.total) for r in lengths.answer_limits(sums, [0, 4, 77, 10**6]).collect()}
    assert got == {k: (sum(s > k for s in sizes), sum(min(s, k) for s in sizes), sum(sizes)) for k in (0, 4, 77, 10**6)}
    halves = {r.share: r.n_tokens for r in lengths.answer_quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    assert halves == {q: sorted(sizes)[max(0, int(np.ceil(q * len(sizes))) - 1)] for q in (0.1, 0.5, 1.0)}
    assert lengths.suffix_sums(lengths.histogram(docs_of(spark, ["x"]).where("false"), PATH)).count() == 0


def sharded(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    return sharding.interleave(docs, **more)


def test_shards_follow_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 50)
    rows = [(i, f"t{i}", "hot" if i % 3 == 0 else f"s{i % 7}", "x") for i in range(3000)]
    got = sharded(spark, rows, shards=10, carry=("source", "text")).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000)) and {r.law for r in got} == {"rows"}
    for shard in range(10):
        own = [r for r in got if r.shard == shard]
        assert len(own) == 300 and sorted(r.slot for r in own) == list(range(300))
        assert abs(sum(r.source == "hot" for r in own) - 100) <= 2
        assert all(abs(n - 300 * m / 3000) <= 2 for (s, n), m in [((s, n), sum(r[2] == s for r in rows)) for s, n in Counter(r.source for r in own).items()])
    r = got[0]
    assert (r.size, r.text_crc32) == (len(r.text) + 16, zlib.crc32(r.text.encode())) and r.grown_shard is None


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None, "x")] * 7 + [(1, "é" * 100_000, "a", "x")] * 5 + [(2, "", "", "x")]
    got = sharded(spark, rows, shards=4).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == 13 and max(counts.values()) - min(counts.values()) <= 1
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(None, 16, 0), (1, 200_016, zlib.crc32("é".encode() * 100_000)), (2, 16, 0)}
    assert sharded(spark, rows[:1], shards=4).first().shard == 0
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sharding.interleave(empty).count() == 0


def test_written_shards(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i % 3}") for i in range(90)], "doc_id long, text string, source string")
    path = shared_folder(spark)
    sharding.write_shards(docs, path, shards=3)
    back = spark.read.parquet(path)
    assert {r["shard"]: r["n"] for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {0: 30, 1: 30, 2: 30}
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, f"t{i}") for i in range(90)}


@pytest.mark.parametrize("group", [1 << 21, 16])
def test_ids_are_those_of_a_fresh_tokenizer(monkeypatch, group):
    """Also where a text holds strings of added tokens."""
    end = "<|endoftext|>"
    texts = [*ODD, f"a {end} x", f"a  {end}  x", end, end * 3, f"\n{end}\n", f"{end} lead", f"tail {end}", "<|endoftext| >", f"a <|{end}|> b", f"{'many words ' * 9}{end}{' more words' * 9}", "plain text"]
    library = Tokenizer.from_file(PATH)
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [64, 220, 50256, 2124] in expected
    monkeypatch.setattr(encoding, "GROUP", group)
    for tail in (None, 0):
        got = []
        for ids, sizes in encoding.UnitEncoder(PATH)(pa.array(texts), tail):
            got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [[*e, 0] if tail == 0 else e for e in expected]
