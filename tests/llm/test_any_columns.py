"""Every operator and stage over tables with a column named after each name that the operators use inside."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cueloom.llm import alignment, decontaminate, htmltext, language, lengths, licenses, neardup, quality, sharding, spelling, spm, tokenfile, vectors
from cueloom.llm.common import shared_folder
from cueloom.llm.queries import tokenizer_path

pytestmark = pytest.mark.usefixtures("spark")
DATA = "/root/testdata/sf0.001"
PIECES = tokenizer_path("piece_bpe_32k.model")
#: Columns that the operators are given, and those that they add to a table and replace in it.
GIVEN = {"doc_id", "text", "lang", "source", "n_chars", "path", "vec_id", "embedding", "label", "page_id", "url", "html", "item_id"}
ADDED = {"n_tokens", "ids", "round_trip", "own_license", "own_score", "license", "license_from"}


def inside() -> list[str]:
    names = set()
    for path in glob.glob(os.path.join(os.path.dirname(quality.__file__), "*.py")):
        with open(path) as f:
            names |= {x.lower() for x in re.findall(r"""["']([A-Za-z_][A-Za-z0-9_]{0,30})["']""", f.read())}
    return sorted(names - GIVEN)


def clashing(spark, name, rows=None):
    df = spark.read.parquet(f"{DATA}/{name}.parquet")
    df = df.limit(rows) if rows else df
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(inside()) if c not in df.columns])


def test_tables_keep_their_columns(spark):
    docs = clashing(spark, "documents", 60).cache()
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert len(docs.columns) > 200 and {"_id", "_text", "_words", "score", "_dir", "row", "_row"} <= set(docs.columns)
    values = lambda df: sorted(map(repr, df.select(*[c for c in docs.columns if c not in ADDED]).collect()))
    all_rows = values(docs)
    kept = [
        quality.keep_good(docs), language.keep_known(docs, 0.0), neardup.keep_first(docs), decontaminate.drop_contaminated(docs, bench), decontaminate.remove_spans(docs, bench).drop("text").join(docs.select("doc_id", "text"), "doc_id"),
        spm.encode_merges(docs, PIECES, chunk=500),
    ]
    for out in kept:
        got = values(out)
        assert got and set(got) <= set(all_rows)
    scanned = licenses.scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))
    assert scanned.count() == 60 and scanned.where("`_dir` IS NULL").count() == 0
    measured = quality.measures(docs)
    assert measured.count() == 60 and measured.select("_words").distinct().count() == 1


def test_results_do_not_see_other_columns(spark):
    docs = clashing(spark, "documents", 60).cache()
    plain = docs.select("doc_id", "text", "lang", "source").cache()
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    same = lambda f: sorted(map(repr, f(docs).collect())) == sorted(map(repr, f(plain).collect()))
    assert same(quality.quality) and same(lambda d: decontaminate.scan(d, bench)) and same(neardup.near_duplicates) and same(language.identify)
    assert same(sharding.interleave) and same(lambda d: lengths.suffix_sums(lengths.histogram(d, tokenizer_path())))
    assert same(spelling.variants) and same(lambda d: alignment.align_tokenizers(d, tokenizer_path(), PIECES))
    path = shared_folder(spark)
    tokenfile.write(docs, path, tokenizer_path())
    assert tokenfile.read(spark, path).count() == 60
    rows = clashing(spark, "embeddings", 50)
    assert sorted(vectors.near_vectors(rows).collect()) == sorted(vectors.near_vectors(rows.select("vec_id", "embedding")).collect())
    pages = clashing(spark, "pages", 20)
    assert sorted(map(repr, htmltext.extract(pages).collect())) == sorted(map(repr, htmltext.extract(pages.select("page_id", "url", "html")).collect()))


def test_stages(spark):
    docs = clashing(spark, "documents", 40)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "sentencepiece":
            assert out.columns == docs.columns, name
        assert out.count() > 0, name
        empty = stage(spark, docs.where("false"), DATA)
        assert empty.count() == 0, name
