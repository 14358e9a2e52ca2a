"""Licence scans, the pipeline, and the registered texts."""

import importlib
import os
import re
import sys
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cueloom.llm import licenses, queries
from cueloom.llm.license_texts import TEXTS

DATA = "/root/testdata/sf0.001"

FILES = [
    ("LICENSE", licenses.STATEMENTS["Apache-2.0"][1] + "; you may not use this file except in compliance"),
    ("a/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("a/b/x.py", "print(1)"),
    ("a/b/c/d/y.py", "# Released under the MIT License.\nprint(2)"),
    ("a/b/c/d/z.py", None),
    ("top.txt", ""),
    ("s/t.c", "/* SPDX-License-Identifier: MPL-2.0 */ int main;"),
    ("s/u.c", "the driver needs a license to drive in most countries of this world and beyond, said the officer"),
    ("s/u.c", "the driver needs a license to drive in most countries of this world and beyond, said the officer"),
    (None, "Licensed under CC BY-NC 4.0."),
    (None, "nothing"),
    ("ab/LICENSE.md", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ab/q.txt", "Licensed under the Apache License, Version 2.0. " + "word " * 20_000),
]


def test_nearest_directory_wins(spark):
    files = spark.createDataFrame([(p, t, "clash") for p, t in FILES], "path string, text string, score string")
    got = licenses.scan(files).collect()
    assert len(got) == len(FILES)
    by = {(r.path, r.own_license): (r.license, r.license_from) for r in got}
    assert by["a/b/x.py", None] == ("GPL-3.0", "a")
    assert by["a/b/c/d/y.py", "MIT"] == ("MIT", "own")
    assert by["a/b/c/d/z.py", None] == ("GPL-3.0", "a")
    assert by["top.txt", None] == ("Apache-2.0", "")
    assert by["s/t.c", "MPL-2.0"] == ("MPL-2.0", "own")
    assert by["s/u.c", None] == ("Apache-2.0", "")
    assert by[None, "CC-BY-NC-4.0"] == ("CC-BY-NC-4.0", "own")
    assert by[None, None] == (None, None)
    assert by["ab/q.txt", "Apache-2.0"] == ("Apache-2.0", "own") and by["ab/LICENSE.md", "0BSD"] == ("0BSD", "own")
    assert licenses.scan(files.where("false")).count() == 0


def test_each_template_names_its_licence(spark):
    rows = [(f"d{k}/f{i}.txt", t) for k, v in licenses.STATEMENTS.items() for i, t in enumerate(v)]
    want = {f"d{k}/f{i}.txt": k for k, v in licenses.STATEMENTS.items() for i, _ in enumerate(v)}
    got = {r.path: r.own_license for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    marked = {p for p, t in rows if __import__("re").search(licenses.MARKER, t)}
    assert {p: got[p] for p in marked} == {p: want[p] for p in marked} and len(marked) > 30


def wrapped(text, sign, width=62):
    lines = textwrap.wrap(text, width)
    return "\n".join(f"{sign} {x}" for x in lines)


def test_headers_and_whole_texts(spark):
    """Wrapped headers behind comment signs, untitled ones too, and whole licence files."""
    rows, want = [], {}
    for k, own in TEXTS.items():
        long = [t for t in own if len(t.split()) > 12 and re.search(licenses.MARKER, t)]
        for i, text in enumerate(long):
            for j, sign in enumerate(("#", "//", " *", "--", "")):
                body = wrapped(text, sign) if sign else textwrap.fill(text, 70)
                rows.append((f"{k}{i}{j}/f.c", f"{'/*' if sign == ' *' else sign}\n{body}\n{' */' if sign == ' *' else ''}\n\nint main() {{ return license; }}\n" if sign else body))
                want[rows[-1][0]] = k
    common = "/usr/share/common-licenses"
    whole = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for name, k in whole.items():
        if os.path.exists(f"{common}/{name}"):
            with open(f"{common}/{name}") as f:
                rows.append((f"w{name}/COPYING", f.read()))
            want[rows[-1][0]] = k
    got = {r.path: r.own_license for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    # the first two GNU sentences and the bare conditions of shared headers are told apart by version and clauses
    assert {p: got[p] for p in want if got[p] != want[p]} == {}
    assert len({k for k in want.values()}) == len(TEXTS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_pipeline_stages(spark):
    """Each stage against plain Python over its own input; the rows that go are those the operator marks."""
    from test_near_duplicates import groups
    from test_rules_and_contamination import brute, measured

    docs = queries.table(spark, DATA, "documents")
    items = [tuple(r) for r in queries.table(spark, DATA, "benchmark").collect()]
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in seen.collect()]
        out = stage(spark, seen, DATA)
        after = {r.doc_id for r in out.collect()}
        if name == "quality_rules":
            short = {d for d, t in before if (m := measured(t))[0] < 50 or 100 * m[4] > 50 * m[0]}
            assert after <= {d for d, _ in before} - short and len(after) > 0.6 * len(before)
        elif name == "language_id":
            assert after == {d for d, _ in before}
        elif name == "near_duplicates":
            assert after == {d for d, (_, c) in groups(before).items() if c == d}
        elif name == "decontamination":
            assert after == {d for d, v in brute(before, items).items() if not v[4]}
        else:
            assert after == {d for d, _ in before} and out.where("NOT round_trip OR size(ids) <> n_tokens").count() == 0
        assert out.columns[: len(docs.columns)] == docs.columns
        seen = spark.createDataFrame(out.select(docs.columns).collect(), docs.schema)
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == {r.doc_id for r in seen.collect()}


def test_pipeline_of_odd_rows(spark):
    docs = queries.table(spark, DATA, "documents").limit(3)
    odd = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    for rows in (docs.where("false"), odd, docs.unionByName(docs)):
        seen = rows
        for _, stage in corpus_pipeline.STAGES:
            seen = stage(spark, seen, DATA)
        assert seen.count() <= rows.count()


def test_registry_without_the_folder(monkeypatch):
    import __spark_entry__

    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in __spark_entry__.queries() if q.startswith("op")}
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    finder = type("Gone", (), {"find_spec": staticmethod(lambda name, path=None, target=None: (_ for _ in ()).throw(ModuleNotFoundError(name=name)) if name == "corpus_pipeline" else None)})
    monkeypatch.setattr(sys, "meta_path", [finder, *sys.meta_path])
    assert not [q for q in importlib.reload(__spark_entry__).queries() if q.startswith("op1")]
