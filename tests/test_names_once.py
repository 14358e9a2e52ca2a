"""A line's names are looked for once, however many candidates and names there are."""

from cueloom.operators import entities as E

G = "array<struct<o:bigint,canonical:string,form:string,placeholder:string,exact:boolean,suffixes:boolean>>"


def test_candidates_share_the_names_of_the_source(spark):
    g = [(0, "Ana", "Ana", "Xaa", False, False), (1, "Bo", "Bo", "Xab", False, False), (2, "Ana", "Anna", "Xac", False, False)]
    rows = [(1, "Xaa met Xab and Xaa.", "Ana met him.", "Ana met Bo."), (2, "nobody came here today", "x", "nobody came"), (3, "Xac Xaa", "Ana", ""), (4, "short", "", "b")]
    d = spark.createDataFrame([(*r, g) for r in rows], f"id bigint, protected string, translated string, second string, _g {G}")
    picked = E.prefer_candidate(d, "translated", "second")
    assert picked._jdf.queryExecution().optimizedPlan().toString().count("regexp_count(protected") <= 1
    assert {r.id: r.prefer_second for r in picked.collect()} == {1: True, 2: True, 3: False, 4: False}
    found = {r.id: [tuple(o) for o in r.o] for r in d.select("id", E.occurrences("protected", "translated").alias("o")).collect()}
    assert found == {1: [("Ana", 2, 1), ("Bo", 1, 0)], 2: [], 3: [("Ana", 1, 1)], 4: []}
