"""Large glossaries stay with the tasks, so that lines and their tokens do not move."""

from pyspark.sql import functions as F

from cueloom.operators import entities as E


def test_a_hundred_thousand_forms_move_no_line(spark):
    n = 100_001
    word = F.concat(F.lit("N"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    forms = spark.range(n).select(F.lit("s").alias("series"), word.alias("form"), F.upper(word).alias("canonical"), F.col("id").alias("form_order"))
    g = E.assign_placeholders(forms).withColumns({"case_sensitive": F.lit(False), "turkish_case_suffixes": F.lit(False)})
    lines = spark.createDataFrame([("s", 1, "Nb and Nbaaaaa, nb"), ("s", 2, "Nbaaaab Xaa"), ("t", 3, "Nb"), (None, 4, "Nb"), ("s", 5, None)], "series string, id int, text string")
    d = E.with_glossary(lines, g)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowUDF" in plan or "ArrowEvalPython" in plan
    assert "Join" not in plan and "Aggregate" not in plan
    got = {r.id: [x.form for x in r["_g"]] for r in d.collect()}
    assert got == {1: ["Nb", "Nbaaaaa"], 2: ["Na"], 3: [], 4: [], 5: []}
