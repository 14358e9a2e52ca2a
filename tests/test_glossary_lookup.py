"""Glossary entries reach the lines alike by lookup and by shuffle; by lookup no line moves."""

import pytest
from pyspark.sql import functions as F

from cueloom.operators import entities as E

pytestmark = pytest.mark.usefixtures("spark")

FORMS = [("s", "Ali", "Ali", 0, True), ("s", "Ayşe", "Ayşe", 1, True), ("s", "Mehmet Bey", "Mehmet", 2, True), ("s", "東京", "Tokyo", 3, False), ("s", "İnci", "İnci", 4, True), ("t", "Ali", "Other", 0, False)]
TEXTS = ["Aliyi gördüm", "ALİ Ayşede", "Mehmet Beyi sor Xaayi", "彼は東京へ", "İnciye inci", "", None, "ali Ali, aLi"]


def glossary(spark):
    g = spark.createDataFrame(FORMS, "series string, form string, canonical string, form_order bigint, turkish_case_suffixes boolean")
    return E.assign_placeholders(g).withColumn("case_sensitive", F.lit(False))


def lines(spark):
    return spark.createDataFrame([(s, i, t) for s in ("s", "t", None) for i, t in enumerate(TEXTS)], "series string, id int, text string")


def test_lookup_and_shuffle_agree(spark, monkeypatch):
    def rows():
        d = E.protected_lines(E.with_glossary(lines(spark), glossary(spark)))
        return sorted(map(repr, d.select("series", "id", "_g", "protected", E.restore("protected").alias("restored")).collect()))

    held = rows()
    monkeypatch.setattr(E, "HELD_TOKENS", 1)
    assert len(held) == 24 and rows() == held


def test_lines_stay_where_they_are(spark):
    plan = E.with_glossary(lines(spark), glossary(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
