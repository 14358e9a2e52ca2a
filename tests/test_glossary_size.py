"""Glossaries of any size: codes, protection and restoration."""

import re

import pytest
from pyspark.sql import functions as F

from cueloom.operators import entities as E

pytestmark = pytest.mark.usefixtures("spark")


def numeral(n, letters="bcdfghjklmnpqrstvwxz"):
    out = ""
    while n:
        n, r = divmod(n - 1, len(letters))
        out = letters[r] + out
    return out


def test_codes_grow_without_a_bound_and_stay_apart(spark):
    ids = [*range(3_000), 676 * 420, 676 * 421, 676 * 8_421 + 5, 10**9, 10**12]
    rows = spark.createDataFrame([(i,) for i in ids], "k bigint").select("k", E.placeholder_code(F.col("k")).alias("c")).collect()
    for r in rows:
        assert r.c == "X" + chr(97 + r.k % 676 // 26) + chr(97 + r.k % 26) + numeral(r.k // 676)
    codes = {r.c.lower() for r in rows}
    assert len(codes) == len(ids)
    suffix = re.compile("[aeıioöuü]")
    for c in codes:  # what a longer code has after a shorter one is no case suffix
        for n in range(3, len(c)):
            assert c[:n] not in codes or not suffix.search(c[n:])


def word(i):
    return "N" + "".join(chr(97 + int(d)) for d in str(i)) + "a"


def test_twenty_thousand_forms(spark):
    n = 20_000
    forms = [("s", word(i), word(i), i) for i in range(n)] + [("s", f"{word(3)} {word(4)}", "Pair", n), ("s", "東京", "Tokyo", n + 1), ("s", f"The {word(9)}", "Article", n + 2), ("t", word(1), "Other", 0)]
    g = E.assign_placeholders(spark.createDataFrame(forms, "series string, form string, canonical string, form_order bigint"))
    code = {(r.series, r.form): r.placeholder for r in g.collect()}
    assert len(set(code.values())) == n + 3
    texts = [("s", 1, f"{word(3)} {word(4)}, {word(19_999)}!"), ("s", 1, f"{word(3)} {word(4)}, {word(19_999)}!"), ("s", 2, f"{word(5).upper()} x{word(6)} {word(7)}x"), ("s", 3, "彼は東京へ"), ("s", 4, f"the {word(9)} the"),
             ("t", 5, f"{word(1)} {word(2)}"), ("u", 6, word(1)), ("s", 7, ""), ("s", 8, None), ("s", 9, f"already {code['s', word(15_000)]} here")]
    lines = spark.createDataFrame(texts, "series string, id int, text string")
    flags = g.withColumns({"case_sensitive": F.lit(False), "turkish_case_suffixes": F.lit(False)})
    got = E.protected_lines(E.with_glossary(lines, flags)).select("id", "protected", E.restore("protected").alias("restored"), F.size("_g").alias("n")).collect()
    assert len(got) == len(texts)
    by = {r.id: r for r in got}
    assert by[1].protected == f"{code['s', f'{word(3)} {word(4)}']}, {code['s', word(19_999)]}!"
    assert by[1].restored == f"Pair, {word(19_999)}!"
    assert by[2].protected == f"{code['s', word(5)]} x{word(6)} {word(7)}x" and by[2].restored.startswith(word(5))
    assert by[3].protected == f"彼は{code['s', '東京']}へ" and by[3].restored == "彼はTokyoへ"
    assert by[4].protected == f"{code['s', f'The {word(9)}']} the"
    assert by[5].protected == f"{code['t', word(1)]} {word(2)}" and by[6].protected == word(1)
    assert by[7].n == by[8].n == 0
    assert by[9].restored == f"already {word(15_000)} here"


def test_suffixes_behind_names_and_codes(spark):
    forms = [("s", "Ali", "Ali", 0), ("s", "Ayşe", "Ayşe", 1), ("s", "Mehmet Bey", "Mehmet", 2)]
    g = E.assign_placeholders(spark.createDataFrame(forms, "series string, form string, canonical string, form_order bigint")).withColumns({"case_sensitive": F.lit(False), "turkish_case_suffixes": F.lit(True)})
    texts = ["Aliyi gördüm", "Alini evi", "Aliler", "Ayşede", "Mehmet Beyi sor", "Xaayi gel"]
    lines = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "series string, id int, text string")
    got = {r.id: (r.protected, r.restored) for r in E.protected_lines(E.with_glossary(lines, g)).select("id", "protected", E.restore("protected").alias("restored")).collect()}
    assert got[0] == ("Xaayi gördüm", "Aliyi gördüm") and got[1] == ("Xaani evi", "Alini evi") and got[2][0] == "Aliler"
    assert got[3] == ("Xabde", "Ayşede") and got[4][1] == "Mehmeti sor" and got[5][1] == "Aliyi gel"


def test_repair_takes_codes_of_the_same_length(spark):
    d = spark.createDataFrame([("Xaab gone", "Xaa came"), ("Xaac gone", "Xaab came"), ("Xab gone", "Xaa came")], "candidate string, source string")
    assert [r[0] for r in d.select(E.repair_placeholders(F.col("candidate"), F.col("source"))).collect()] == ["Xaab gone", "Xaab gone", "Xaa gone"]
