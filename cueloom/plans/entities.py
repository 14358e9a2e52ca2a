"""E rows (and the rows that need a glossary): names, mining, cast."""

from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.functions.sequence import once
from cueloom.operators import cast as K
from cueloom.operators import entities as E
from cueloom.operators import mining as M
from cueloom.operators import qc as Q
from cueloom.plans.registry import query
from cueloom.session import cut_lineage


def order_of(c):
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")


def glossary(fx):
    g = fx.names.select("series", F.col("canonical").alias("form"), "canonical", order_of("canonical").alias("form_order"))
    return E.assign_placeholders(g).withColumns({"case_sensitive": F.lit(False), "turkish_case_suffixes": F.lit(False)})


#: Tails of base 20 up to three places: 5.7 million forms per series.
TAILS = "CASE WHEN k >= 676 * 421 THEN substr(c, ((k // 676 - 421) // 400 % 20 + 1)::INT, 1) ELSE '' END || CASE WHEN k >= 676 * 21 THEN substr(c, ((k // 676 - 21) // 20 % 20 + 1)::INT, 1) ELSE '' END || CASE WHEN k >= 676 THEN substr(c, ((k // 676 - 1) % 20 + 1)::INT, 1) ELSE '' END"
GLOS = f"gl AS (SELECT series, canonical, o AS form_order, 'X' || chr((97 + k % 676 // 26)::INT) || chr((97 + k % 26)::INT) || {TAILS} AS placeholder FROM (SELECT 'bcdfghjklmnpqrstvwxz' AS c), (SELECT *, row_number() OVER (PARTITION BY series ORDER BY o) - 1 AS k FROM (SELECT *, ('0x' || substr(md5(canonical), 1, 15))::BIGINT AS o FROM fx_names)))"


def lines(fx):
    """Protected cues and a translation that lost every third word."""
    w = F.split("text", " ")
    d = fx.cues.select(F.col("lang").alias("series"), "media_id", "cue_idx", "text", F.array_join(F.filter(w, lambda x, i: i % 3 != 0), " ").alias("translated"), F.array_join(F.filter(w, lambda x, i: i % 3 != 1), " ").alias("second"))
    return E.protected_lines(E.with_glossary(d, glossary(fx)))


LINES = GLOS + r""",
ln AS (SELECT lang AS series, media_id, cue_idx, text, array_to_string(list_filter(string_split(text, ' '), lambda x, i: (i - 1) % 3 <> 0), ' ') AS translated,
  array_to_string(list_filter(string_split(text, ' '), lambda x, i: (i - 1) % 3 <> 1), ' ') AS second FROM fx_cues),
el AS (SELECT series, media_id, cue_idx, unnest(e) AS e, unnest(range(len(e))) AS p FROM (SELECT *, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS e FROM ln)),
et AS (SELECT series, media_id, cue_idx, unnest(regexp_extract_all(translated, '[A-Za-z0-9_]+')) AS e FROM ln),
e2 AS (SELECT series, media_id, cue_idx, unnest(regexp_extract_all(second, '[A-Za-z0-9_]+')) AS e FROM ln),
hit AS (SELECT el.*, g.canonical, g.placeholder, g.form_order FROM el LEFT JOIN gl g ON g.series = el.series AND lower(g.canonical) = lower(el.e)),
pr AS (SELECT media_id, cue_idx, string_agg(coalesce(placeholder, e), '' ORDER BY p) AS protected, string_agg(coalesce(canonical, e), '' ORDER BY p) AS restored FROM hit GROUP BY 1, 2),
sc AS (SELECT media_id, cue_idx, canonical, min(form_order) AS form_order, count(*) AS source_count FROM hit WHERE canonical IS NOT NULL GROUP BY 1, 2, 3),
tc AS (SELECT media_id, cue_idx, canonical, count(*) AS n FROM et JOIN gl g ON g.series = et.series AND lower(g.canonical) = lower(et.e) GROUP BY 1, 2, 3),
t2 AS (SELECT media_id, cue_idx, canonical, count(*) AS n FROM e2 JOIN gl g ON g.series = e2.series AND lower(g.canonical) = lower(e2.e) GROUP BY 1, 2, 3),
oc AS (SELECT sc.*, coalesce(tc.n, 0) AS target_count, coalesce(t2.n, 0) AS second_count FROM sc LEFT JOIN tc USING (media_id, cue_idx, canonical) LEFT JOIN t2 USING (media_id, cue_idx, canonical))"""


def entity_table(fx):
    """Glossary entries: a global layer and a series layer that overrides every third name."""
    k = order_of("canonical") % 7
    one = fx.names.groupBy("canonical").agg(F.sum("n").alias("n"))
    base = one.select(F.lit(None).cast("int").alias("series"), F.lit(1).alias("layer"), "canonical", (k != 0).alias("protected"), F.lit(None).cast("array<string>").alias("episodes"))
    scope = F.when(k == 3, F.array(F.lit("S01E02-E05"))).when(k == 4, F.array(F.lit("S02E01"), F.lit("s1e4"))).when(k == 5, F.array(F.lit("S1E3-S2E4"))).otherwise(F.lit(None).cast("array<string>"))
    own = one.where(k >= 3).select(F.lit(7).alias("series"), F.lit(2).alias("layer"), "canonical", F.lit(True).alias("protected"), scope.alias("episodes"))
    return base.unionByName(own)


@query("e1_load_profile", """SELECT canonical, k >= 3 AS own FROM (SELECT canonical, ('0x' || substr(md5(canonical), 1, 15))::BIGINT % 7 AS k FROM fx_names GROUP BY canonical) WHERE k IN (1, 2, 3, 4, 6)""")
def _(fx):
    return E.load_profile(entity_table(fx), 7, 1, 4).select("canonical", F.col("series").isNotNull().alias("own"))


@query("e2_in_scope", """SELECT id, CASE id % 5 WHEN 0 THEN true WHEN 1 THEN s = 1 AND e BETWEEN 2 AND 5 WHEN 2 THEN (s = 2 AND e = 1) OR (s = 1 AND e = 4) ELSE false END AS here
FROM (SELECT id, id % 3 AS s, id % 11 AS e FROM fx_jobs)""")
def _(fx):
    k = F.col("id")
    scope = F.when(k % 5 == 1, F.array(F.lit("S01E02-E05"))).when(k % 5 == 2, F.array(F.lit("S02E01"), F.lit(" s1e4 "))).when(k % 5 == 3, F.array(F.lit("S1E3-S2E4"), F.lit("typo"))).when(k % 5 == 4, F.array().cast("array<string>"))
    return fx.jobs.select("id", E.in_scope(scope, k % 3, k % 11).alias("here"))


@query("e3_placeholders", f"WITH {GLOS} SELECT series, canonical, placeholder FROM gl")
def _(fx):
    return glossary(fx).select("series", "canonical", "placeholder")


@query("e4_protect", f"WITH {LINES} SELECT media_id, cue_idx, protected FROM pr")
def _(fx):
    return lines(fx).select("media_id", "cue_idx", "protected")


@query("e5_restore", f"WITH {LINES} SELECT media_id, cue_idx, restored FROM pr")
def _(fx):
    return lines(fx).select("media_id", "cue_idx", E.restore("protected").alias("restored"))


@query("e6_repair_placeholders")
def _(fx):
    d = lines(fx)
    broken = F.regexp_replace("protected", "X([a-z])[a-z](?![A-Za-z0-9_])", "X$1z")
    return d.select("media_id", "cue_idx", E.repair_placeholders(broken, F.col("protected")).alias("repaired"))


@query("e7_bare_entity", rf"""WITH {GLOS}, el AS (SELECT lang AS series, media_id, word_idx, text, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')) AS e, unnest(range(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')))) AS p FROM fx_words)
SELECT el.media_id, el.word_idx, string_agg(coalesce(g.canonical, el.e), '' ORDER BY p) AS bare FROM el LEFT JOIN gl g ON g.series = el.series AND lower(g.canonical) = lower(el.e)
GROUP BY 1, 2 HAVING bool_or(g.canonical IS NOT NULL) AND bool_and(g.canonical IS NOT NULL OR NOT regexp_matches(el.e, '[\pL\pN_]'))""")
def _(fx):
    d = E.protected_lines(E.with_glossary(fx.words.withColumnRenamed("lang", "series"), glossary(fx)))
    return d.select("media_id", "word_idx", E.bare_entity().alias("bare")).where("bare IS NOT NULL")


@query("e8_occurrences", f"WITH {LINES} SELECT media_id, cue_idx, canonical, source_count, target_count FROM oc")
def _(fx):
    return E.entity_occurrences(lines(fx), ["media_id", "cue_idx"])


@query("f4_qc_entity", f"""WITH {LINES} SELECT media_id, cue_idx AS "index", '''' || canonical || ''' occurs ' || source_count || 'x in source, ' || target_count || 'x in translation' AS reason FROM oc WHERE source_count > target_count""")
def _(fx):
    return Q.qc_entity(E.entity_occurrences(lines(fx), ["media_id", "cue_idx"]), idx="cue_idx").select("media_id", "index", "reason")


@query("e9_recover_entities", rf"""WITH {LINES}, ad AS (SELECT media_id, cue_idx, canonical, form_order, source_count - target_count AS m FROM oc WHERE source_count > target_count),
tl AS (SELECT ln.media_id, ln.cue_idx, ln.translated, regexp_extract(rtrim(ln.text), '[.!?]$') AS tail FROM ln),
fr AS (SELECT ad.media_id, ad.cue_idx, string_agg(rtrim(repeat(canonical || tail || ' ', m)), ' ' ORDER BY form_order DESC) AS front FROM ad JOIN tl USING (media_id, cue_idx) GROUP BY 1, 2)
SELECT media_id, cue_idx, CASE WHEN front IS NULL THEN translated WHEN trim(translated) = '' THEN front ELSE trim(front || ' ' || translated) END AS recovered FROM tl LEFT JOIN fr USING (media_id, cue_idx)""")
def _(fx):
    return lines(fx).select("media_id", "cue_idx", E.recover_entities().alias("recovered"))


@query("d23_prefer_candidate", f"""WITH {LINES}, m AS (SELECT media_id, cue_idx, sum(greatest(source_count - target_count, 0)) AS a, sum(greatest(source_count - second_count, 0)) AS b FROM oc GROUP BY 1, 2)
SELECT ln.media_id, ln.cue_idx, CASE WHEN m.a IS NOT NULL THEN m.b < m.a ELSE length(protected) >= 15 AND length(translated) * 4 < length(protected) AND NOT (length(second) * 4 < length(protected)) END AS prefer_second
FROM ln JOIN pr USING (media_id, cue_idx) LEFT JOIN m USING (media_id, cue_idx)""")
def _(fx):
    return E.prefer_candidate(lines(fx), "translated", "second").select("media_id", "cue_idx", "prefer_second")


KEYED = "replace(lower(rtrim(trim({0}), '.!?')), 'ß', 'ss')"


@query("e10_apply_phrases", f"""WITH p AS (SELECT lower(canonical) AS k, max(series) AS l, upper(canonical) AS t FROM fx_names GROUP BY canonical)
SELECT w.media_id, w.word_idx, CASE WHEN length(p.t) % 2 = 0 OR p.l = w.lang THEN p.t END AS phrase_translation FROM fx_words w LEFT JOIN p ON p.k = {KEYED.format('w.text')}""")
def _(fx):
    n = fx.names.groupBy("canonical").agg(F.max("series").alias("l"))
    p = n.select(F.lit(None).cast("int").alias("series"), F.lit(1).alias("layer"), F.concat("canonical", F.lit(".")).alias("source"), F.upper("canonical").alias("translation"), F.when(F.length("canonical") % 2 == 1, F.col("l")).alias("language"))
    return E.apply_phrases(fx.words, E.latest_phrases(p, None)).select("media_id", "word_idx", "phrase_translation")


def scoped_names(fx):
    k = F.col("n") % 3
    scope = F.when(k == 0, F.array(F.lit("S01E01-E03"))).when(k == 1, F.array(F.lit("S02E01")))
    forms = fx.names.select("series", F.concat("canonical", F.lit(" van "), F.initcap("series")).alias("form"), scope.alias("episodes"))
    return E.episode_names(forms, F.lit(1), F.lit(2))


@query("e11_episode_names", "SELECT series, canonical AS name, bool_or(n % 3 <> 1) AS here FROM fx_names GROUP BY 1, 2")
def _(fx):
    return scoped_names(fx)


FOLD = "strip_accents(replace(lower({0}), 'ß', 'ss'))"


@query("e12_series_vocabulary", rf"""SELECT series, {FOLD.format('t')} AS folded, count(*) AS n FROM (SELECT w.lang AS series, unnest(regexp_extract_all(w.text, '\pL+')) AS t FROM fx_words w JOIN fx_segments s ON s.media_id = w.media_id AND s.seg_idx = w.word_idx // 20
 WHERE s.no_speech_pct < 80 AND w.media_id <> 3) WHERE regexp_matches(t, '^\p{{Ll}}') GROUP BY 1, 2""")
def _(fx):
    from cueloom.operators.prepare import live_words

    segs = fx.segments.select("media_id", "seg_idx", (F.col("no_speech_pct") >= 80).alias("suppressed"))
    w = live_words(fx.words.withColumn("seg_idx", F.floor(F.col("word_idx") / 20)), segs)
    return E.series_vocabulary(w.where("media_id <> 3").select(F.col("lang").alias("series"), "text"))


CASING = rf"""nb AS (SELECT media_id, word_idx, lang AS series, text, regexp_extract(text, '^([^\pL\pN_]*)(\pL+)([''’]\pL+)?([^\pL\pN_]*)$', 2) AS b FROM fx_words),
cp AS (SELECT series, {FOLD.format('b')} AS folded, count(*) FILTER (regexp_matches(b, '^\p{{Ll}}')) AS lower, count(*) FILTER (NOT regexp_matches(b, '^\p{{Ll}}')) AS upper FROM nb WHERE b <> '' GROUP BY 1, 2)"""


@query("e13_casing_profile", f"WITH {CASING} SELECT series, folded, lower, upper, lower > 0 AND lower >= upper AS ordinary FROM cp")
def _(fx):
    return E.casing_profile(fx.words.select(F.col("lang").alias("series"), "text"))


@query("e14_repair_names", rf"""WITH {CASING}, nm AS (SELECT series, canonical AS name, {FOLD.format('canonical')} AS nf, n % 2 = 0 AS here FROM fx_names),
c AS (SELECT DISTINCT series, b, {FOLD.format('b')} AS f FROM nb WHERE length(b) >= 4 AND regexp_matches(b, '^\p{{Lu}}')),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.series = c.series AND nm.nf = c.f) AND NOT EXISTS (SELECT 1 FROM cp WHERE cp.series = c.series AND cp.folded = c.f AND cp.lower > 0 AND cp.lower >= cp.upper)),
fx1 AS (SELECT k.series, k.b, min(nm.name) AS name FROM k JOIN nm ON nm.series = k.series AND nm.here AND abs(length(nm.nf) - length(k.f)) <= 1 AND levenshtein(nm.nf, k.f) = 1 GROUP BY 1, 2 HAVING count(DISTINCT nm.name) = 1)
SELECT nb.media_id, nb.word_idx, replace(nb.text, nb.b, fx1.name) AS corrected FROM nb JOIN fx1 ON fx1.series = nb.series AND fx1.b = nb.b""")
def _(fx):
    w = fx.words.select("media_id", "word_idx", F.col("lang").alias("series"), "text")
    names = cut_lineage(fx.names.select("series", F.col("canonical").alias("name"), (F.col("n") % 2 == 0).alias("here")))
    return E.repair_names(w, names, E.casing_profile(w)).where("confidence IS NOT NULL").select("media_id", "word_idx", "corrected")


# ---------------------------------------------------------------- mining

def series_cues(fx):
    return fx.cues.withColumnRenamed("lang", "series")


STRIPSQL = "trim({0}, '.,!?;:\"''’()[]{{}}—–')"
MS = "('" + "','".join(M.STOP_MS) + "')"
MINE = rf"""cw AS (SELECT c.lang AS series, c.media_id, c.cue_idx, unnest(string_split(c.text, ' ')) AS raw, unnest(range(len(string_split(c.text, ' ')))) AS p FROM fx_cues c),
ct AS (SELECT *, {STRIPSQL.format('raw')} AS t FROM cw),
nz AS (SELECT media_id, cue_idx, count(*) FILTER (t <> '') >= 4 AND count(*) FILTER (t <> '' AND NOT regexp_matches(t, '^\p{{Lu}}')) = 0 AS noise FROM ct GROUP BY 1, 2),
sg AS (SELECT ct.series, ct.media_id, ct.t AS token, ct.p = 0 AS initial FROM ct JOIN nz USING (media_id, cue_idx) WHERE NOT noise AND regexp_matches(ct.t, '^[A-Z][a-z]+$') AND ct.t NOT IN {MS})"""


@query("e15_mine_names", f"""WITH {MINE}, pe AS (SELECT series, media_id, token, count(*) AS n, bool_or(NOT initial) AS ins FROM sg WHERE media_id IN (SELECT doc_id FROM labels)
  AND (series, lower(token)) NOT IN (SELECT (series, lower(canonical)) FROM fx_names WHERE n % 3 = 0) GROUP BY 1, 2, 3),
c AS (SELECT series, token, sum(n) FILTER (n >= 3)::BIGINT AS total, count(*) FILTER (n >= 3) AS episodes, bool_or(ins) AS ok FROM pe GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY total DESC, token) AS rank FROM c WHERE ok AND total IS NOT NULL) SELECT series, token, total, episodes, rank FROM r WHERE rank <= 30""")
def _(fx):
    sib = fx.table("labels").select(F.col("doc_id").alias("media_id")).distinct()
    return M.mine_names(series_cues(fx), M.miners()["ms"], with_sibling=sib, exclude=fx.names.where("n % 3 = 0").select("series", "canonical"))


@query("e16_latin_tokens", f"WITH {MINE} SELECT series, token, count(*) AS n, count(*) FILTER (initial) AS initial FROM sg GROUP BY 1, 2")
def _(fx):
    t = M.candidate_tokens(series_cues(fx), M.miners()["ms"], ["series"])
    return t.groupBy("series", "token").agg(F.count("*").alias("n"), F.count_if("initial").alias("initial"))


LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = {"ja": "アイウエオカキクケコサシスセソタチツテトナニヌネノハ", "ko": "가나다라마바사아자차카타파하거너더러머버서어저처커터", "zh": "天地人你我他日月水火木金土山川田石心手口目耳足雨云风"}


def scripted(fx, lang):
    """The given texts with Latin letters mapped to another script."""
    return series_cues(fx).withColumn("text", F.translate(F.lower("text"), LATIN, SCRIPTS[lang]))


def script_sql(lang):
    return f"translate(lower(text), '{LATIN}', '{SCRIPTS[lang]}')"


def _stop(words):
    return "('" + "','".join(words) + "')"


@query("e17_katakana_tokens", f"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace({script_sql('ja')}, '^[（(][ｦ-ﾝァ-ヺー]+[)）]', ''), '[ァ-ヺー]{{2,}}')) AS token FROM fx_cues) WHERE token NOT IN {_stop(M.STOP_JA)} GROUP BY 1""")
def _(fx):
    return M.candidate_tokens(scripted(fx, "ja"), M.miners()["ja"], []).groupBy("token").agg(F.count("*").alias("n"))


PART = "|".join(M.KO_PARTICLES)


@query("e18_hangul_tokens", f"""WITH t AS (SELECT {STRIPSQL.format('unnest(string_split(' + script_sql('ko') + ", ' '))")} AS t FROM fx_cues), s AS (SELECT t, regexp_extract(t, '({PART})$') AS p FROM t),
k AS (SELECT CASE WHEN p <> '' AND length(t) > length(p) + 1 THEN substr(t, 1, length(t) - length(p)) ELSE t END AS token FROM s)
SELECT token, count(*) AS n FROM k WHERE regexp_matches(token, '^[가-힣]{{2,4}}$') GROUP BY 1""")
def _(fx):
    return M.candidate_tokens(scripted(fx, "ko"), M.miners()["ko"], []).groupBy("token").agg(F.count("*").alias("n"))


ZH = f"""zr AS (SELECT lang AS series, media_id, unnest(regexp_extract_all({script_sql('zh')}, '[一-鿿]+')) AS r FROM fx_cues),
zg AS (SELECT series, media_id, substr(r, i::BIGINT, n) AS token FROM (SELECT *, unnest(range(1, length(r) - n + 2)) AS i FROM zr, (VALUES (2), (3), (4)) v(n)) WHERE substr(r, i::BIGINT, n) NOT IN {_stop(M.STOP_ZH)}),
zc AS (SELECT series, token, sum(n)::BIGINT AS total FROM (SELECT series, media_id, token, count(*) AS n FROM zg GROUP BY 1, 2, 3 HAVING count(*) >= 3) GROUP BY 1, 2)"""


@query("e19_hanzi_grams", f"WITH {ZH} SELECT token, count(*) AS n FROM zg GROUP BY 1")
def _(fx):
    return M.candidate_tokens(scripted(fx, "zh"), M.miners()["zh"], []).groupBy("token").agg(F.count("*").alias("n"))


@query("e20_collapse_substrings", f"""WITH {ZH}, k4 AS (SELECT * FROM zc WHERE length(token) = 4),
k3 AS (SELECT * FROM zc c WHERE length(token) = 3 AND NOT EXISTS (SELECT 1 FROM (SELECT series, substr(token, 1, 3) AS s, total FROM k4 UNION ALL SELECT series, substr(token, 2, 3), total FROM k4) l WHERE l.series = c.series AND l.s = c.token AND c.total <= 1.1 * l.total)),
l2 AS (SELECT series, unnest([substr(token, 1, 2), substr(token, 2, 2), substr(token, 3, 2)]) AS s, total FROM k4 UNION ALL SELECT series, unnest([substr(token, 1, 2), substr(token, 2, 2)]), total FROM k3),
k2 AS (SELECT * FROM zc c WHERE length(token) = 2 AND NOT EXISTS (SELECT 1 FROM l2 l WHERE l.series = c.series AND l.s = c.token AND c.total <= 1.1 * l.total))
SELECT series, token, total FROM k4 UNION ALL SELECT series, token, total FROM k3 UNION ALL SELECT series, token, total FROM k2""")
def _(fx):
    t = M.candidate_tokens(scripted(fx, "zh"), M.miners()["zh"], ["series", "media_id"])
    per = t.groupBy("series", "media_id", "token").agg(F.count("*").alias("n")).where("n >= 3")
    return M.collapse_substrings(per.groupBy("series", "token").agg(F.sum("n").alias("total"))).select("series", "token", "total")


@query("e21_title_case_cues", f"WITH {MINE} SELECT media_id, cue_idx FROM nz WHERE noise")
def _(fx):
    return fx.cues.where(M.is_title_case("text")).select("media_id", "cue_idx")


@query("e22_mining_language", "SELECT source AS series, CASE min(CASE lang WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 END) WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS lang FROM documents WHERE lang <> 'en' GROUP BY 1")
def _(fx):
    return M.detect_mining_language(fx.table("documents").select(F.col("source").alias("series"), "lang"), ["de", "fr", "es"])


@query("e23_suggestions", "SELECT series, canonical, n AS occurrences, false AS protected FROM fx_names")
def _(fx):
    c = fx.names.select("series", F.col("canonical").alias("token"), F.col("n").alias("total"), F.lit(1).alias("episodes"))
    return M.suggestions(c).select("series", "canonical", "occurrences", "protected")


def changes(fx):
    k = F.col("n") % 6
    action = F.when(k.isin(0, 1), "promote").when(k == 2, "edit").when(k == 3, "delete")
    both = fx.names.select("series", "canonical", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("fresh"))
    name = F.when(F.col("fresh"), F.concat("canonical", F.lit("ova"))).otherwise(F.col("canonical"))
    base = fx.names.select("series", "canonical", F.array(F.lower("canonical")).alias("aliases"), (F.col("n") % 2 == 1).alias("protected"))
    ch = both.where(action.isNotNull()).select("series", name.alias("canonical"), action.alias("action"), F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("zed"))).alias("aliases"))
    return base, ch


CH = """b AS (SELECT series, canonical, n % 6 AS k, lower(canonical) AS al, n % 2 = 1 AS p FROM fx_names)"""


@query("e24_upsert_entities", f"""WITH {CH} SELECT series, canonical, CASE k WHEN 1 THEN al || ',zed' WHEN 2 THEN 'zed' ELSE al END AS aliases, CASE WHEN k IN (0, 1) THEN true ELSE p END AS protected FROM b WHERE k <> 3
UNION ALL SELECT series, canonical || 'ova', CASE WHEN k = 1 THEN 'zed' ELSE '' END, true FROM b WHERE k IN (0, 1)""")
def _(fx):
    return E.upsert_entities(*changes(fx)).withColumn("aliases", F.array_join("aliases", ","))


@query("e24_rejected_changes", f"WITH {CH} SELECT series, canonical || 'ova' AS canonical, CASE k WHEN 2 THEN 'edit' ELSE 'delete' END AS action FROM b WHERE k IN (2, 3)")
def _(fx):
    return E.rejected_changes(*changes(fx))


# ---------------------------------------------------------------- cast

def credits(fx):
    """Character credits from segment words, in the shapes real credits take."""
    s = fx._runs(20, "seg_idx")
    w = F.transform(F.slice(F.split("text", " "), 1, 3), lambda x: F.concat(F.lit("Q"), F.regexp_replace(x, "[^A-Za-z]", "")))
    a = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("Qo"))
    h = (F.col("media_id") * 3 + F.col("seg_idx") * 7) % 8
    raw = (
        F.when(h == 0, F.concat(F.lit("Dr. "), a(0), F.lit(" "), a(1))).when(h == 1, F.concat(a(0), F.lit(' "'), a(1), F.lit('" '), a(2))).when(h == 2, F.concat(a(0), F.lit(" (voice)")))
        .when(h == 3, F.concat(a(0), F.lit(" "), a(1), F.lit(" / "), a(2))).when(h == 4, F.lit("Self")).when(h == 5, F.concat(a(0), F.lit(" Hanım"))).when(h == 6, F.concat(a(0), F.lit(" ("), a(1), F.lit(")"))).otherwise(a(0))
    )
    s = s.withColumn("w", w)
    return s.select(
        "media_id", "seg_idx", F.col("lang").alias("series"), raw.alias("character"), F.when(F.col("seg_idx") % 2 == 0, "tmdb").otherwise("tvdb").alias("source"),
        (F.col("media_id") % 3 + 1).alias("season"), F.when(h != 7, F.col("media_id") % 15 + 1).alias("episode"))


CRED = r"""cw0 AS (SELECT media_id, seg_idx, lang AS series, list_transform(string_split(text, ' '), lambda x: 'Q' || regexp_replace(x, '[^A-Za-z]', '', 'g')) AS w, (media_id*3 + seg_idx*7) % 8 AS h FROM fx_segments),
cr AS (SELECT media_id, seg_idx, series, h, coalesce(w[1], 'Qo') AS a, coalesce(w[2], 'Qo') AS b, coalesce(w[3], 'Qo') AS c, CASE WHEN seg_idx % 2 = 0 THEN 'tmdb' ELSE 'tvdb' END AS source, media_id % 3 + 1 AS season, CASE WHEN h <> 7 THEN media_id % 15 + 1 END AS episode FROM cw0 WHERE h <> 4),
cp AS (SELECT *, a AS given, CASE h WHEN 0 THEN a || ' ' || b WHEN 1 THEN a || ' ' || c WHEN 3 THEN a || ' ' || b ELSE a END AS full_name, CASE WHEN h IN (1, 6) THEN b END AS nick FROM cr)"""


@query("e25_parse_credits", f"WITH {CRED} SELECT media_id, seg_idx, given, full_name, coalesce(nick, '') AS nicknames FROM cp")
def _(fx):
    return K.parse_credits(credits(fx)).select("media_id", "seg_idx", "given", "full_name", F.array_join("nicknames", ",").alias("nicknames"))


CAST = CRED + """, sp AS (SELECT series, lower(given) AS member, given, count(*) AS n FROM cp GROUP BY 1, 2, 3),
sh AS (SELECT series, member, given FROM (SELECT *, row_number() OVER (PARTITION BY series, member ORDER BY n DESC, given) AS r FROM sp) WHERE r = 1),
mb AS (SELECT series, lower(given) AS member, count(DISTINCT CASE WHEN full_name <> given THEN full_name END) AS full_names, count(DISTINCT source) AS sources, count(DISTINCT CASE WHEN episode IS NOT NULL THEN season * 1000 + episode END) AS episodes,
  count(DISTINCT CASE WHEN lower(nick) <> lower(given) THEN nick END) AS nicknames, bool_or(episode IS NULL) AS series_level FROM cp GROUP BY 1, 2)"""


@query("e26_build_cast", f"WITH {CAST} SELECT mb.series, mb.member, sh.given, full_names, sources, episodes, nicknames, series_level FROM mb JOIN sh USING (series, member)")
def _(fx):
    c = K.build_cast(K.parse_credits(credits(fx)))
    n = lambda x: F.size(x).cast("bigint").alias(x)
    return c.select("series", "member", "given", n("full_names"), n("sources"), n("episodes"), n("nicknames"), "series_level")


@query("e27_scope_for", f"""WITH {CAST}, kn AS (SELECT series, season, max(episode) AS le FROM cp WHERE episode IS NOT NULL GROUP BY 1, 2), tt AS (SELECT series, sum(le) AS t FROM kn GROUP BY 1),
pe AS (SELECT series, lower(given) AS member, season, min(episode) AS lo, max(episode) AS hi FROM cp WHERE episode IS NOT NULL GROUP BY 1, 2, 3),
ss AS (SELECT pe.series, pe.member, string_agg('S0' || pe.season || 'E' || lpad(lo::VARCHAR, 2, '0') || '-E' || lpad(least(hi + 3, le)::VARCHAR, 2, '0'), ',' ORDER BY pe.season) AS scope FROM pe JOIN kn USING (series, season) GROUP BY 1, 2)
SELECT mb.series, mb.member, CASE WHEN (series_level AND episodes = 0) OR 100 * episodes >= 60 * t THEN NULL ELSE coalesce(scope, '') END AS scope FROM mb JOIN tt USING (series) LEFT JOIN ss USING (series, member)""")
def _(fx):
    p = cut_lineage(K.parse_credits(credits(fx)).drop("media_id", "seg_idx", "character"))
    known = p.where("episode IS NOT NULL").groupBy("series", "season").agg(F.max("episode").alias("last_episode"))
    s = K.scope_for(K.build_cast(p), known)
    return s.select("series", "member", F.when(F.col("scope").isNotNull(), F.array_join("scope", ",")).alias("scope"))


def name_hits(fx):
    """Lines that use a glossary name as a name; candidates meet on the name token."""
    c = series_cues(fx).withColumn("form", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))))
    names = cut_lineage(fx.names.select("series", F.col("canonical").alias("form")))
    # up to a counted size names go to the lines, so that no line moves once per token
    j = c.join(F.broadcast(names) if names.count() <= E.HELD_NAMES else names, ["series", "form"])
    # evaluated behind the join: as a plain filter it moves in front of it and sees every word of every line
    shaped = j.select("series", F.col("form").alias("member"), "media_id", "cue_idx", once(K.name_shaped("text", "form")).alias("_shaped"))
    return shaped.where("_shaped").drop("_shaped")


L = K.LETTER
HITS = rf"""nc AS (SELECT DISTINCT lang AS series, media_id, cue_idx, text, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS f FROM fx_cues),
nh AS (SELECT nc.series, nc.f AS member, media_id, cue_idx FROM nc JOIN fx_names n ON n.series = nc.series AND n.canonical = nc.f
 WHERE regexp_matches(replace(text, f, chr(1)), '(^|[^{L}])\x01([''’]\pL|[,!?])') OR regexp_matches(replace(text, f, chr(1)), '(?s)([^.!?…"“”\-–—:\s{L}]|[^.!?…"“”\-–—:\s]\s+)\x01($|[^{L}])'))"""


@query("e28_name_shaped", f"WITH {HITS} SELECT series, member, media_id, cue_idx FROM nh")
def _(fx):
    return name_hits(fx)


@query("e29_evidence_gate", f"""WITH {HITS}, g AS (SELECT series, member, count(*) AS l, count(DISTINCT media_id) AS e FROM nh GROUP BY 1, 2)
SELECT n.series, n.canonical AS member, coalesce(l, 0) AS name_lines, coalesce(e, 0) AS name_episodes, CASE WHEN n.n % 7 = 0 OR coalesce(l, 0) < 5 OR coalesce(e, 0) < 20 THEN 'skip' END AS decision, n.n % 7 = 0 AND n.n % 2 = 0 AS scope_flag
FROM fx_names n LEFT JOIN g ON g.series = n.series AND g.member = n.canonical""")
def _(fx):
    m = fx.names.select("series", F.col("canonical").alias("member"), (F.col("n") % 7 == 0).alias("person_entry"), (F.col("n") % 2 == 0).alias("entry_everywhere"), F.array(F.lit("S01E01")).alias("scope"))
    g = K.evidence_gate(name_hits(fx), m, min_episodes=20)
    return g.select("series", "member", "name_lines", "name_episodes", "decision", "scope_flag")


@query("e30_probe_verdict", f"""WITH {HITS}, p AS (SELECT series, member, (media_id * 7 + cue_idx) % 5 = 0 AS lost FROM nh), v AS (SELECT series, member, count(*) AS total, count(*) FILTER (lost) AS lost FROM p GROUP BY 1, 2)
SELECT series, member, total, lost, CASE WHEN lost >= 2 AND 100 * lost >= 10 * total THEN 'protect' ELSE 'skip' END AS decision FROM v""")
def _(fx):
    h = name_hits(fx)
    out = F.when((F.col("media_id") * 7 + F.col("cue_idx")) % 5 == 0, F.concat(F.lit("x"), F.col("member"), F.lit("y"))).otherwise(F.concat(F.lit("Ah, "), F.upper("member"), F.lit("!")))
    return K.probe_verdict(h.select("series", "member", F.concat_ws("-", "media_id", "cue_idx").alias("line_id"), out.alias("translation"), F.col("member").alias("form")))


@query("e31_even_sample", """WITH d AS (SELECT DISTINCT lang AS series, media_id AS line FROM fx_cues), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY line) - 1 AS r, count(*) OVER (PARTITION BY series) AS n FROM d),
p AS (SELECT series, n, unnest(range(30)) * n // 30 AS p FROM (SELECT DISTINCT series, n FROM r)) SELECT r.series, r.line FROM r WHERE n <= 30 OR EXISTS (SELECT 1 FROM p WHERE p.series = r.series AND p.p = r.r)""")
def _(fx):
    d = fx.cues.select(F.col("lang").alias("series"), F.col("media_id").alias("line"), F.col("media_id").alias("o"))
    return K.even_sample(d, ["series"], "line", "o", 30)


@query("e32_refresh_due", """SELECT id AS series, id % 4 = 0 OR 100000 - (id % 90000) > 43200 AS stale FROM fx_jobs WHERE id % 4 = 0 OR 100000 - (id % 90000) > 43200 OR (id % 3 = 0 AND id % 12 > id % 10)""")
def _(fx):
    k = F.col("id")
    none = F.struct(F.lit("protect").alias("decision"), F.lit(9).alias("name_lines"), F.lit(3).alias("name_episodes"))
    blocked = F.struct(F.lit("skip").alias("decision"), F.lit(6).alias("name_lines"), F.lit(1).alias("name_episodes"))
    rep = fx.jobs.where(k % 4 != 0).select(k.alias("series"), (k % 90000).alias("checked_at"), F.when(k % 3 == 0, F.array(none, blocked)).otherwise(F.array(none)).alias("candidates"), (k % 10).alias("episodes_with_subtitles"))
    counts = fx.jobs.select(k.alias("series"), (k % 12).alias("episodes_now"))
    return K.refresh_due(rep, counts, F.lit(100000))
