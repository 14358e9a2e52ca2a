"""F rows: quality control over cues, translations and job reports."""

from pyspark.sql import functions as F

from cueloom.operators import qc as Q
from cueloom.plans.jobs import qc_json
from cueloom.plans.registry import query

TIMING = """SELECT c.media_id, c.cue_idx, CASE WHEN end_ms <= start_ms THEN 'non-positive duration'
  WHEN start_ms < (SELECT max(p.end_ms) FROM fx_messy_cues p WHERE p.media_id = c.media_id AND p.cue_idx < c.cue_idx) - {slack} THEN 'overlaps previous cue' END AS reason FROM fx_messy_cues c"""

# running maximum stated as a window; the nested form above is used on a fixture in the tests
RUN = """(SELECT *, max(end_ms) OVER (PARTITION BY media_id ORDER BY cue_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM fx_messy_cues)"""

F5 = f"""SELECT media_id, cue_idx AS "index", CASE WHEN end_ms <= start_ms THEN 'non-positive duration' ELSE 'overlaps previous cue' END AS reason, 0.9::DOUBLE AS confidence
FROM {RUN} WHERE end_ms <= start_ms OR start_ms < prev_end"""

F6 = """SELECT media_id, cue_idx AS "index",
  CASE WHEN n > 2 THEN 'too many lines' WHEN longest > 42 THEN 'a line exceeds max character length' WHEN ms < 500 THEN 'duration below minimum'
       WHEN ms > 7000 THEN 'duration exceeds maximum' ELSE 'reading speed exceeds maximum' END AS reason,
  CASE WHEN n > 2 THEN 0.8 WHEN longest > 42 THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence
FROM (SELECT *, end_ms - start_ms AS ms, len(string_split(text, '|')) AS n, list_max(list_transform(string_split(text, '|'), lambda x: length(x))) AS longest FROM fx_messy_cues)
WHERE n > 2 OR longest > 42 OR ms < 500 OR ms > 7000 OR (ms > 0 AND length(text) * 1000 > 21 * ms)"""

F7 = f"""SELECT media_id, cue_idx AS "index", 'empty cue text' AS reason, 1.0::DOUBLE AS confidence FROM fx_messy_cues WHERE trim(text) = ''
UNION ALL SELECT media_id, cue_idx, CASE WHEN end_ms <= start_ms THEN 'non-positive duration' ELSE 'overlaps previous cue' END, 1.0
FROM {RUN} WHERE end_ms <= start_ms OR start_ms < prev_end - 10"""


def cue_findings(fx):
    return Q.qc_cues(fx.messy_cues)


@query("f2_qc_translation", r"""
WITH t AS (SELECT *, length(source) AS ls, length(translated) AS lt, len(string_split_regex(trim(regexp_replace(source, '^\s+|\s+$', '', 'g')), '\s+')) AS n,
  list_reduce(list_prepend('', string_split(regexp_replace(translated, '[^()\[\]{}]', '', 'g'), '')),
    lambda a, x: CASE WHEN x = '' OR a[1] = '!' THEN a WHEN x IN ('(', '[', '{') THEN (CASE x WHEN '(' THEN ')' WHEN '[' THEN ']' ELSE '}' END) || a
                 WHEN a[1] = x THEN substr(a, 2) ELSE '!' END) <> '' AS unbalanced FROM fx_translations),
r AS (SELECT *, CASE WHEN regexp_replace(translated, '\s', '', 'g') = '' THEN 1 WHEN regexp_matches(translated, '\bX[a-z]{2}\b') THEN 2 WHEN unbalanced THEN 3
  WHEN ls >= 15 AND lt * 4 < ls THEN 4 WHEN ls >= 5 AND lt > ls * 3.5 THEN 5 WHEN NOT regexp_matches(source, '[.!?…]') AND n >= 8 THEN 6 END AS rule FROM t)
SELECT media_id, idx AS "index", CASE rule WHEN 2 THEN 'entity_error' WHEN 4 THEN 'substitution' ELSE 'translation_error' END AS category,
  CASE rule WHEN 1 THEN 'empty translation' WHEN 2 THEN 'leaked glossary placeholder' WHEN 3 THEN 'unbalanced brackets' WHEN 4 THEN 'suspiciously short vs. source length'
    WHEN 5 THEN 'suspiciously long vs. source length' ELSE 'unpunctuated multi-clause source (' || n || ' words, no sentence-ending punctuation)' END AS reason,
  CASE rule WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.6 WHEN 6 THEN 0.4 ELSE 0.5 END::DOUBLE AS confidence FROM r WHERE rule IS NOT NULL""")
def _(fx):
    return Q.qc_translation(fx.translations).drop("stage")


REPEATS = "SELECT media_id, word_idx // 9 AS idx, string_agg(text, ' ' ORDER BY word_idx) AS source, CASE WHEN (word_idx // 9) % 4 = 0 THEN 'See you tomorrow.' ELSE string_agg(text, ' ' ORDER BY word_idx) END AS translated FROM fx_words GROUP BY media_id, word_idx // 9"


@query("f3_qc_repeats", f"""
WITH t AS ({REPEATS}), k AS (SELECT *, replace(lower(translated), 'ß', 'ss') AS tk, replace(lower(source), 'ß', 'ss') AS sk FROM t),
p AS (SELECT *, lag(idx) OVER w AS pi, lag(sk) OVER w AS ps FROM k WHERE length(tk) >= 8 WINDOW w AS (PARTITION BY media_id, tk ORDER BY idx))
SELECT media_id, idx AS "index", 'repeated translation matches unrelated sentence ' || pi AS reason, 0.5::DOUBLE AS confidence FROM p WHERE ps <> sk""")
def _(fx):
    r = fx._runs(9, "idx")
    t = F.when(F.col("idx") % 4 == 0, "See you tomorrow.").otherwise(F.col("text"))
    return Q.qc_repeats(r.select("media_id", "idx", F.col("text").alias("source"), t.alias("translated"))).drop("stage", "category")


@query("f5_qc_timing", F5)
def _(fx):
    return Q.qc_timing(fx.messy_cues).drop("stage", "category")


@query("f6_qc_readability", F6)
def _(fx):
    return Q.qc_readability(fx.messy_cues).drop("stage", "category")


@query("f7_qc_output", F7)
def _(fx):
    return Q.qc_output(fx.messy_cues).drop("stage", "category")


@query("f8_qc_summary", f"""
WITH f AS (SELECT 'timing' AS stage, media_id, "index" FROM ({F5}) UNION ALL SELECT 'readability', media_id, "index" FROM ({F6}) UNION ALL SELECT 'output', media_id, "index" FROM ({F7})),
g AS (SELECT stage, (media_id + "index") % 3 = 0 AS again, CASE WHEN "index" % 5 = 0 THEN NULL ELSE "index" % 2 = 0 END AS better FROM f)
SELECT s.stage, (SELECT count(*) FROM fx_cues) AS population, count(g.stage) AS flagged, count(*) FILTER (again) AS retried, count(*) FILTER (again AND better) AS improved, count(*) FILTER (again AND better IS NOT TRUE) AS unresolved
FROM (SELECT unnest(['timing', 'readability', 'output', 'segmentation']) AS stage) s LEFT JOIN g USING (stage) GROUP BY s.stage""")
def _(fx):
    stages = F.explode(F.array(*map(F.lit, ["timing", "readability", "output", "segmentation"])))
    pop = fx.cues.agg(F.count("*").alias("population")).select(stages.alias("stage"), "population")
    better = F.when(F.col("index") % 5 != 0, F.col("index") % 2 == 0)
    return Q.qc_summary(cue_findings(fx), pop, retried=(F.col("media_id") + F.col("index")) % 3 == 0, improved=better)


@query("f9_needs_review", f"""
WITH f AS (SELECT media_id, confidence FROM ({F5}) UNION ALL SELECT media_id, confidence FROM ({F6}) UNION ALL SELECT media_id, confidence FROM ({F7}))
SELECT media_id, count(*) FILTER (confidence >= 0.7) AS needs_review FROM f GROUP BY media_id""")
def _(fx):
    return Q.needs_review(cue_findings(fx))


@query("f10_recount_reviews", """
SELECT id, id % 14 AS before, n AS after, id % 14 <> n AS changed FROM (SELECT id,
  CAST((CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) + (CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM fx_jobs)""")
def _(fx):
    return Q.recount_reviews(qc_json(fx))


@query("f11_job_valid", f"""
SELECT doc_id AS media_id, doc_id NOT IN (SELECT media_id FROM ({F5}) UNION ALL SELECT media_id FROM ({F7})) AS valid FROM documents""")
def _(fx):
    jobs = fx.table("documents").select(F.col("doc_id").alias("media_id"))
    return Q.job_valid(cue_findings(fx), jobs)


@query("f12_flagged_cues", f"""
SELECT DISTINCT media_id, "index" FROM (SELECT media_id, "index" FROM ({F5}) UNION ALL SELECT media_id, "index" FROM ({F6}) UNION ALL SELECT media_id, "index" FROM ({F7}))""")
def _(fx):
    return Q.flagged_cues(cue_findings(fx))


F13 = """
WITH j AS (SELECT id, id % 3 = 0 AS e, id % 2 = 0 AS d, id % 5 = 0 AS l, id % 7 = 0 AS h, id % 11 = 0 AS u, id % 13 = 0 AS t FROM fx_jobs WHERE status = 'completed'),
x AS (
  SELECT id, 'entity_finding' AS feature, 8.0 AS v FROM j WHERE e UNION ALL SELECT id, 'hallucination_finding', 6.0 FROM j WHERE h
  UNION ALL SELECT id, 'translation_finding', 2.7 FROM j WHERE t UNION ALL SELECT id, 'other_high_confidence', 0.2 FROM j WHERE d UNION ALL SELECT id, 'other_high_confidence', 0.2 FROM j WHERE l
  UNION ALL SELECT id, 'flagged_rate', least(2.0, 2.0 / (id % 40)) FROM j WHERE e AND id % 40 > 0
  UNION ALL SELECT id, 'flagged_rate', least(2.0, 2.0 * (d::INT + l::INT) / (id % 60 + 1)) FROM j WHERE d OR l
  UNION ALL SELECT id, 'flagged_rate', 2.0 * (h::INT + u::INT) / 100 FROM j WHERE h OR u
  UNION ALL SELECT id, 'flagged_rate', 0.2 FROM j WHERE t
  UNION ALL SELECT id, 'unresolved', least(2.0, 0.5 * (id % 9)) FROM j WHERE id % 9 > 0 UNION ALL SELECT id, 'unresolved', 0.5 FROM j
  UNION ALL SELECT id, 'needs_review', least(2.0, 0.2 * (id % 14)) FROM j WHERE id % 14 > 0),
s AS (SELECT id, round(sum(round(CAST(v AS DOUBLE), 4)), 4) AS score, count(*) AS features FROM x GROUP BY id)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank, features FROM s"""


@query("f13_rank_reviews", F13)
def _(fx):
    r = Q.rank_reviews(qc_json(fx))
    return r.select("id", "score", "rank", F.size("contributions").cast("bigint").alias("features"))
