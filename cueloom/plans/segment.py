"""D rows that SQL can state: segmentation and its helpers."""

from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.operators import segment as S
from cueloom.plans.registry import query

END = r"[.!?…。？！][''\"»)\]」』）】]*$".replace('\\"', '"')


@query("d2_split_sentences", rf"""WITH e AS (SELECT *, regexp_matches(text, '{END}') AND NOT (lang = 'en' AND text LIKE '%.' AND lower(rtrim(text, '.')) IN ('mr','mrs','ms','mx','dr','prof','sr','jr','st') AND text NOT LIKE '%..') AS e FROM fx_words)
SELECT media_id, word_idx, CAST(coalesce(sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sentence FROM e""")
def _(fx):
    return S.split_sentences(fx.words).select("media_id", "word_idx", "sentence")


CONJ, CLINGY = (str(tuple(x)) for x in (S.ENGLISH.conjunctions, S.ENGLISH.clingy))
PUNCT = X.STRIP_PUNCT.replace("'", "''")


@query("d5_wrap_lines", rf"""WITH w AS (SELECT media_id, cue_idx, text, string_split(text, ' ') AS w FROM fx_cues),
o AS (SELECT *, array_to_string(w[1:i], ' ') AS a, array_to_string(w[i+1:], ' ') AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w WHERE length(text) > 42 AND len(w) > 1)),
s AS (SELECT *, length(a) > 42 OR length(b) > 42 AS over, CASE WHEN regexp_matches(a || ' ', '[.!?…][''"»)\]」』）】]*(\s|$)|[。？！]') THEN 4 WHEN regexp_matches(a, '[,;:、][''"»)\]」』）】]*$') THEN 2 ELSE 0 END
  + CASE WHEN lower(trim(b, '{PUNCT}')) IN {CONJ} THEN 1 ELSE 0 END - CASE WHEN lower(trim(a, '{PUNCT}')) IN {CLINGY} THEN 3 ELSE 0 END AS sc FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id, cue_idx ORDER BY over, CASE WHEN over THEN greatest(length(a), length(b)) ELSE abs(length(a) - length(b)) - 2 * sc END, i) AS k FROM s)
SELECT media_id, cue_idx, a || '|' || b AS lines FROM r WHERE k = 1 UNION ALL SELECT media_id, cue_idx, text FROM w WHERE length(text) <= 42 OR len(w) < 2""")
def _(fx):
    return fx.cues.select("media_id", "cue_idx", F.array_join(S.wrap_lines(F.col("text")), "|").alias("lines"))


@query("d6_heuristic_turns", r"""WITH w AS (SELECT *, regexp_matches(text, '[.!?…][''"»)\]]*$') AS e, regexp_matches(text, '\?[''"»)\]]*$') AS q, lead(start_ms) OVER (PARTITION BY media_id ORDER BY word_idx) AS nxt,
  max(word_idx) OVER (PARTITION BY media_id) AS last FROM fx_words),
e AS (SELECT *, coalesce(lead(word_idx) OVER (PARTITION BY media_id ORDER BY word_idx), last) - word_idx AS reply FROM w WHERE e)
SELECT media_id, word_idx + 1 AS word_idx, nxt AS start_ms FROM e WHERE nxt IS NOT NULL AND (nxt - end_ms >= 600 OR (nxt - end_ms >= 150 AND (q OR reply <= 2)))""")
def _(fx):
    return S.heuristic_turns(fx.words)


@query("d7_embedding_turns", """WITH k AS (SELECT *, lag(embedding) OVER (PARTITION BY media_id ORDER BY idx) AS prev FROM fx_chunks WHERE dur_ms >= 600)
SELECT media_id, idx, start_ms FROM k WHERE prev IS NOT NULL AND list_cosine_similarity(prev::DOUBLE[], embedding::DOUBLE[]) < 0.6""")
def _(fx):
    return S.embedding_turns(fx.chunks)


@query("d8_dash_turn_points", """SELECT media_id, cue_idx, (start_ms + end_ms) / 2 AS at_ms FROM fx_cues WHERE (media_id + cue_idx) % 5 = 0 AND position(' ' IN text) > 0""")
def _(fx):
    w = F.split("text", " ")
    two = F.array(F.concat(F.lit("- "), F.get(w, F.lit(0))), F.lit(" "), F.concat(F.lit("– "), F.array_join(F.slice(w, F.lit(2), F.size(w)), " ")))
    lines = F.when(((F.col("media_id") + F.col("cue_idx")) % 5 == 0) & (F.size(w) > 1), two).otherwise(w)
    return S.dash_turn_points(fx.cues.withColumn("lines", lines))


@query("d9_boundary_points", """SELECT media_id, cue_idx, (end_ms + nxt) / 2 AS at_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY media_id ORDER BY cue_idx) AS nxt FROM fx_cues) WHERE nxt IS NOT NULL""")
def _(fx):
    return S.boundary_points(fx.cues)


@query("d12_group_weight", """SELECT media_id, cue_idx // 3 AS group_idx, CAST(sum(CASE WHEN lang = 'fr' THEN length(replace(text, ' ', '')) ELSE len(string_split(text, ' ')) END) AS BIGINT) AS weight FROM fx_cues GROUP BY 1, 2""")
def _(fx):
    c = fx.cues.withColumn("group_idx", F.floor(F.col("cue_idx") / 3)).withColumn("lang", F.when(F.col("lang") == "fr", "ja").otherwise(F.col("lang")))
    return S.group_weight(c)


def pieces(fx):
    g = F.floor(F.col("cue_idx") / 3)
    return fx.cues.select("media_id", g.alias("group_idx"), (F.col("cue_idx") % 3).alias("piece_idx"), "text", (g * 10000).alias("start_ms"), (g * 10000 + 7000).alias("end_ms"))


@query("d15_distribute_timing", """WITH p AS (SELECT media_id, cue_idx // 3 AS g, cue_idx % 3 AS i, greatest(1.0::DOUBLE, length(text) / 17.0::DOUBLE) AS w FROM fx_cues),
r AS (SELECT *, sum(w) OVER (PARTITION BY media_id, g ORDER BY i) AS run, sum(w) OVER (PARTITION BY media_id, g) AS total FROM p)
SELECT media_id, g AS group_idx, i AS piece_idx, round(g * 10000 + 7000 * (run - w) / total, 4) AS start_ms, round(g * 10000 + 7000 * run / total, 4) AS end_ms FROM r""")
def _(fx):
    d = S.distribute_timing(pieces(fx))
    return d.select("media_id", "group_idx", "piece_idx", F.round("start_ms", 4).alias("start_ms"), F.round("end_ms", 4).alias("end_ms"))


@query("d16_extend_short_cues", """WITH n AS (SELECT *, lead(start_ms) OVER (PARTITION BY media_id ORDER BY cue_idx) AS nxt FROM fx_messy_cues)
SELECT media_id, cue_idx, CAST(greatest(least(least(greatest(end_ms, start_ms + greatest(500, length(text) * 1000 // 17)), start_ms + 7000), coalesce(nxt, 9999999999)), start_ms + 1) AS BIGINT) AS end_ms FROM n""")
def _(fx):
    return S.extend_short_cues(fx.messy_cues).select("media_id", "cue_idx", "end_ms")


def groups(fx):
    g = fx.cues.withColumn("group_idx", F.floor(F.col("cue_idx") / 3))
    return g.groupBy("media_id", "group_idx").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_sort(F.collect_list("cue_idx")).alias("indices"))


def targets(fx):
    """Two target pieces per group, with some groups shifted and some pieces missing."""
    g = groups(fx).select("media_id", "group_idx", "start_ms", "end_ms", F.explode(F.array(F.lit(0), F.lit(1))).alias("piece_idx"))
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    off = F.when((F.col("media_id") + F.col("group_idx")) % 31 == 0, 25).otherwise(0)
    g = g.where((F.col("media_id") * 3 + F.col("group_idx")) % 37 > 0)
    return g.select("media_id", "group_idx", "piece_idx", F.when(F.col("piece_idx") == 0, F.col("start_ms") + off).otherwise(mid).alias("start_ms"), F.when(F.col("piece_idx") == 0, mid).otherwise(F.col("end_ms")).alias("end_ms"), F.lit("x").alias("text"))


TARGETS = """g AS (SELECT media_id, cue_idx // 3 AS g, min(start_ms) AS s, max(end_ms) AS e, count(*) AS n FROM fx_cues GROUP BY 1, 2),
t AS (SELECT media_id, g, p, n, CASE WHEN p = 0 THEN s + CASE WHEN (media_id + g) % 31 = 0 THEN 25 ELSE 0 END ELSE (s + e) // 2 END AS s, CASE WHEN p = 0 THEN (s + e) // 2 ELSE e END AS e FROM g, (VALUES (0), (1)) v(p) WHERE (media_id * 3 + g) % 37 > 0)"""


@query("d17_project", f"WITH {TARGETS} SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY g, p) - 1 AS cue_idx, g AS group_idx, s AS start_ms, n AS members FROM t")
def _(fx):
    return S.project(groups(fx), targets(fx)).select("media_id", "cue_idx", "group_idx", "start_ms", F.size("indices").cast("bigint").alias("members"))


@query("d18_validate_coverage", f"""WITH {TARGETS}, k AS (SELECT media_id, g, CASE WHEN (media_id * 3 + g) % 37 = 0 THEN 'dropped_utterance' WHEN (media_id + g) % 31 = 0 THEN 'timing_difference' END AS k FROM g)
SELECT media_id, count(*) AS population, CASE WHEN count(k) > 0 THEN 1 ELSE 0 END::BIGINT AS flagged, arg_min(k, g) FILTER (k IS NOT NULL) AS category, min(g) FILTER (k IS NOT NULL) AS group_idx FROM k GROUP BY 1""")
def _(fx):
    g = groups(fx)
    return S.validate_coverage(g, S.project(g, targets(fx)))


def spoken(fx):
    """Spans of two dashed lines or of one plain line."""
    half = F.floor(F.size(F.split("text", " ")) / 2).cast("int")
    w = F.split("text", " ")
    two = F.concat(F.lit("- "), F.array_join(F.slice(w, F.lit(1), half), " "), F.lit("\n-  "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))
    t = F.when((F.col("cue_idx") % 2 == 0) & (half > 0), two).otherwise(F.col("text"))
    return fx.cues.select("media_id", "cue_idx", t.alias("text"))


SPOKEN = r"""sp AS (SELECT media_id, cue_idx, text, string_split(text, ' ') AS w, len(string_split(text, ' ')) // 2 AS h FROM fx_cues),
ln AS (SELECT media_id, cue_idx, 0 AS line_idx, CASE WHEN cue_idx % 2 = 0 AND h > 0 THEN array_to_string(w[1:h], ' ') ELSE text END AS l FROM sp UNION ALL SELECT media_id, cue_idx, 1, array_to_string(w[h+1:], ' ') FROM sp WHERE cue_idx % 2 = 0 AND h > 0)"""


@query("d19_expand_dash", f"WITH {SPOKEN} SELECT media_id, cue_idx, line_idx, l AS line FROM ln")
def _(fx):
    return spoken(fx).select("media_id", "cue_idx", F.posexplode(S.dash_lines(F.col("text"))).alias("line_idx", "line"))


@query("d20_expand_sentences", rf"""WITH {SPOKEN}, s AS (SELECT media_id, cue_idx, line_idx, list_filter(list_transform(string_split(regexp_replace(l, '([.!?…]+)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM ln)
SELECT media_id, cue_idx, line_idx, i AS sent_idx, p[i + 1] AS sentence FROM (SELECT *, unnest(range(len(p))) AS i FROM s)""")
def _(fx):
    return S.expand_lines(spoken(fx), ["media_id", "cue_idx"])


@query("d20_rejoin_sentences", f"WITH {SPOKEN} SELECT media_id, cue_idx, CASE WHEN max(line_idx) = 1 THEN string_agg('- ' || l, chr(10) ORDER BY line_idx) ELSE min(l) END AS text FROM ln GROUP BY 1, 2")
def _(fx):
    return S.rejoin_lines(S.expand_lines(spoken(fx), ["media_id", "cue_idx"]), ["media_id", "cue_idx"])


@query("d21_run_on", "SELECT media_id, seg_idx, NOT regexp_matches(text, '[.!?…]') AND len(string_split(text, ' ')) >= 8 AS run_on FROM fx_segments")
def _(fx):
    return fx.segments.select("media_id", "seg_idx", X.is_run_on("text").alias("run_on"))


@query("d22_chunk_words", "SELECT media_id, word_idx // 20 AS seg_idx, word_idx % 20 // 6 AS chunk_idx, string_agg(text, ' ' ORDER BY word_idx) || '.' AS chunk FROM fx_words GROUP BY 1, 2, 3")
def _(fx):
    return fx.segments.select("media_id", "seg_idx", F.posexplode(S.chunk_words(F.col("text"))).alias("chunk_idx", "chunk"))


@query("d24_orphan_spans", """WITH s AS (SELECT media_id, cue_idx AS span_idx, 1 + cue_idx % 2 AS n, CASE WHEN cue_idx % 4 = 0 THEN 1 ELSE len(string_split(text, ' ')) END AS w, (media_id + cue_idx) % 3 = 0 AS gap FROM fx_cues),
x AS (SELECT *, coalesce(lead(gap) OVER (PARTITION BY media_id ORDER BY span_idx), false) AS after FROM s)
SELECT media_id, span_idx, CASE WHEN gap THEN span_idx - 1 ELSE span_idx + 1 END AS context_idx, gap AS context_before FROM x WHERE n = 1 AND w = 1 AND ((gap AND NOT after AND span_idx > 0) OR (after AND NOT gap))""")
def _(fx):
    k = F.col("cue_idx")
    d = fx.cues.select("media_id", k.alias("span_idx"), (1 + k % 2).alias("cue_count"), F.when(k % 4 == 0, "Her").otherwise(F.col("text")).alias("text"), F.when((F.col("media_id") + k) % 3 == 0, "real_acoustic_gap").when(k % 3 == 1, "sentence_end").alias("boundary_before"))
    return S.orphan_spans(d)


@query("d25_strip_affix", """SELECT media_id, cue_idx, CASE WHEN cue_idx % 3 = 0 THEN 'out here' WHEN cue_idx % 3 = 1 THEN 'Out' END AS residual FROM fx_cues""")
def _(fx):
    k = F.col("cue_idx") % 3
    padded = F.when(k == 0, F.concat(F.translate("text", "aeo", "AEO"), F.lit(" out here"))).when(k == 1, F.concat(F.lit("Out "), "text", F.lit("!"))).otherwise(F.concat(F.lit("other "), "text"))
    return fx.cues.select("media_id", "cue_idx", S.strip_affix(padded, F.col("text"), k != 1).alias("residual"))


def clauses(fx):
    c = fx.clauses
    h = (F.col("media_id") + F.col("clause_idx")) % 9
    text = F.when(h == 4, "Oi!").when((h == 2) | (h == 3), "que se passa contigo hoje").otherwise(F.col("text"))
    return c.select("media_id", "clause_idx", text.alias("text"), "lang", F.when(F.col("prob_pct") >= 60, 0.95).otherwise(0.5).alias("prob"), (F.col("clause_idx") * 1000).alias("start_ms"), (F.col("clause_idx") * 1000 + 900).alias("end_ms"))


RUNS = """cl AS (SELECT media_id, clause_idx, CASE WHEN h = 4 THEN 'Oi!' WHEN h IN (2, 3) THEN 'que se passa contigo hoje' ELSE text END AS text, lang, prob_pct FROM (SELECT *, (media_id + clause_idx) % 9 AS h FROM fx_clauses)),
lg AS (SELECT *, CASE WHEN prob_pct >= 60 AND lang <> 'xx' THEN lang END AS q, row_number() OVER (PARTITION BY media_id ORDER BY clause_idx) AS r FROM cl WHERE length(text) >= 20),
rn AS (SELECT *, r - row_number() OVER (PARTITION BY media_id, q ORDER BY clause_idx) AS g FROM lg WHERE q IS NOT NULL)"""


@query("d26_language_runs", f"WITH {RUNS} SELECT media_id, clause_idx, q AS override FROM rn WHERE (media_id, q, g) IN (SELECT (media_id, q, g) FROM rn GROUP BY media_id, q, g HAVING count(*) >= 3)")
def _(fx):
    return S.language_runs(clauses(fx), "xx", ["pt", "es"])


@query("d27_candidate_runs", f"""WITH {RUNS} SELECT media_id, q AS language, count(*) AS clauses, count(DISTINCT replace(lower(text), 'ß', 'ss')) AS distinct_clauses, min(clause_idx) AS first_clause, max(clause_idx) AS last_clause,
 min(clause_idx) * 1000 AS start_ms, max(clause_idx) * 1000 + 900 AS end_ms, count(DISTINCT replace(lower(text), 'ß', 'ss')) < 2 AS repeated_only FROM rn GROUP BY media_id, q, g HAVING count(*) >= 2""")
def _(fx):
    return S.candidate_runs(clauses(fx), "xx")
