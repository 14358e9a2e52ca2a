"""Registered queries of this folder and the DuckDB texts that say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import alignment, decontaminate, htmltext, language, lengths, licenses, neardup, quality, sharding, spelling, spm, tokenfile, vectors
from cueloom.llm.common import small_batches
from cueloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            small_batches(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: word list and 3-word windows of a text, per document
QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
fails AS (
  SELECT source, unnest(['short', 'repeated', 'word_length', 'symbols', 'dup_lines']) AS rule,
         unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, word_chars < 3 * n_words OR word_chars > 12 * n_words,
                 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines]) AS failed
  FROM m WHERE source IS NOT NULL),
rates AS (SELECT source, rule, count(*) AS n, sum(failed::INT) AS f FROM fails GROUP BY ALL),
moments AS (SELECT rule, sum(f) / sum(n) AS p, count(*) / sum(n) AS per, sum(f * f / n) / sum(n) AS ff FROM rates GROUP BY rule),
prior AS (
  SELECT rule, p, CASE WHEN ff - p * p - p * (1 - p) * per > 0
    THEN least(greatest(p * (1 - p) / (ff - p * p - p * (1 - p) * per) - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM moments),
bad AS (SELECT DISTINCT source FROM rates JOIN prior USING (rule) WHERE (f + p * s) / (n + s) > 0.5),
j AS (SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, bad.source IS NULL AS host_kept FROM m LEFT JOIN bad ON m.source = bad.source)
"""


@query(
    "op10_quality_rules",
    QUALITY_SQL + "SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, host_kept, NOT base_failed AND host_kept AS kept FROM j",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


#: Item windows by their words; document windows of every length that items have meet them by equality.
CONTAMINATION_SQL = r"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS span
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM {docs}),
occ AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS span
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, occ.n, i, item FROM occ JOIN win USING (span)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
v AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id))
"""


@query("op3_decontaminate", CONTAMINATION_SQL.replace("{docs}", "documents") + "SELECT * FROM v")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("fp")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Vocabularies come with an installed library; executors have it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op2_token_file")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(table(spark, sf_dir, "documents"), tokenizer_path()))


SHARDING_SQL = r"""
WITH tbl AS (SELECT list(CASE WHEN FALSE THEN 0 ELSE c END ORDER BY b) AS tab FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)::BIGINT[]), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS b))),
d AS (
  SELECT doc_id, coalesce('=' || source, '-') AS stratum, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a // 256, tab[xor(a & 255, b) + 1])), 4294967295) AS text_crc32
  FROM documents, tbl),
r AS (
  SELECT *, count(*) OVER (PARTITION BY stratum) AS n,
    row_number() OVER (PARTITION BY stratum ORDER BY ('0x' || substr(md5('interleave-1|' || coalesce(doc_id::VARCHAR, '') || '|' || text_crc32), 1, 13))::BIGINT, doc_id NULLS FIRST, text_crc32) - 1 AS rank
  FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + ('0x' || substr(md5('interleave-1|' || stratum), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) / n, stratum, rank) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 40 // total)::INTEGER AS shard,
  pos - ((pos * 40 // total) * total + 39) // 40 AS slot, NULL::INTEGER AS grown_shard
FROM p
"""


@query("op9_sharding", SHARDING_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


#: All pairs of distinct sets that share a shingle, counted; then reachability over the links.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {docs}),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS g FROM c),
k AS (SELECT a.rep AS a, b.rep AS b, a.n + b.n AS n, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM k WHERE 100 * i >= 80 * (n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a),
m AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a),
v AS (SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(m.component_id, s.doc_id) AS kept
  FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN m ON c.rep = m.rep)
"""


@query("op4_near_duplicates", NEAR_SQL.replace("{docs}", "documents") + "SELECT * FROM v")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


#: The two scores of a statement against a template, from the same statements.
LICENSES_SQL = r"""
WITH tpl(license, template, text) AS (VALUES {templates}),
tt AS (SELECT license, template, term, count(*) AS tf FROM (SELECT license, template, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM tpl) WHERE term <> '' GROUP BY ALL),
nt AS (SELECT count(*) AS n FROM tpl),
idf AS (SELECT term, ln(1 + any_value(n) / count(*)) AS idf FROM tt, nt GROUP BY term),
tv AS (SELECT term, template, license, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (term)),
f0 AS (SELECT doc_id, text, coalesce(regexp_matches(split_part(text, chr(10), 1), '{marker}'), FALSE) AS is_license FROM documents),
f AS (SELECT f0.*, array_to_string(list_filter([source, lang, (f0.doc_id // 1000)::VARCHAR, (f0.doc_id // 100)::VARCHAR][1:CASE WHEN is_license THEN 1 + f0.doc_id % 4 ELSE 4 END], lambda x: x IS NOT NULL), '/') AS dir
  FROM f0 JOIN documents USING (doc_id)),
m AS (SELECT doc_id, text, is_license, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{comment}', '', 'g'))) AS bare,
    list_position(list_transform(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*(/\*|\*|//|#|;|--|%|<!--)|^[ \t\r]*$')), TRUE) AS other
  FROM f WHERE is_license OR regexp_matches(text, '{marker}')),
u AS (
  SELECT DISTINCT doc_id, body FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.;!?])\s+', '\1' || chr(10), 'g'), '\n')) AS body FROM m) WHERE regexp_matches(body, '{marker}')
  UNION SELECT doc_id, body FROM (SELECT doc_id, unnest(string_split_regex(array_to_string(bare, chr(10)), '\n\n+')) AS body FROM m) WHERE regexp_matches(body, '{marker}')
  UNION SELECT doc_id, body FROM (SELECT doc_id, array_to_string(CASE WHEN other > 0 THEN bare[1:other - 1] ELSE bare END, chr(10)) AS body FROM m) WHERE regexp_matches(body, '{marker}')
  UNION SELECT doc_id, text FROM m WHERE is_license),
b AS (SELECT body, term, count(*) AS tf FROM (SELECT body, unnest(string_split_regex(lower(body), '[^\p{L}\p{N}]+')) AS term FROM (SELECT DISTINCT body FROM u)) WHERE term <> '' GROUP BY ALL),
bw AS (SELECT body, term, tf * coalesce(idf, ln(1 + n)) AS w FROM b LEFT JOIN idf USING (term), nt),
cosine AS (
  SELECT body, license, round(sum(w * weight) / any_value(nrm), 6) AS score
  FROM bw JOIN tv USING (term) JOIN (SELECT body, sqrt(sum(w * w)) AS nrm FROM bw GROUP BY body) USING (body) GROUP BY body, template, license),
own AS (SELECT doc_id, license AS own_license, score AS own_score FROM u JOIN cosine USING (body) WHERE score >= 0.5
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
r AS (SELECT f.*, dir || CASE WHEN is_license THEN '/LICENSE-' || doc_id ELSE '/' || doc_id || '.txt' END AS path, own_license, own_score FROM f LEFT JOIN own USING (doc_id)),
dl AS (SELECT dir, own_license AS license FROM r WHERE is_license AND own_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) = 1),
up AS (SELECT doc_id, unnest(list_transform(range(0, len(steps) + 1), lambda k: array_to_string(steps[1:k], '/'))) AS above FROM (SELECT doc_id, string_split(dir, '/') AS steps FROM r)),
near AS (SELECT doc_id, arg_max(dl.dir, length(dl.dir)) AS dir, arg_max(license, length(dl.dir)) AS license FROM up JOIN dl ON up.above = dl.dir GROUP BY doc_id)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, near.license) AS license, CASE WHEN own_license IS NOT NULL THEN 'own' ELSE near.dir END AS license_from
FROM r LEFT JOIN near USING (doc_id)
"""


def _license_values() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quote(k)}, {quote(f'{k}#{i}')}, {quote(t)})" for k, v in licenses.built_in().items() for i, t in enumerate(v))


@query("op1_license_scan", LICENSES_SQL.replace("{templates}", _license_values()).replace("{marker}", licenses.MARKER).replace("{comment}", licenses.COMMENT))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below source, language and directories per thousand and hundred ids; those that open with
    a licence statement are licence files, of one of the four directories above them in turn."""
    docs = table(spark, sf_dir, "documents")
    marked, number = licenses.first_line_marked(), F.col("doc_id").cast("string")
    steps = F.array("source", "lang", F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 100").cast("string"))
    depth = F.when(marked, 1 + F.col("doc_id") % 4).otherwise(4).cast("int")
    folder = F.array_join(F.slice(steps, F.lit(1), depth), "/")
    name = F.when(marked, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt")))
    return licenses.scan(docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text"))


@query("op5_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_merges(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model")).drop("text")


#: Every pair of usable vectors by its cosine; then reachability over the links.
VECTORS_SQL = r"""
WITH RECURSIVE u AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT m.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, m.vec_id) AS component_id, m.vec_id = coalesce(component_id, m.vec_id) AS kept
FROM embeddings m LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@query("op11_near_vectors", VECTORS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


#: crc32 of `<doc_id>:<run>` byte by byte, once per distinct pair; near words by equal strings after one deletion.
SPELLING_SQL = r"""
WITH RECURSIVE tbl AS (SELECT list(c ORDER BY b) AS tab FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)::BIGINT[]), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS b))),
r AS (SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda a, b: xor(a // 256, tab[xor(a & 255, b) + 1])), 4294967295) AS h FROM r, tbl),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
b AS (SELECT word, count(*) AS n_near, min({'m': -near_n, 'near': near}) AS best FROM p GROUP BY word),
f AS (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 5 * n THEN best.near END AS form, CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n FROM w LEFT JOIN b USING (word)),
chain(word, tip, form) AS (SELECT word, word, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON c.form = f.word)
SELECT f.word, f.form, chain.tip AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM f JOIN chain ON f.word = chain.word AND chain.form IS NULL
"""


@query("op12_spelling_variants", SPELLING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
