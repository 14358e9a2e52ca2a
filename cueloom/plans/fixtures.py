"""Timed-text views derived from the given tables.

The Spark side builds tracks straight from each document row (array slices), so
no view needs a shuffle. ``SQL_VIEWS`` states the same views for DuckDB.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.functions.sequence import once


def word_start(i: Column) -> Column:
    """Milliseconds of word ``i``: 100 ms gaps, +300 each 7th, +1000 each 17th word."""
    return (400 * i + 1000 * F.floor(i / 17) + 300 * F.floor(i / 7)).cast("bigint")


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Rebalance a source only when it has fewer splits than the cluster has cores."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def docs(self) -> DataFrame:
        """One row per track: media_id, lang, source and its word array."""
        d = self.spread(self.table("documents").select("doc_id", "lang", "source", "text"))
        trimmed = F.btrim("text", F.lit(" \t\n\v\f\r"))
        return (
            d.select(F.col("doc_id").alias("media_id"), "lang", "source", trimmed.alias("body"))
            .where("body <> ''")
            .select("media_id", "lang", "source", F.split("body", r"\s+").alias("a"))
        )

    @cached_property
    def words(self) -> DataFrame:
        w = self.docs.select("media_id", "lang", F.posexplode("a").alias("p", "text"))
        i = F.col("p").cast("bigint")
        return w.select(
            "media_id", "lang", i.alias("word_idx"), "text",
            word_start(i).alias("start_ms"), (word_start(i) + 300).alias("end_ms"),
        )

    def _runs(self, size: int, name: str) -> DataFrame:
        n = F.size("a")
        k = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
        r = self.docs.select("media_id", "lang", "source", "a", k.alias("k"))
        # a generator: queries use the text often, and would join it from the track's array each time; it also takes all
        # that a run needs of the array, else every run that waits for a UDF carries its whole track
        own = F.struct(F.array_join(F.slice("a", F.col("k") * size + 1, size), " ").alias("text"), F.least(F.col("k") * size + size - 1, n - 1).alias("last"))
        r = r.select("media_id", "lang", "source", "k", once(own).alias("r"))
        return r.select(
            "media_id", "lang", "source", F.col("k").cast("bigint").alias(name),
            word_start(F.col("k") * size).alias("start_ms"), (word_start(F.col("r.last")) + 300).alias("end_ms"), "r.text",
        )

    @cached_property
    def cues(self) -> DataFrame:
        return self._runs(7, "cue_idx").drop("source")

    @cached_property
    def ref_cues(self) -> DataFrame:
        c = self._runs(5, "cue_idx").drop("source")
        m = F.col("media_id") % 4

        def moved(s: str) -> Column:
            t = F.col(s)
            return t + F.when(m == 0, 0).when(m == 1, 5100).when(m == 2, F.when(F.col("start_ms") >= 60000, 5100).otherwise(0)).otherwise(F.floor(t / 500))

        return c.select("media_id", "lang", "cue_idx", moved("start_ms").alias("start_ms"), moved("end_ms").alias("end_ms"), "text")

    @cached_property
    def messy_cues(self) -> DataFrame:
        """Cues with planted timing, layout and empty-text faults."""
        c = self.cues
        h = (F.col("media_id") * 5 + F.col("cue_idx") * 3) % 23
        end = (
            F.when(h == 1, F.col("start_ms")).when(h == 2, F.col("start_ms") + 200)
            .when(h == 3, F.col("end_ms") + 6000).when(h == 4, F.col("end_ms") + 1500).otherwise(F.col("end_ms"))
        )
        text = F.when(h == 5, F.lit("")).when(h == 6, F.concat_ws("|", F.split("text", " "))).otherwise(F.col("text"))
        return c.select("media_id", "cue_idx", "start_ms", end.alias("end_ms"), text.alias("text"), F.split(text, r"\|").alias("lines"))

    @cached_property
    def segments(self) -> DataFrame:
        s = self._runs(20, "seg_idx").drop("source")
        m, k = F.col("media_id"), F.col("seg_idx")
        return s.select(
            "media_id", "lang", "seg_idx", "start_ms", "end_ms", "text",
            ((m * 7 + k * 13) % 100).alias("no_speech_pct"),
            (-((m * 3 + k * 5) % 15)).alias("logprob_x10"),
            (10 + (m + k * 11) % 90).alias("compression_x10"),
            F.when((m + k) % 3 == 0, "thank you for watching").otherwise(F.col("text")).alias("track_text"),
        )

    @cached_property
    def clauses(self) -> DataFrame:
        return self.segments.select(
            "media_id", F.col("seg_idx").alias("clause_idx"), "text",
            F.when(F.floor(F.col("seg_idx") / 4) % 5 == 4, "pt").otherwise("xx").alias("lang"),
            (50 + (F.col("media_id") * 11 + F.col("seg_idx") * 7) % 50).alias("prob_pct"),
        )

    @cached_property
    def names(self) -> DataFrame:
        """Glossary names per series (one series per language): seen in many tracks."""
        return (
            self.words.where(F.col("text").rlike("^[A-Z][a-z]{3,}$"))
            .groupBy(F.col("lang").alias("series"), F.col("text").alias("canonical"))
            .agg(F.count("*").alias("n"), F.countDistinct("media_id").alias("media"))
            .where("media >= 10").select("series", "canonical", "n")
        )

    @cached_property
    def translations(self) -> DataFrame:
        c = self.table("conversations")
        a = c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("idx"), F.col("text").alias("source"))
        b = c.select(F.col("conv_id").alias("media_id"), (F.col("turn") - 1).alias("idx"), F.col("text").alias("translated"))
        return a.join(b, ["media_id", "idx"])

    @cached_property
    def jobs(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        status = F.element_at(F.array(*map(F.lit, ["queued", "running", "completed", "failed", "skipped", "cancelled"])), (k % 6 + 1).cast("int"))
        return self.spread(self.table("orders")).select(
            k.alias("id"), F.nullif(c % 50, F.lit(0)).alias("tvdb_id"),
            F.concat(F.lit("show"), (c % 50).cast("string"), F.lit("/e"), (c % 400).cast("string"), F.lit(".mkv")).alias("video_path"),
            status.alias("status"), F.unix_timestamp("o_orderdate").alias("created_at"),
            F.when((k % 40).isin(10, 20, 30), k - 10).alias("retry_of_job_id"), (k % 5).alias("recovery_count"),
        )

    @cached_property
    def job_events(self) -> DataFrame:
        name = (
            F.when(F.col("event_type") == "signup", "ASR_STARTED").when(F.col("event_type") == "view", "ASR_PROGRESS")
            .when(F.col("event_type") == "click", "TRANSLATION_STARTED").when(F.col("event_type") == "purchase", "TRANSLATION_PROGRESS")
            .otherwise("JOB_COMPLETED")
        )
        return self.spread(self.table("events")).select(
            "event_id", F.col("user_id").alias("job_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
            name.alias("name"), (F.col("event_id") % 101).alias("position"), F.lit(100).cast("bigint").alias("total"),
        )

    @cached_property
    def chunks(self) -> DataFrame:
        """Speech chunks: one track per label, position by vec_id order."""
        from cueloom.functions.sequence import scan

        e = self.spread(self.table("embeddings")).select(F.col("label").alias("media_id"), F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
        e = scan(e, ["media_id"], "vec_id", {"idx": ("count", F.lit(1))})
        return e.select("media_id", "idx", "vec_id", "embedding", (1000 * F.col("idx")).alias("start_ms"), (400 + (F.col("vec_id") % 5) * 200).alias("dur_ms"))


_T = "400*word_idx + 1000*(word_idx//17) + 300*(word_idx//7)"


def _run_sql(size: int, name: str) -> str:
    return f"""SELECT media_id, min(lang) AS lang, word_idx // {size} AS {name}, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
       string_agg(text, ' ' ORDER BY word_idx) AS text
FROM fx_words GROUP BY media_id, word_idx // {size}"""


_MOVE = "CASE media_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 5100 WHEN 2 THEN (CASE WHEN s0 >= 60000 THEN 5100 ELSE 0 END) ELSE {0} // 500 END"

SQL_VIEWS: dict[str, str] = {
    "fx_words": rf"""SELECT media_id, lang, word_idx, text, {_T} AS start_ms, {_T} + 300 AS end_ms
FROM (SELECT doc_id AS media_id, lang, unnest(range(0, len(a))) AS word_idx, unnest(a) AS text
      FROM (SELECT doc_id, lang, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS a FROM documents))
WHERE text <> ''""",
    "fx_cues": _run_sql(7, "cue_idx"),
    "fx_ref_cues": f"""SELECT media_id, lang, cue_idx, s0 + {_MOVE.format('s0')} AS start_ms, e0 + {_MOVE.format('e0')} AS end_ms, text
FROM (SELECT media_id, min(lang) AS lang, word_idx // 5 AS cue_idx, min(start_ms) AS s0, max(end_ms) AS e0,
             string_agg(text, ' ' ORDER BY word_idx) AS text FROM fx_words GROUP BY media_id, word_idx // 5)""",
    "fx_messy_cues": """SELECT media_id, cue_idx, start_ms,
  CASE WHEN h = 1 THEN start_ms WHEN h = 2 THEN start_ms + 200 WHEN h = 3 THEN end_ms + 6000 WHEN h = 4 THEN end_ms + 1500 ELSE end_ms END AS end_ms,
  CASE WHEN h = 5 THEN '' WHEN h = 6 THEN replace(text, ' ', '|') ELSE text END AS text
FROM (SELECT *, (media_id*5 + cue_idx*3) % 23 AS h FROM fx_cues)""",
    "fx_segments": f"""SELECT *, (media_id*7 + seg_idx*13) % 100 AS no_speech_pct, -((media_id*3 + seg_idx*5) % 15) AS logprob_x10,
  10 + ((media_id + seg_idx*11) % 90) AS compression_x10,
  CASE WHEN (media_id + seg_idx) % 3 = 0 THEN 'thank you for watching' ELSE text END AS track_text
FROM ({_run_sql(20, 'seg_idx')})""",
    "fx_clauses": """SELECT media_id, seg_idx AS clause_idx, text,
  CASE WHEN (seg_idx // 4) % 5 = 4 THEN 'pt' ELSE 'xx' END AS lang, 50 + (media_id*11 + seg_idx*7) % 50 AS prob_pct FROM fx_segments""",
    "fx_names": """SELECT lang AS series, text AS canonical, count(*) AS n FROM fx_words WHERE regexp_matches(text, '^[A-Z][a-z]{3,}$')
GROUP BY lang, text HAVING count(DISTINCT media_id) >= 10""",
    "fx_translations": """SELECT a.conv_id AS media_id, a.turn AS idx, a.text AS source, b.text AS translated
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "fx_chunks": """SELECT label AS media_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, vec_id, embedding,
  1000*(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS start_ms, 400 + (vec_id % 5)*200 AS dur_ms FROM embeddings""",
    "fx_jobs": """SELECT o_orderkey AS id, nullif(o_custkey % 50, 0) AS tvdb_id,
  concat('show', CAST(o_custkey % 50 AS VARCHAR), '/e', CAST(o_custkey % 400 AS VARCHAR), '.mkv') AS video_path,
  CASE o_orderkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' WHEN 4 THEN 'skipped' ELSE 'cancelled' END AS status,
  CAST(epoch(o_orderdate) AS BIGINT) AS created_at, CASE WHEN o_orderkey % 40 IN (10, 20, 30) THEN o_orderkey - 10 END AS retry_of_job_id,
  o_orderkey % 5 AS recovery_count FROM orders""",
    "fx_job_events": """SELECT event_id, user_id AS job_id, epoch_us(ts) AS ts_us,
  CASE event_type WHEN 'signup' THEN 'ASR_STARTED' WHEN 'view' THEN 'ASR_PROGRESS' WHEN 'click' THEN 'TRANSLATION_STARTED'
       WHEN 'purchase' THEN 'TRANSLATION_PROGRESS' ELSE 'JOB_COMPLETED' END AS name, event_id % 101 AS position, 100 AS total FROM events""",
}
