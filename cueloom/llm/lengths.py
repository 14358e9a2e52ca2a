"""Token counts as an exact histogram of encoded lengths, with suffix sums for every context limit.

Documents are encoded whole and reduced to (length, documents) before anything is shuffled; the
histogram has one row per distinct length. Prefix and suffix sums are taken in two levels (blocks of
lengths, then lengths inside a block), so no task holds the whole histogram.

Defined results: null and empty texts have length 0; repeated rows count each; an empty table gives
an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.common import stored
from cueloom.llm.encoding import unit_encoder

#: Lengths of a block of the two-level sums.
BLOCK = 64


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(n_tokens): one row per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = unit_encoder(tokenizer)
        for batch in batches:
            for _, sizes in encode(batch.column(0)):
                yield pa.record_batch([pa.array(sizes, pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(count, "n_tokens bigint")


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length, written once so that no text is encoded again."""
    return stored(encoded_lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For every length L of the histogram: n_docs, tokens (of these), docs_from and tokens_from (length L or
    more), docs_upto, tokens_upto (length L or less), truncated_total (all documents cut to L ids)."""
    by = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("_block"))
    blocks = by.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    # one row per BLOCK lengths
    earlier, all_blocks = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    base = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(earlier), zero).alias("_d0"),
        F.coalesce(F.sum("_t").over(earlier), zero).alias("_t0"),
        F.sum("_d").over(all_blocks).alias("_docs"),
        F.sum("_t").over(all_blocks).alias("_tokens"),
    )
    upto = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    own = by.withColumn("_du", F.sum("n_docs").over(upto)).withColumn("_tu", F.sum("tokens").over(upto))
    out = own.join(base, "_block").withColumn("docs_upto", F.col("_d0") + F.col("_du")).withColumn("tokens_upto", F.col("_t0") + F.col("_tu"))
    return out.select(
        "n_tokens",
        "n_docs",
        "tokens",
        (F.col("_docs") - F.col("docs_upto") + F.col("n_docs")).alias("docs_from"),
        (F.col("_tokens") - F.col("tokens_upto") + F.col("tokens")).alias("tokens_from"),
        "docs_upto",
        "tokens_upto",
        (F.col("tokens_upto") + F.col("n_tokens") * (F.col("_docs") - F.col("docs_upto"))).alias("truncated_total"),
    )


def answer_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_cut, truncated_total, total) for any limits, also between lengths of the histogram."""
    ask = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context bigint")
    every = sums.agg(F.max("docs_upto").alias("_docs"), F.max("tokens_upto").alias("_total"))
    # the largest length within each limit: one conditional maximum per limit in a single pass
    below = sums.select("n_tokens", "docs_upto", "tokens_upto", F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("context")).where(F.col("n_tokens") <= F.col("context"))
    last = below.groupBy("context").agg(F.max("docs_upto").alias("_d"), F.max("tokens_upto").alias("_t"))
    full = ask.join(last, "context", "left").withColumn("_one", F.lit(1)).join(F.broadcast(every.withColumn("_one", F.lit(1))), "_one")
    cut = F.col("_docs") - F.coalesce(F.col("_d"), F.lit(0))
    return full.select("context", cut.alias("docs_cut"), (F.coalesce(F.col("_t"), F.lit(0)) + F.col("context") * cut).alias("truncated_total"), F.col("_total").alias("total"))


def answer_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents does not exceed."""
    docs = sums.agg(F.max("docs_upto").alias("_docs")).withColumn("_one", F.lit(1))
    asked = sums.withColumn("_one", F.lit(1)).join(F.broadcast(docs), "_one").select("n_tokens", "docs_upto", "_docs", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return asked.where(F.col("docs_upto") >= F.col("share") * F.col("_docs")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
