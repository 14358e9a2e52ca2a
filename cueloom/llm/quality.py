"""Quality rules with host verdicts, in DataFrame functions only.

A document is measured by row-local expressions. Rule failures are summed per host (partial sums
before the shuffle, so a host with a third of all rows is one row per task), host rates are shrunk
towards an empirical beta prior fitted over all hosts, and the verdict of a host is joined back.

Defined results: null text counts as empty (no words, base_failed); a null host has no verdict and
does not fail its documents; repeated rows are measured one by one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import small_side, split_words, stored, unused

GAP = r"[\x20\x09-\x0D]+"
#: rule -> failed, over the measures below
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE = ("short", "repeated")
#: A host is rejected when the shrunk failure rate of any rule exceeds this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength in pseudo-documents.
PRIOR_STRENGTH = (1.0, 1e6)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (longs)."""
    kept = [c for c in docs.columns if c not in {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"}]
    words, lines, grams, places = unused(docs, "_words", "_lines", "_grams", "_at")
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(
        *kept,
        split_words(F.col(text), GAP).alias(words),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
    )
    size = F.size(words)
    word = F.col(words)
    step = step.withColumn(
        grams,
        F.transform(F.slice(word, F.lit(1), F.greatest(size - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(word, i + 1), F.get(word, i + 2))),
    )
    at = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    step = step.withColumn(places, F.when(F.size(F.array_distinct(grams)) < F.size(grams), at))
    pair = F.col(places)
    twice = F.filter(pair, lambda x, k: F.coalesce(F.get(pair, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(pair, k + 1)["g"] == x["g"], F.lit(False)))
    cover = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return step.select(
        *kept,
        size.cast("long").alias("n_words"),
        (F.char_length(body) - F.regexp_count(body, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(pair.isNull(), 0).otherwise(F.size(cover)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return F.expr(" OR ".join(f"({RULES[r]})" for r in BASE))


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """(host, rule, n_docs, n_failed, rate): failure rates shrunk towards a beta prior.

    The prior of a rule has the pooled rate m as its mean; its strength follows from the variance
    of host rates that sampling does not explain (method of moments).
    """
    sums = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.expr(f"({rule})").cast("long")).alias(f"_{name}") for name, rule in RULES.items()]
    )
    long = sums.select("host", "n_docs", F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*[F.col(f"_{r}") for r in RULES]))).alias("rule", "n_failed"))
    moments = long.groupBy("rule").agg(
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("f"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff"),
    )
    m = F.col("f") / F.col("n")
    between = F.col("ff") / F.col("n") - m * m - m * (1 - m) * F.col("hosts") / F.col("n")
    strength = F.when(between > 0, m * (1 - m) / between - 1).otherwise(PRIOR_STRENGTH[1])
    prior = moments.select("rule", m.alias("_m"), F.least(F.greatest(strength, F.lit(PRIOR_STRENGTH[0])), F.lit(PRIOR_STRENGTH[1])).alias("_s"))
    # one row per rule, and RULES is a fixed list
    return long.join(F.broadcast(prior), "rule").select(
        "host", "rule", "n_docs", "n_failed", ((F.col("n_failed") + F.col("_m") * F.col("_s")) / (F.col("n_docs") + F.col("_s"))).alias("rate")
    )


def bad_hosts(measured: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Hosts (one row each) whose shrunk failure rate exceeds max_rate for any rule."""
    return host_rates(measured, host).groupBy("host").agg(F.max("rate").alias("_rate")).where(F.col("_rate") > max_rate).select(F.col("host").alias("_host"))


def judge(measured: DataFrame, bad: DataFrame, host: str = "source") -> DataFrame:
    """measured plus base_failed, host_kept and kept."""
    verdict = small_side(stored(bad)).withColumn("_bad", F.lit(True))
    return (
        measured.join(verdict, F.col(host) == F.col("_host"), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("host_kept", F.col("_bad").isNull())
        .withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
        .drop("_host", "_bad")
    )


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, host_kept, kept."""
    measured = stored(measures(docs.select("doc_id", F.col(host).alias("_source"), "text")).drop("text"))
    return judge(measured, bad_hosts(measured, "_source"), "_source").drop("_source")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass, with all their columns and only those.

    Measures are taken twice (once for the hosts, once for the rows that stay) so that texts never
    move: the second pass is a filter beside the scan.
    """
    slim = measures(docs.select("text", F.col(host).alias("_source"))).drop("text")
    bad = bad_hosts(slim, "_source")
    own = measures(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"), F.col(host).alias("_source"))).drop("text")
    # a one-row generator keeps the filter above the measures, which would else be copied into it term by term
    taken = [c for c in own.columns if not c.startswith("_")]
    once = own.select("_row", "_source", F.inline(F.array(F.struct(*taken))))
    return judge(once, bad, "_source").where("kept").select("_row.*")
