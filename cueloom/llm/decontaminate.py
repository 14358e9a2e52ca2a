"""Benchmark decontamination, in DataFrame functions only.

Item windows (13 words, or the whole of a shorter item) are gathered once. A document is scanned at
anchors: of a window of L words every document occurrence covers exactly one position that is a
multiple of L - k + 1 with a k-word gram inside it, so only those positions are hashed and met with
the set of item grams. Each hit is then verified by equality with the window's whole text.

Where the grams are too many for a broadcast, an anchor row carries the at most 25 words around it through the
shuffle, never the document.

Defined results: null or empty texts have no words and are never contaminated; items without words
have no window; equal rows give equal verdicts (one each); a benchmark without windows marks nothing;
an empty table gives no rows; a very long text is scanned whole, one anchor in nine words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import is_small, lower_ascii, small_side, split_words, stored, unused

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Words of an anchor gram; a window shorter than this is its own anchor.
ANCHOR = 5


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), GAP)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(span, n, grams, items): distinct windows as joined words with the sorted ids of their items."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = words.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("s"))
    spans = starts.select("item", F.slice("w", F.col("s") + 1, F.lit(window)).alias("g"))
    return spans.groupBy("g").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.array_join("g", " ").alias("span"), F.size("g").alias("n"), "g", "items")


def _gram(words: Column, at: Column, n: Column, anchor: int) -> Column:
    return F.xxhash64(n, F.slice(words, at + 1, F.least(n, F.lit(anchor))))


def anchors_of(windows: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """(h, n, off): where in a window of n words a gram stands."""
    at = windows.select("g", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - anchor, F.lit(0)))).alias("off"))
    return at.select(_gram(F.col("g"), F.col("off"), F.col("n"), anchor).alias("h"), F.col("off")).distinct()


def hits(docs: DataFrame, windows: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """Per (doc_id, text fingerprint): n_words and the verified occurrences (s, e) with their items.

    One pass over the texts: an anchor row per position, and a base row so that no document is lost.
    """
    windows = stored(windows)
    lengths = [r[0] for r in windows.select("n").distinct().collect()]  # at most WINDOW values
    grams = stored(anchors_of(windows, anchor))
    shuffled = not is_small(grams)
    grams, spans = small_side(grams), small_side(windows.select("span", "items"))
    size = F.col("n_words")

    def anchors(n: int) -> Column:
        k = min(n, anchor)
        step = n - k + 1
        seq = F.sequence(F.lit(0), size - k, F.lit(step))
        return F.when(size >= n, F.transform(seq, lambda p: F.struct(F.lit(n).alias("n"), p.alias("p"))))

    base = F.array(F.struct(F.lit(0).alias("n"), F.lit(-1).alias("p")))
    none = F.expr("array_remove(array(named_struct('n', 0, 'p', -1)), named_struct('n', 0, 'p', -1))")
    d = docs.select("doc_id", F.xxhash64("text").alias("fp"), words_of(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    every = F.concat(base, *[F.coalesce(anchors(n), none) for n in lengths])
    at = d.select("doc_id", "fp", "w", "n_words", F.explode(every).alias("a")).select("doc_id", "fp", "w", "n_words", "a.n", "a.p")
    is_base = F.col("p") < 0
    # where the grams are too many for a broadcast the rows are shuffled, so they carry the words
    # that a window over the gram can reach (2 * WINDOW - ANCHOR) and not the document's
    reach = max(lengths, default=anchor) - 1
    if shuffled:
        begin = F.greatest(F.col("p") - reach, F.lit(0))
        around = F.when(is_base, F.slice("w", 1, 0)).otherwise(F.slice("w", begin + 1, 2 * reach + 1))
        at = at.select("doc_id", "fp", "n_words", "n", "p", F.when(is_base, 0).otherwise(begin).alias("shift"), around.alias("w"))
    else:
        at = at.withColumn("shift", F.lit(0))
    keyed = at.withColumn("h", F.when(is_base, F.xxhash64("fp", "doc_id")).otherwise(_gram(F.col("w"), F.greatest(F.col("p") - F.col("shift"), F.lit(0)), F.col("n"), anchor)))
    met = keyed.join(grams, (keyed["h"] == grams["h"]) & (keyed["p"] >= 0), "left").drop(grams["h"])
    start = F.col("p") - F.col("off")
    inside = (start >= 0) & (start + F.col("n") <= size)
    met = met.where(is_base | inside).select(
        "doc_id",
        "fp",
        "n_words",
        "p",
        start.alias("s"),
        (start + F.col("n")).alias("e"),
        # a base row gets a key of its own that no window has: '#' is no word character
        F.when(is_base, F.concat(F.lit("#"), F.col("fp").cast("string"))).otherwise(F.array_join(F.slice("w", F.greatest(start - F.col("shift"), F.lit(0)) + 1, F.col("n")), " ")).alias("_span"),
    )
    found = met.join(spans, met["_span"] == spans["span"], "left").where(is_base | F.col("items").isNotNull())
    return found.groupBy("doc_id", "fp").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(is_base.cast("long")).alias("copies"),
        F.collect_set(F.when(~is_base, F.struct("s", "e"))).alias("spans"),
        F.collect_set("items").alias("items"),
    )


def _covered(spans: Column) -> Column:
    """Words inside the union of the spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["e"]).alias("end"))
    return F.aggregate(F.sort_array(spans), zero, step, lambda a: a["n"])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and fp (hash of its text)."""
    found = hits(docs, item_windows(benchmark, window))
    items = F.array_sort(F.array_distinct(F.flatten("items")))
    out = found.select(
        "doc_id",
        "fp",
        "n_words",
        F.when(F.size("spans") > 0, _covered(F.col("spans"))).otherwise(0).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("_copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, all columns kept."""
    doc, print_ = unused(docs, "_id", "_fp")
    bad = stored(scan(docs.select("doc_id", "text"), benchmark).where("contaminated").select(F.col("doc_id").alias(doc), F.col("fp").alias(print_)).distinct())
    return docs.join(small_side(bad), docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(print_)), "left_anti")


def _merged(spans: Column) -> Column:
    """Sorted spans with touching ones joined."""
    step = lambda a, x: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["e"] >= x["s"]),
        F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], x["e"]).alias("e")))),
    ).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(F.sort_array(spans), F.expr("cast(array() as array<struct<s:int,e:int>>)"), step)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the words of every hit span cut out of the text (each with the gap after it); other columns kept."""
    found = hits(docs.select("doc_id", "text"), item_windows(benchmark)).where(F.size("spans") > 0)
    cut = stored(found.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), _merged(F.col("spans")).alias("_spans")))
    any_word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # as WORD, before lower-casing
    words = F.regexp_extract_all("text", F.lit(f"({any_word})"), F.lit(1))
    gaps = F.split("text", any_word)
    own = F.struct(*docs.columns)
    both = docs.select(own.alias("_row"), "doc_id", "text", F.xxhash64("text").alias("fp")).join(small_side(cut), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left")
    keep = lambda w, i: F.when(F.exists("_spans", lambda x: (x["s"] <= i) & (i < x["e"])), F.lit("")).otherwise(F.concat(w, F.get(gaps, i + 1)))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(words, keep), "")))
    return both.select("_row", text.alias("_text")).select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.{c}") for c in docs.columns])
