"""Comparison of two timed tracks with joins, windows and aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions import text as X
from cueloom.functions.sequence import asof_join, interval_join, neighbours, once, point_join, rank_pick, scan, with_halo
from cueloom.operators.qc import Constraints
from cueloom.session import cut_lineage

# Number words, spelling variants and word lists of the metrics.
UNITS = ["", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz"]
TENS = ["", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan"]
VARIANTS = {"valla": "vallahi", "abicim": "abiciğim", "baya": "bayağı", "napıyorsun": "ne yapıyorsun", "naber": "ne haber", "yo": "yok", "bi": "bir", "tabi": "tabii", "eee": "ee", "eeee": "ee"}
VOCALIZATIONS = ("ah", "aah", "eh", "ha", "hah", "heh", "hmm", "hm", "mm", "oh", "uh", "um")
BRIEF = ("ouch", "ow", "amen", "wow", "huh", "hey")
INTERJECTIONS = ("aa", "ay", "off", "of", "hadi", "hı", "vay", "oy", "eh", "aman", "yaa", "tüh", "vov", "oha", "aha", "hah", "hop", "ah", "oh")
REFERENCE_END = r"[.!?…。！？]['\"」』)\]]*$"
WINDOW_MS = 60_000
CHRF_ORDER, CHRF_BETA = 6, 2.0
SHORT_CUE_CHARS = 10
NEAR_MS, BETWEEN_MS = 2000, 5000


# ---------------------------------------------------------------- tokens

def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def turkish_number(n: Column) -> Column:
    """Number words of 0..9999 as an array."""
    units, tens = F.array(*map(F.lit, UNITS)), F.array(*map(F.lit, TENS))
    digit = lambda d: F.floor(n / d).cast("int") % 10
    counted = lambda d, word: F.when(digit(d) == 0, F.array(F.lit(""))).when(digit(d) == 1, F.array(F.lit(word))).otherwise(F.array(F.element_at(units, digit(d) + 1), F.lit(word)))
    parts = F.concat(counted(1000, "bin"), counted(100, "yüz"), F.array(F.element_at(tens, digit(10) + 1), F.element_at(units, digit(1) + 1)))
    return F.when(n == 0, F.array(F.lit("sıfır"))).otherwise(F.filter(parts, lambda w: w != ""))


def _unmarked(text: Column) -> Column:
    marked = F.regexp_replace(text, r"\([^)]*\)|\[[^\]]*\]|<[^>]+>|\{[^}]*\}|（[^）]*）|[♪♫]", " ")
    return F.when(text.rlike(r"[(\[<{（♪♫]"), marked).otherwise(text)


def _word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def turkish_tokens(text: Column) -> Column:
    t = F.lower(F.translate(_unmarked(text), "Iİ", "ıi"))
    t = F.regexp_replace(F.translate(t, "âîû", "aiu"), "['’]", "")

    def expand(token: Column) -> Column:
        digits = F.regexp_extract(token, r"^(\d{1,4})\D*$", 1)
        tail = F.regexp_extract(token, r"^\d{1,4}(\D*)$", 1)
        words = turkish_number(digits.cast("int"))
        last = F.concat(F.element_at(words, -1), tail)
        spoken = F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(last))
        return F.when(digits != "", spoken).otherwise(F.split(F.coalesce(_table(VARIANTS)[token], token), " "))

    return F.flatten(F.transform(_word_list(t), expand))


def normalize_tokens(text: Column, lang: str) -> Column:
    """Comparable tokens of one language; unspaced scripts give characters.

    Text outside Turkish should be NFKC already (``functions.text.nfkc``).
    """
    if lang == "tr":
        return turkish_tokens(text)
    low = F.lower(_unmarked(text))
    if lang in X.UNSPACED:
        if lang == "ja":
            kata = "".join(map(chr, range(ord("ァ"), ord("ヶ") + 1)))
            low = F.translate(low, kata, "".join(chr(ord(c) - 96) for c in kata))
        kept = F.regexp_replace(low, r"[^\p{L}\p{M}\p{N}]", "")
        return F.filter(F.split(kept, ""), lambda c: c != "")
    return _word_list(low)


def token_windows(cues: DataFrame, tokens: Column, idx: str = "cue_idx", key: str = "media_id") -> DataFrame:
    """Tokens per 60-second window of the cue midpoint, in cue order."""
    win = F.floor((F.col("start_ms") + F.col("end_ms")) / (2 * WINDOW_MS))
    d = cues.select(key, win.alias("minute"), F.col(idx).alias("i"), tokens.alias("t"))
    # tokens cross the shuffle as texts
    text, rest = X.packed(F.col("t"))
    d = d.select(key, "minute", F.struct("i", text.alias("j"), rest.alias("t")).alias("_s"))
    d = d.groupBy(key, "minute").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    texts = F.split(F.array_join(F.transform("_s", lambda s: s["j"]), X.TOKEN_MARK), X.TOKEN_MARK)
    each = F.flatten(F.transform("_s", lambda s: F.coalesce(s["t"], F.split(s["j"], X.TOKEN_MARK))))
    return d.select(key, "minute", F.when(F.exists("_s", lambda s: s["j"].isNull()), each).otherwise(texts).alias("tokens"))


def pair_windows(ref: DataFrame, hyp: DataFrame, key: str = "media_id") -> DataFrame:
    empty = F.array().cast("array<string>")
    both = ref.withColumnRenamed("tokens", "ref").join(hyp.withColumnRenamed("tokens", "hyp"), [key, "minute"], "full")
    return both.select(key, "minute", F.coalesce("ref", empty).alias("ref"), F.coalesce("hyp", empty).alias("hyp"))


def _edit_distance(a: str, b: str) -> int:
    """Edit distance by bit vectors: one step per character of ``a``, whatever the length of ``b``."""
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    ones = (1 << len(b)) - 1
    # differences to the prefix of b that is one shorter: one more, one less
    up, down = ones, 0
    for c in a:
        same = at.get(c, 0) | down
        level = (((same & up) + up) ^ up) | same
        more = (down | ones ^ ((up | level) & ones)) << 1 | 1
        up = ((up & level) << 1 | ~(level | more)) & ones
        down = more & level & ones
    return len(a) + up.bit_count() - down.bit_count()


@F.pandas_udf(T.LongType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def char_errors(windows: DataFrame) -> DataFrame:
    """Character edits and reference length per window."""
    a, b = F.array_join("ref", " "), F.array_join("hyp", " ")
    return windows.withColumns({"char_errors": F.when(a == b, F.lit(0).cast("bigint")).otherwise(edit_distance(a, b)), "ref_chars": F.length(a).cast("bigint")})


def error_rates(aligned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pooled rates in percent over windows carrying subs, dels, inss, ref_words, char_errors, ref_chars."""
    n = F.greatest(F.sum("ref_words"), F.lit(1))
    pct = lambda c: 100 * c / n
    return aligned.groupBy(*keys).agg(
        pct(F.sum(F.col("subs") + F.col("dels") + F.col("inss"))).alias("wer"), pct(F.sum("subs")).alias("subst"), pct(F.sum("dels")).alias("missed"),
        pct(F.sum("inss")).alias("extra"), (100 * F.sum("char_errors") / F.greatest(F.sum("ref_chars"), F.lit(1))).alias("cer"), F.sum("ref_words").alias("ref_words"))


def name_counts(windows: DataFrame, tokens: str, names: DataFrame, key: str = "media_id") -> DataFrame:
    """Name hits per window: a token is a name or a name plus up to four letters.

    A token offers its own prefixes, so the match is an equi join; the first
    name in glossary order wins per token.
    """
    t = windows.select(key, "minute", F.posexplode(tokens).alias("pos", "token"))
    n = F.length("token")
    t = t.withColumn("name_key", F.explode(F.transform(F.sequence(F.greatest(n - 4, F.lit(1)), n), lambda k: F.substring(F.col("token"), F.lit(1), k))))
    hit = t.join(names.select("name_key", "display", "name_order"), "name_key")
    first = hit.groupBy(key, "minute", "pos").agg(F.min_by("display", "name_order").alias("display"))
    return first.groupBy(key, "minute", "display").agg(F.count("*").alias("n"))


def name_recall(windows: DataFrame, names: DataFrame, key: str = "media_id") -> DataFrame:
    r = name_counts(windows, "ref", names, key).withColumnRenamed("n", "ref_n")
    h = name_counts(windows, "hyp", names, key).withColumnRenamed("n", "hyp_n")
    j = r.join(h, [key, "minute", "display"], "left")
    return j.groupBy("display").agg(F.sum("ref_n").alias("in_reference"), F.sum(F.least("ref_n", F.coalesce("hyp_n", F.lit(0)))).alias("found"))


def worst_windows(aligned: DataFrame, k: int = 8, min_words: int = 10, key: str = "media_id") -> DataFrame:
    """The k windows with the highest error share, among those with enough words."""
    err = F.col("subs") + F.col("dels") + F.col("inss")
    d = aligned.where(F.col("ref_words") >= min_words).select(key, "minute", err.alias("errors"), "ref_words")
    return d.orderBy(F.desc(F.col("errors") / F.col("ref_words")), key, "minute").limit(k)


# ---------------------------------------------------------------- chrF

@F.pandas_udf(T.ArrayType(T.LongType()))
def chrf_stats(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """(matches, hyp, ref) n-gram totals for n = 1..6 of one pair."""
    from collections import Counter

    def grams(text: str, n: int) -> Counter:
        return Counter(text[i:i + n] for i in range(len(text) - n + 1))

    def one(h: str, r: str) -> list[int]:
        h, r, out = h.replace(" ", ""), r.replace(" ", ""), []
        for n in range(1, CHRF_ORDER + 1):
            out += [(grams(h, n) & grams(r, n)).total(), max(len(h) - n + 1, 0), max(len(r) - n + 1, 0)]
        return out

    return pd.Series([one(h, r) for h, r in zip(hyp, ref)])


def chrf(pairs: DataFrame, keys: Sequence[str] = (), hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Corpus chrF per key: statistics are summed, then scored once."""
    d = pairs.select(*keys, chrf_stats(hyp, ref).alias("_s"))
    sums = d.groupBy(*keys).agg(F.count("*").alias("pairs"), *[F.sum(F.element_at("_s", i + 1)).alias(f"_{i}") for i in range(3 * CHRF_ORDER)])
    return sums.select(*keys, "pairs", chrf_score_columns().alias("chrf"))


def chrf_score_columns() -> Column:
    """Score from the 18 summed statistics ``_0`` .. ``_17``."""
    safe = lambda i: F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("double")
    p = s = n = F.lit(0.0)
    for k in range(CHRF_ORDER):
        m, h, r = safe(3 * k), safe(3 * k + 1), safe(3 * k + 2)
        ok = (h > 0) & (r > 0)
        p = p + F.when(ok, F.try_divide(m, h)).otherwise(0.0)
        s = s + F.when(ok, F.try_divide(m, r)).otherwise(0.0)
        n = n + F.when(ok, 1.0).otherwise(0.0)
    p, r = F.coalesce(F.try_divide(p, n), F.lit(0.0)), F.coalesce(F.try_divide(s, n), F.lit(0.0))
    b2 = CHRF_BETA ** 2
    return F.coalesce(F.try_divide(100 * (1 + b2) * p * r, b2 * p + r), F.lit(0.0))


#: Cumulative Poisson(1) chances, as far as doubles can tell them from one.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 18.0)])))


def poisson_weights(rows: np.ndarray, rounds: int) -> np.ndarray:
    """Poisson(1) weights of every row (by its hash) in every round; rows by rounds."""
    numbers = (np.arange(rounds, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = rows.view(np.uint64)[:, None] ^ numbers[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    uniform = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(POISSON, uniform, side="right")


def bootstrap(stats: DataFrame, ids: Sequence[str], columns: Sequence[str], rounds: int, seed: int) -> DataFrame:
    """Weighted sums of ``columns`` per round.

    Each row draws its own Poisson weight per round (the standard resampling for
    data that does not fit one machine), so rows are never redistributed: a task
    multiplies its batches by their weights and sends on ``rounds`` partial sums.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rounds, len(columns)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values = np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in columns])
                total += poisson_weights(part.column("_h").to_numpy(), rounds).T @ np.nan_to_num(values)
        yield pa.record_batch([pa.array(np.arange(rounds)), *map(pa.array, total.T)], ["round", *columns])

    d = stats.select(F.xxhash64(F.lit(seed), *ids).alias("_h"), *[F.col(c).cast("double").alias(c) for c in columns])
    part = d.mapInArrow(sums, "round bigint, " + ", ".join(f"`{c}` double" for c in columns))
    return part.groupBy("round").agg(*[F.sum(c).alias(c) for c in columns])


def interval_95(deltas: DataFrame, value: str, rounds: int) -> DataFrame:
    """Nearest-rank 2.5% and 97.5% of the per-round values (``rounds`` rows)."""
    ordered = deltas.agg(F.array_sort(F.collect_list(value)).alias("_v"))
    return ordered.select(F.element_at("_v", int(0.025 * rounds) + 1).alias("low"), F.element_at("_v", int(0.975 * rounds) + 1).alias("high"))


def bootstrap_delta(windows: DataFrame, ids: Sequence[str], rounds: int = 1000, seed: int = 11) -> DataFrame:
    """95% interval of the WER difference of systems a and b over shared windows."""
    s = bootstrap(windows, ids, ["err_a", "n_a", "err_b", "n_b"], rounds, seed)
    one = F.lit(1)
    delta = 100 * (F.col("err_b") / F.greatest("n_b", one) - F.col("err_a") / F.greatest("n_a", one))
    return interval_95(s.select(delta.alias("delta")), "delta", rounds)


def bootstrap_chrf(pairs: DataFrame, ids: Sequence[str], rounds: int = 1000, seed: int = 13) -> DataFrame:
    """95% interval of chrF(b) - chrF(a) over pairs with columns ref, hyp_a, hyp_b."""
    d = pairs.select(*ids, chrf_stats("hyp_a", "ref").alias("_a"), chrf_stats("hyp_b", "ref").alias("_b"))
    names = [f"{s}{i}" for s in "ab" for i in range(18)]
    flat = d.select(*ids, *[F.element_at(f"_{n[0]}", int(n[1:]) + 1).alias(n) for n in names])
    s = bootstrap(flat, ids, names, rounds, seed)

    def score(side: str) -> DataFrame:
        return s.select("round", *[F.col(f"{side}{i}").alias(f"_{i}") for i in range(18)]).select("round", chrf_score_columns().alias(side))

    return interval_95(score("a").join(score("b"), "round").select((F.col("b") - F.col("a")).alias("delta")), "delta", rounds)


# ---------------------------------------------------------------- cue pairing

def _ref_side(ref: DataFrame, key: str, idx: str) -> DataFrame:
    return ref.select(key, F.col(idx).alias("ref_idx"), F.col("start_ms").alias("ref_start"), F.col("end_ms").alias("ref_end"), F.col("text").alias("ref_text"))


def _overlap() -> Column:
    return F.least("end_ms", "ref_end") - F.greatest("start_ms", "ref_start")


def pair_cues(source: DataFrame, ref: DataFrame, key: str = "media_id", idx: str = "cue_idx") -> DataFrame:
    """References that lie mostly inside a source cue and together cover half of it."""
    j = interval_join(source, _ref_side(ref, key, idx), [key], ("start_ms", "end_ms"), ("ref_start", "ref_end")).withColumn("_ov", _overlap())
    j = j.where(2 * F.col("_ov") >= F.col("ref_end") - F.col("ref_start"))
    g = j.groupBy(key, idx).agg(F.sum("_ov").alias("_cov"), F.first(F.col("end_ms") - F.col("start_ms")).alias("_dur"), F.array_sort(F.collect_list(F.struct("ref_idx", "ref_text"))).alias("_r"))
    raw = F.array_join(F.transform("_r", lambda r: r["ref_text"]), " ")
    g = g.where(2 * F.col("_cov") >= F.col("_dur")).select(key, idx, once(raw).alias("_raw"))
    g = g.where(~X.is_lyric_start(F.ltrim("_raw", F.lit("-( ")))).select(key, idx, X.clean_reference("_raw").alias("reference"))
    return g.where("reference <> ''")


def uncovered_cues(source: DataFrame, ref: DataFrame, key: str = "media_id", idx: str = "cue_idx", share: float = 0.1) -> DataFrame:
    """Reference cues whose summed source overlap stays below a tenth of their length."""
    r = _ref_side(ref, key, idx)
    j = interval_join(source.select(key, "start_ms", "end_ms"), r, [key], ("start_ms", "end_ms"), ("ref_start", "ref_end"))
    cov = j.groupBy(key, "ref_idx").agg(F.sum(_overlap()).alias("_cov"))
    d = r.join(cov, [key, "ref_idx"], "left")
    return d.where(F.coalesce("_cov", F.lit(0)) < share * (F.col("ref_end") - F.col("ref_start"))).drop("_cov")


def classify_gaps(gaps: DataFrame, source: DataFrame, key: str = "media_id", near_ms: int = NEAR_MS, between_ms: int = BETWEEN_MS) -> DataFrame:
    """Kind of each uncovered reference cue from its text and its nearest source cues."""
    ends = source.select(key, F.col("end_ms").alias("at"), "text")
    starts = source.select(key, F.col("start_ms").alias("at"), "text")
    # each as-of join reads both sides twice
    ends, starts = cut_lineage(ends), cut_lineage(starts)
    d = cut_lineage(asof_join(cut_lineage(gaps), ends, [key], "ref_start", "at", ["at", "text"], "before"))
    d = asof_join(d, starts, [key], "ref_end", "at", ["at", "text"], "after", direction="forward")
    d = d.withColumns({"before_ms": F.col("ref_start") - F.col("before.at"), "after_ms": F.col("after.at") - F.col("ref_end")})
    words = F.regexp_extract_all(X.casefold(X.clean_reference("ref_text")), F.lit("[a-z]+"), F.lit(0))
    voiced = (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*VOCALIZATIONS))
    brief = (F.size(words) == 1) & F.element_at(words, 1).isin(*BRIEF)
    near = F.least("before_ms", "after_ms") <= near_ms
    kind = (
        F.when(X.is_song_or_sound("ref_text"), "reference_non_dialogue").when(voiced, "reference_vocalization").when(brief, "brief_reference_utterance")
        .when(near, "nearby_source_boundary").when((F.col("before_ms") <= between_ms) & (F.col("after_ms") <= between_ms), "between_source_cues").otherwise("isolated_asr_gap")
    )
    return d.select(key, "ref_idx", "ref_start", "ref_end", kind.alias("classification"), "before_ms", "after_ms", F.col("before.text").alias("before_source"), F.col("after.text").alias("after_source"))


def gap_summary(classified: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return classified.groupBy(*keys, "classification").agg(F.count("*").alias("count"), F.sum(F.col("ref_end") - F.col("ref_start")).alias("duration_ms"))


def fragmentation(cues: DataFrame, ref: DataFrame, key: str = "media_id", idx: str = "cue_idx") -> DataFrame:
    """How our cues cut up each human cue, per track."""
    human = _ref_side(ref, key, idx).where(~X.is_song_or_sound("ref_text"))
    mids = cues.select(key, ((F.col("start_ms") + F.col("end_ms")) / 2).alias("_mid"))
    per = point_join(mids, human, [key], "_mid", ("ref_start", "ref_end")).groupBy(key, "ref_idx").agg(F.count("*").alias("_k"))
    cut = per.groupBy(key).agg(F.avg("_k").alias("cues_per_human_cue"), F.avg((F.col("_k") >= 2).cast("double")).alias("split_rate"))
    t = X.strip("text")
    open_end = (~t.rlike(REFERENCE_END)).cast("bigint")
    own = cues.groupBy(key).agg(F.count("*").alias("cues"), F.avg((F.length(t) <= SHORT_CUE_CHARS).cast("double")).alias("short_rate"), F.sum(open_end).alias("_open"), F.max_by(open_end, F.col(idx)).alias("_last"))
    d = own.join(cut, key, "left")
    return d.select(key, "cues", "cues_per_human_cue", "split_rate", "short_rate", F.when(F.col("cues") > 1, (F.col("_open") - F.col("_last")) / (F.col("cues") - 1)).alias("mid_sentence_rate"))


def prf(tp: Column, ref_n: Column, hyp_n: Column) -> dict[str, Column]:
    """Precision, recall and F1 with zero for an empty side."""
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(tp.cast("double"), hyp_n), zero)
    r = F.coalesce(F.try_divide(tp.cast("double"), ref_n), zero)
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), zero)}


def track_stats(cues: DataFrame, key: str = "media_id", idx: str = "cue_idx", limits: Constraints = Constraints()) -> DataFrame:
    """Structure and readability of each track in one aggregate."""
    d = neighbours(cues, [key], idx, lead={"_next": "start_ms"}).withColumn("_ms", F.col("end_ms") - F.col("start_ms"))
    long_line = F.exists("lines", lambda x: F.length(x) > limits.max_line_chars)
    return d.groupBy(key).agg(
        F.count("*").alias("cue_count"), F.avg("_ms").alias("average_ms"), F.median("_ms").alias("median_ms"), F.min("_ms").alias("min_ms"), F.max("_ms").alias("max_ms"),
        F.count_if(F.col("_ms") < limits.min_ms).alias("short_count"), F.count_if(F.col("_next") < F.col("end_ms")).alias("overlap_count"),
        F.count_if((F.col("_ms") > 0) & (F.length("text") * 1000 > F.lit(limits.max_cps) * F.col("_ms"))).alias("over_cps"),
        F.count_if(long_line).alias("over_chars"), F.count_if(F.col("_ms") > limits.max_ms).alias("over_duration"))


# ---------------------------------------------------------------- timing

def cue_words(text: str | Column) -> Column:
    return F.regexp_extract_all(X.casefold(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def timed_tokens(cues: DataFrame, key: str = "media_id", idx: str = "cue_idx") -> DataFrame:
    """Words with times spread evenly inside their cue."""
    d = cues.select(key, idx, "start_ms", "end_ms", once(cue_words("text")).alias("_w"))
    d = d.select(key, idx, "start_ms", "end_ms", F.size("_w").alias("_n"), F.posexplode("_w").alias("pos", "token"))
    at = F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * (F.col("pos") + 0.5) / F.col("_n")
    return d.select(key, idx, F.col("pos").cast("bigint").alias("pos"), "token", at.alias("at_ms"))


def cue_offsets(ref: DataFrame, candidate: DataFrame, key: str = "media_id", idx: str = "cue_idx") -> DataFrame:
    """Offset of each candidate cue from its best reference cue.

    Equal wording first (nearest on either side by two as-of joins, so repeated
    lines never pair all with all), else the nearest overlapping cue.
    """
    # every step reads its input more than once
    norm = F.array_join(cue_words("text"), " ")
    r = ref.select(key, norm.alias("_w"), (F.col("start_ms") + F.col("end_ms")).alias("_m"), "start_ms", "end_ms", F.col(idx).alias("ref_idx"))
    r = cut_lineage(r)
    c = candidate.select(key, F.col(idx).alias("cand_idx"), norm.alias("_w"), (F.col("start_ms") + F.col("end_ms")).alias("_m"), "start_ms", "end_ms")
    rw = r.where("_w <> ''").select(key, "_w", "_m")
    near = cut_lineage(asof_join(cut_lineage(c), rw, [key, "_w"], "_m", "_m", ["_m"], "_back"))
    near = asof_join(near, rw, [key, "_w"], "_m", "_m", ["_m"], "_fore", direction="forward")
    back, fore = F.col("_m") - F.col("_back._m"), F.col("_fore._m") - F.col("_m")
    same = F.when(fore.isNull() | (back <= fore), back).otherwise(-fore)
    near = cut_lineage(near.select(key, "cand_idx", "start_ms", "end_ms", "_m", same.alias("_d")))
    left = near.where("_d IS NULL").select(key, "cand_idx", "start_ms", "end_ms", F.col("_m").alias("_cm"))
    rr = r.select(key, "ref_idx", F.col("start_ms").alias("ref_start"), F.col("end_ms").alias("ref_end"), "_m")
    over = interval_join(left, rr, [key], ("start_ms", "end_ms"), ("ref_start", "ref_end"))
    d = F.col("_cm") - F.col("_m")
    over = over.groupBy(key, "cand_idx").agg(F.min_by(d, F.struct(F.abs(d), "ref_idx")).alias("_d"), F.first("_cm").alias("_m"))
    both = near.where("_d IS NOT NULL").select(key, "cand_idx", "_d", "_m").unionByName(over)
    return both.select(key, "cand_idx", (F.col("_d") / 2).alias("offset_ms"), (F.col("_m") / 2).alias("at_ms"))


def window_median_range(offsets: DataFrame, key: str = "media_id", at: str = "at_ms", value: str = "offset_ms", ties: Sequence[str] = (), windows: int = 6, per_window: int = 10) -> DataFrame:
    """Spread of the medians of six equal-count runs in time; the remainder is dropped."""
    n = offsets.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= windows * per_window)
    d = scan(offsets, [key], at, {"_rank": ("count", F.lit(1))}, ties=list(ties), block=600_000).join(n, key)
    d = d.withColumn("_win", F.floor(F.col("_rank") / F.floor(F.col("_n") / windows))).where(F.col("_win") < windows)
    m = d.groupBy(key, "_win").agg(F.median(value).alias("_med"))
    return m.groupBy(key).agg((F.max("_med") - F.min("_med")).alias("median_range"))


def timing_report(offsets: DataFrame, key: str = "media_id", at: str = "at_ms", value: str = "offset_ms", ties: Sequence[str] = ()) -> DataFrame:
    """Offset statistics per track and a constant / drifting verdict (integer milliseconds)."""
    base = offsets.groupBy(key).agg(F.count("*").alias("matched"), F.avg(value).alias("mean_ms"), F.median(value).alias("median_ms"), F.stddev_pop(value).alias("_sd"), F.regr_slope(value, at).alias("_slope"))
    p95 = rank_pick(offsets, [key], value, {"p95_ms": F.floor((F.col("n") - 1) * 95 / 100)}).drop("n")
    spread = window_median_range(offsets, key, at, value, ties)
    slope = F.coalesce("_slope", F.lit(0.0))
    steady = F.coalesce(F.col("median_range") < 500, F.col("_sd") < 250)
    kind = F.when(F.col("matched") < 2, "insufficient_matches").when((F.abs(slope) < 0.001) & steady, "constant_offset").otherwise("drift_or_nonlinear")
    return base.join(p95, key).join(spread, key, "left").select(key, "matched", "mean_ms", "median_ms", "p95_ms", slope.alias("drift"), "median_range", kind.alias("classification"))


def drop_outliers(anchors: DataFrame, key: str = "media_id", idx: str = "idx", value: str = "offset_ms", reach: int = 4, limit_ms: int = 1000) -> DataFrame:
    """Anchors that agree with the median of the four before or the four after."""
    d, w, own = with_halo(anchors, [key], idx, reach)

    def median(values: Column) -> Column:
        v = F.array_sort(values)
        n = F.size(v)
        mid = F.floor(n / 2).cast("int")
        return F.when(n % 2 == 1, F.get(v, mid).cast("double")).otherwise((F.get(v, mid - 1) + F.get(v, mid)) / 2)

    d = d.withColumns({"_pre": F.collect_list(value).over(w.rowsBetween(-reach, -1)), "_post": F.collect_list(value).over(w.rowsBetween(1, reach))}).where(own)
    agrees = lambda side: F.when(F.size(side) > 0, F.abs(F.col(value) - median(F.col(side))) <= limit_ms)
    a, b = agrees("_pre"), agrees("_post")
    keep = F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)) | (a.isNull() & b.isNull())
    return d.where(keep).select(*anchors.columns)


# ---------------------------------------------------------------- blocks and diffs

def classify_blocks(blocks: DataFrame) -> DataFrame:
    """Category of an aligned block; a semantic score can only raise the similarity."""
    sim = F.greatest("lexical", F.coalesce("semantic", F.col("lexical")))
    single = (F.col("gen_n") == 1) & (F.col("ref_n") == 1)
    kind = (
        F.when(F.col("ref_n") == 0, "INSERTED_CONTENT").when(F.col("gen_n") == 0, "DROPPED_UTTERANCE")
        .when(sim >= 0.6, F.when(F.col("timing") < 0.25, "TIMING_DIFFERENCE").when(~single, "SEGMENTATION_DIFFERENCE").when(F.col("exact"), "CORRECT").otherwise("NORMALIZATION_DIFFERENCE"))
        .when(~single & (sim >= 0.28), "SEGMENTATION_DIFFERENCE").when(sim > 0, "SUBSTITUTION").otherwise("UNKNOWN")
    )
    return blocks.withColumn("category", kind)


def summarize_alignment(classified: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return classified.groupBy(*keys, "category").agg(F.count("*").alias("n"))


def compare_tracks(base: DataFrame, candidate: DataFrame, key: str = "media_id", idx: str = "cue_idx") -> DataFrame:
    """Cues with the same number and times in both tracks, and how many differ in text."""
    b = base.select(key, idx, "start_ms", "end_ms", F.col("text").alias("_a"))
    c = candidate.select(key, idx, "start_ms", "end_ms", F.col("text").alias("_b"))
    j = b.join(c, [key, idx, "start_ms", "end_ms"])
    return j.groupBy(key).agg(F.count("*").alias("same_timing"), F.count_if(F.col("_a") != F.col("_b")).alias("text_differences"))


def diff_count(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys))
    return j.agg(F.count("*").alias("lines"), F.count_if(F.col("_a") != F.col("_b")).alias("differing"))


def blind_sample(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, n: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sheet, key): n differing lines in hash order, sides shuffled per row by hash."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys)).where(~F.col("_a").eqNullSafe(F.col("_b")))
    cols = [F.col(k) for k in keys]
    picked = j.withColumn("_h", F.xxhash64(F.lit(seed), *cols)).orderBy("_h", *keys).limit(n)
    flip = F.pmod(F.xxhash64(F.lit(seed + 1), *cols), F.lit(2)) == 1
    sheet = picked.select(*keys, F.when(flip, F.col("_b")).otherwise(F.col("_a")).alias("side_a"), F.when(flip, F.col("_a")).otherwise(F.col("_b")).alias("side_b"))
    return sheet, picked.select(*keys, F.when(flip, "second").otherwise("first").alias("a_is"))
