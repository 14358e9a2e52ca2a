"""Segmentation that columns, halo windows and block scans can express."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.functions.sequence import BLOCK_ROWS, islands, neighbours, once, scan
from cueloom.operators.qc import Constraints

# Lexicons, marks and thresholds.
TURN_END = r"[.!?…]['\"»)\]]*$"
QUESTION_END = r"\?['\"»)\]]*$"
ANY_END = r"[.!?…]['\"»)\]」』）】]*(?:\s|$)|[。？！]['\"»)\]」』）】]*"
PAUSE_MS, MIN_TURN_MS = 600, 150
MIN_CHUNK_MS, SAME_SPEAKER = 600, 0.6
REAL = ("real_acoustic_gap", "utterance_end")
MERGEABLE = ("display_split", "max_duration", "max_length")
MIN_CLAUSE_CHARS, MIN_CLAUSE_PROB, MIN_RUN = 20, 0.9, 3
AFFIX_STRIP = ".,!?;:\"'()[]…"


@dataclass(frozen=True)
class Lexicon:
    titles: tuple[str, ...] = ()
    conjunctions: tuple[str, ...] = ()
    clingy: tuple[str, ...] = ()


ENGLISH = Lexicon(
    tuple("mr mrs ms mx dr prof sr jr st".split()),
    tuple("and but so because if when while although though since unless then yet or nor".split()),
    tuple("""a an the my your his her its our their this that these those am is are was were be been being do does did have has had will would shall
    should can could may might must""".split()),
)
TURKISH = Lexicon(tuple("dr prof sn av doç".split()), tuple("ve ama fakat çünkü ancak veya yoksa oysa".split()))
LEXICONS = {"tr": TURKISH, "en": ENGLISH}


def ends_sentence_word(text: Column, lang: Column) -> Column:
    """A sentence end that is not a title abbreviation of the language."""
    stem = X.casefold(F.regexp_replace(text, r"\.$", ""))
    title = F.lit(False)
    for code, lex in LEXICONS.items():
        title = title | ((lang == code) & text.endswith(".") & stem.isin(*lex.titles))
    return X.ends_sentence(text) & ~title


def split_sentences(words: DataFrame, keys: Sequence[str] = ("media_id",), idx: str = "word_idx") -> DataFrame:
    """Sentence number per word: how many sentence ends lie before it."""
    end = ends_sentence_word(F.col("text"), F.col("lang")).cast("bigint")
    return scan(words, list(keys), idx, {"sentence": ("sum", end)})


def boundary_score(left: Column, right: Column, lex: Lexicon = ENGLISH) -> Column:
    bare = lambda c: F.lower(X.strip_chars(c, X.STRIP_PUNCT))
    marks = F.when(F.concat(left, F.lit(" ")).rlike(ANY_END), 4).when(left.rlike(X.CLAUSE_END), 2).otherwise(0)
    conj = F.when(bare(right).isin(*lex.conjunctions), 1).otherwise(0) if lex.conjunctions else F.lit(0)
    cling = F.when(bare(left).isin(*lex.clingy), 3).otherwise(0) if lex.clingy else F.lit(0)
    return marks + conj - cling


def wrap_lines(text: Column, limit: int = 42, lex: Lexicon = ENGLISH) -> Column:
    """At most two lines, balanced and cut at the best boundary that fits."""

    def option(h: Column) -> Column:
        a, b = h["a"], h["b"]
        over = (h["m"] > limit) | (h["n"] > limit)
        cost = F.when(over, F.greatest(h["m"], h["n"])).otherwise(F.abs(h["m"] - h["n"]) - 2 * boundary_score(a, b, lex))
        return F.struct(over.alias("over"), cost.alias("cost"), h["i"].alias("i"), F.array(a, b).alias("lines"))

    def best(w: Column) -> Column:
        n = F.size(w)
        halves = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(w, F.lit(1), i), " ").alias("a"), F.array_join(F.slice(w, i + 1, n), " ").alias("b")))
        sized = F.transform(halves, lambda h: F.struct(h["i"].alias("i"), h["a"].alias("a"), h["b"].alias("b"), F.length(h["a"]).alias("m"), F.length(h["b"]).alias("n")))
        return F.when(n < 2, F.array(text)).otherwise(F.array_min(F.transform(sized, option))["lines"])

    return F.when(F.length(text) <= limit, F.array(text)).otherwise(X.held(X.words(text), best))


def heuristic_turns(words: DataFrame, key: str = "media_id", idx: str = "word_idx") -> DataFrame:
    """First words of likely speaker turns.

    A short reply is at most two words, so three words of look-ahead decide;
    one shuffle of the words serves every test, a second one has the few at the edges of blocks.
    """
    # both tests read the text before the shuffles, which carry no words
    d = words.select(key, idx, "start_ms", "end_ms", once(F.coalesce(F.col("text").rlike(TURN_END), F.lit(False))).alias("_end"), once(F.col("text").rlike(QUESTION_END)).alias("_asks"))
    d = d.withColumn("_blk", F.floor(F.col(idx) / F.lit(BLOCK_ROWS)))

    def ahead(w: Window) -> dict[str, Column]:
        return {"_next": F.lead("start_ms", 1).over(w), "_to": F.lead(idx, 1).over(w), **{f"_e{k}": F.lead("_end", k).over(w) for k in (1, 2, 3)}}

    block = Window.partitionBy(key, "_blk").orderBy(idx)
    d = d.withColumns({**ahead(block), "_at": F.row_number().over(block)})
    # the last three words of a block look on into the first three of the next ones
    edges = d.withColumn("_open", F.col("_e3").isNull()).where(F.col("_open") | (F.col("_at") <= 3))
    edges = edges.withColumns(ahead(Window.partitionBy(key).orderBy(idx))).where("_open").drop("_open")
    d = d.where(F.col("_e3").isNotNull()).unionByName(edges)
    gap = F.col("_next") - F.col("end_ms")
    short = F.coalesce("_e1", F.lit(False)) | F.coalesce("_e2", F.lit(False)) | F.col("_e3").isNull()
    turn = F.col("_end") & F.col("_next").isNotNull() & ((gap >= PAUSE_MS) | ((gap >= MIN_TURN_MS) & (F.col("_asks") | short)))
    return d.where(turn).select(key, F.col("_to").alias(idx), F.col("_next").alias("start_ms"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(norm == 0, 1e-9).otherwise(norm)


def embedding_turns(chunks: DataFrame, key: str = "media_id", idx: str = "idx", threshold: float = SAME_SPEAKER) -> DataFrame:
    """Chunks that sound unlike the previous long-enough chunk."""
    kept = chunks.where(F.col("dur_ms") >= MIN_CHUNK_MS)
    d = scan(kept, [key], idx, {"_prev": ("last", F.struct("embedding"))})
    sim = cosine(F.col("_prev.embedding"), F.col("embedding"))
    return d.where("_prev IS NOT NULL").where(sim < threshold).select(key, idx, "start_ms")


def dash_turn_points(cues: DataFrame, key: str = "media_id", idx: str = "cue_idx") -> DataFrame:
    """Midpoints of cues that show exactly two speakers on dashed lines."""
    lines = F.filter(F.transform("lines", X.strip), lambda x: x != "")
    two = (F.size(lines) == 2) & F.forall(lines, lambda x: x.rlike(r"(?U)^[-–]\s"))
    return cues.where(two).select(key, idx, ((F.col("start_ms") + F.col("end_ms")) / 2).alias("at_ms"))


def boundary_points(cues: DataFrame, key: str = "media_id", idx: str = "cue_idx") -> DataFrame:
    d = neighbours(cues.select(key, idx, "start_ms", "end_ms"), [key], idx, lead={"_next": "start_ms"})
    return d.where("_next IS NOT NULL").select(key, idx, ((F.col("end_ms") + F.col("_next")) / 2).alias("at_ms"))


def group_weight(cues: DataFrame, keys: Sequence[str] = ("media_id", "group_idx")) -> DataFrame:
    """Words per group (one at least per cue), or characters in unspaced scripts."""
    chars = F.length(F.replace("text", F.lit(" "), F.lit("")))
    n = F.when(F.col("lang").isin(*X.UNSPACED), chars).otherwise(F.greatest(F.size(X.words("text")), F.lit(1)))
    return cues.groupBy(*keys).agg(F.greatest(F.sum(n), F.lit(1)).cast("bigint").alias("weight"))


def distribute_timing(pieces: DataFrame, keys: Sequence[str] = ("media_id", "group_idx"), idx: str = "piece_idx", limits: Constraints = Constraints()) -> DataFrame:
    """Reading-time shares that fill a group's envelope exactly; groups are one cue's pieces."""
    want = F.greatest(F.lit(limits.target_min_ms / 1000), F.length("text") / limits.target_cps)
    w = Window.partitionBy(*keys).orderBy(idx)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = pieces.withColumn("_w", want)
    d = d.withColumns({"_run": F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_w").over(whole), "_next": F.lead(idx).over(w)})
    at = lambda share: F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * share / F.col("_all")
    end = F.when(F.col("_next").isNull(), F.col("end_ms").cast("double")).otherwise(at(F.col("_run")))
    return d.select(*keys, idx, "text", at(F.col("_run") - F.col("_w")).alias("start_ms"), end.alias("end_ms"))


def extend_short_cues(cues: DataFrame, key: str = "media_id", idx: str = "cue_idx", limits: Constraints = Constraints()) -> DataFrame:
    """Longer display for short cues, never past the next start; starts stay put."""
    d = neighbours(cues, [key], idx, lead={"_next": "start_ms"})
    want = F.greatest(F.lit(limits.min_ms), F.floor(F.length("text") * 1000 / limits.target_cps))
    end = F.least(F.greatest(F.col("end_ms"), F.col("start_ms") + want), F.col("start_ms") + limits.max_ms)
    end = F.greatest(F.least(end, F.coalesce("_next", end)), F.col("start_ms") + 1)
    return d.withColumn("end_ms", end.cast("bigint")).drop("_next")


def project(groups: DataFrame, targets: DataFrame, key: str = "media_id") -> DataFrame:
    """Target cues with their source group and members, numbered through the track."""
    g = groups.select(key, "group_idx", "indices")
    j = targets.join(g, [key, "group_idx"])
    d = scan(j, [key], "group_idx", {"cue_idx": ("count", F.lit(1))}, ties=["piece_idx"])
    return d.select(key, "cue_idx", "group_idx", "start_ms", "end_ms", "text", "indices")


def validate_coverage(groups: DataFrame, projected: DataFrame, key: str = "media_id", slack_ms: int = 10) -> DataFrame:
    """Earliest fault per track: an order regression first, else an empty or misplaced group."""
    p = neighbours(projected.select(key, "cue_idx", "group_idx"), [key], "cue_idx", lag={"_prev": "group_idx"})
    back = p.where(F.col("group_idx") < F.col("_prev")).groupBy(key).agg(F.min("cue_idx").alias("_cue"), F.min_by("group_idx", "cue_idx").alias("_grp"))
    spans = projected.groupBy(key, "group_idx").agg(F.min_by("start_ms", "cue_idx").alias("_s"), F.max_by("end_ms", "cue_idx").alias("_e"))
    g = groups.select(key, "group_idx", "start_ms", "end_ms").join(spans, [key, "group_idx"], "left")
    off = (F.abs(F.col("_s") - F.col("start_ms")) > slack_ms) | (F.abs(F.col("_e") - F.col("end_ms")) > slack_ms)
    kind = F.when(F.col("_s").isNull(), "dropped_utterance").when(off, "timing_difference")
    bad = g.withColumn("_k", kind).where("_k IS NOT NULL").groupBy(key).agg(F.min("group_idx").alias("_g2"), F.min_by("_k", "group_idx").alias("_k"))
    n = groups.groupBy(key).agg(F.count("*").alias("population"))
    d = n.join(back, key, "left").join(bad, key, "left")
    category = F.when(F.col("_cue").isNotNull(), "timing_difference").otherwise(F.col("_k"))
    return d.select(key, "population", F.when(category.isNotNull(), 1).otherwise(0).cast("bigint").alias("flagged"), category.alias("category"), F.coalesce("_grp", "_g2").alias("group_idx"))


# ---------------------------------------------------------------- flatten and rejoin

def dash_lines(text: Column) -> Column:
    """Speaker lines without dashes, or the whole text when not all lines have one."""
    parts = F.split(text, "\n")
    ok = (F.size(parts) >= 2) & F.forall(parts, lambda x: F.startswith(x, F.lit("-")))
    return F.when(ok, F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^-\s*", ""))).otherwise(F.array(text))


def sentence_list(text: Column) -> Column:
    """Sentences of a text, split after runs of end marks."""
    parts = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?…])(?![.!?…])\s+"), X.strip), lambda s: s != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(text))


def expand_lines(spans: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Span -> speaker line -> sentence rows, numbered for the way back."""
    d = spans.select(*keys, F.posexplode(dash_lines(F.col(text))).alias("line_idx", "_line"))
    d = d.select(*keys, "line_idx", F.posexplode(sentence_list(F.col("_line"))).alias("sent_idx", "sentence"))
    return d


def rejoin_lines(sentences: DataFrame, keys: Sequence[str], value: str = "sentence") -> DataFrame:
    """Inverse of expand_lines: sentences by space, dashed speakers by line break."""
    line = sentences.groupBy(*keys, "line_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", value))), lambda s: s[value]), " ").alias("_l"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "_l"))), lambda s: s["_l"])
    d = line.groupBy(*keys).agg(ordered.alias("_ls"))
    dashed = F.array_join(F.transform("_ls", lambda x: F.concat(F.lit("- "), x)), "\n")
    return d.select(*keys, F.when(F.size("_ls") > 1, dashed).otherwise(F.get("_ls", F.lit(0))).alias("text"))


def chunk_words(text: Column, size: int = 6) -> Column:
    """Word groups of a run-on, each closed by a full stop."""
    w = X.words(text)
    steps = F.sequence(F.lit(0), F.greatest(F.floor((F.size(w) - 1) / size), F.lit(0)).cast("int"))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(steps, lambda k: F.concat(F.array_join(F.slice(w, k * size + 1, F.lit(size)), " "), F.lit("."))))


def orphan_spans(spans: DataFrame, key: str = "media_id", idx: str = "span_idx") -> DataFrame:
    """One-word spans with a real boundary on exactly one side, and their context side."""
    real = F.coalesce(F.col("boundary_before").isin(*REAL), F.lit(False))
    d = neighbours(spans.withColumn("_gap", real), [key], idx, lag={"_back": idx}, lead={"_after": "_gap", "_ahead": idx})
    lone = (F.col("cue_count") == 1) & (F.size(X.words("text")) == 1)
    after = F.coalesce("_after", F.lit(False))
    before = F.col("_gap") & ~after & F.col("_back").isNotNull()
    ahead = after & ~F.col("_gap")
    return d.where(lone & (before | ahead)).select(key, idx, F.when(before, F.col("_back")).otherwise(F.col("_ahead")).alias("context_idx"), before.alias("context_before"))


def strip_affix(padded: Column, anchor: Column, before: Column) -> Column:
    """What remains after removing the anchor's words; NULL unless they match exactly."""
    norm = lambda ws: F.transform(ws, lambda w: X.strip_chars(F.lower(w), AFFIX_STRIP))

    def remains(s: Column) -> Column:
        p, a, n, m = s["p"], s["a"], F.size(s["p"]), F.size(s["a"])
        head = F.slice(p, F.lit(1), m)
        tail = F.slice(p, F.greatest(n - m + 1, F.lit(1)), m)
        rest = F.when(s["before"], F.slice(p, m + 1, n)).otherwise(F.slice(p, F.lit(1), F.greatest(n - m, F.lit(0))))
        ok = (m > 0) & (n > m) & (norm(F.when(s["before"], head).otherwise(tail)) == norm(a))
        return F.when(ok, X.held(F.array_join(rest, " "), lambda r: F.when(r != "", r)))

    return X.held(F.struct(X.words(padded).alias("p"), X.words(anchor).alias("a"), before.alias("before")), remains)


def _runs(clauses: DataFrame, source: str, key: str, idx: str, min_prob: float, supported: Sequence[str] | None) -> DataFrame:
    """Long clauses with the number of the same-language run they belong to."""
    fits = (F.col("prob") >= min_prob) & (F.col("lang") != source)
    fits = fits & (F.col("lang").isin(*supported) if supported is not None else F.col("lang") != "und")
    d = clauses.where(F.length("text") >= MIN_CLAUSE_CHARS).withColumn("_q", F.when(fits, F.col("lang")))
    d = scan(d, [key], idx, {"_p": ("last", F.struct("_q"))})
    start = F.col("_q").isNotNull() & ~F.col("_q").eqNullSafe(F.col("_p._q"))
    return islands(d, [key], idx, start, "run").where("_q IS NOT NULL")


def language_runs(clauses: DataFrame, source: str, supported: Sequence[str], key: str = "media_id", idx: str = "clause_idx", min_run: int = MIN_RUN) -> DataFrame:
    """Clauses in runs of at least three of another language.

    Short clauses neither join nor break a run. Clauses are counted, not distinct
    texts, so a line repeated three times qualifies.
    """
    d = _runs(clauses, source, key, idx, MIN_CLAUSE_PROB, supported)
    long = d.groupBy(key, "run").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_run).drop("_n")
    return d.join(long, [key, "run"], "left_semi").select(key, idx, F.col("_q").alias("override"))


def candidate_runs(clauses: DataFrame, source: str, key: str = "media_id", idx: str = "clause_idx", min_run: int = 2) -> DataFrame:
    """Review-only runs with their size, distinct wording and time span."""
    d = _runs(clauses, source, key, idx, MIN_CLAUSE_PROB, None)
    norm = F.regexp_replace(X.casefold(X.strip("text")), r"(?U)\s+", " ")
    g = d.groupBy(key, "run").agg(
        F.first("_q").alias("language"), F.count("*").alias("clauses"), F.countDistinct(norm).alias("distinct_clauses"), F.min(idx).alias("first_clause"), F.max(idx).alias("last_clause"),
        F.min_by("start_ms", idx).alias("start_ms"), F.max_by("end_ms", idx).alias("end_ms"))
    return g.where(F.col("clauses") >= min_run).withColumn("repeated_only", F.col("distinct_clauses") < min_run).drop("run")
