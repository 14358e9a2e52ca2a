"""Glossary layers, placeholders, name repair."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions import text as X
from cueloom.functions.lookup import HELD_TOKENS, entry_finder
from cueloom.functions.sequence import once, scan
from cueloom.session import cut_lineage

# Boundaries, scope syntax and Turkish sound classes.
WORD = "[A-Za-z0-9_]"
SCOPE = r"(?i)^\s*S(\d{1,3})E(\d{1,4})(?:\s*-\s*(?:S(\d{1,3}))?E(\d{1,4}))?\s*$"
TURKISH_VOWELS = "aeıioöuü"
TURKISH_VOICELESS = "fıstıkçışhp"
TURKISH_LOWER = "[a-zçğıöşü]"
NAME_WORD = r"^([^\p{L}\p{N}_]*)(\p{L}+)(['’]\p{L}+)?([^\p{L}\p{N}_]*)$"
MIN_NAME = 4
NAME_CONFIDENCE = 0.9


# ---------------------------------------------------------------- scope and profile

def parse_scope(item: Column) -> Column:
    """``S01E02-E05`` as (season, first, last); NULL for a typo or a season change."""
    g = lambda i: F.nullif(F.regexp_extract(item, SCOPE, i), F.lit("")).cast("int")
    season, first = g(1), g(2)
    last = F.coalesce(g(4), first)
    ok = season.isNotNull() & (F.coalesce(g(3), season) == season)
    return F.when(ok, F.struct(season.alias("season"), F.least(first, last).alias("first"), F.greatest(first, last).alias("last")))


def in_scope(scope: Column, season: Column, episode: Column) -> Column:
    """NULL scope is everywhere; an empty or mistyped one is nowhere."""
    ranges = F.array_compact(F.transform(scope, parse_scope))
    hit = F.exists(ranges, lambda r: (r["season"] == season) & (r["first"] <= episode) & (episode <= r["last"]))
    return F.when(scope.isNull(), True).when(season.isNull() | episode.isNull(), False).otherwise(F.coalesce(hit, F.lit(False)))


def phrase_key(text: str | Column) -> Column:
    return X.casefold(F.regexp_replace(X.strip(text), "[.!?]+$", ""))


def load_profile(entities: DataFrame, series: int | None, season: int | None = None, episode: int | None = None, all_episodes: bool = False) -> DataFrame:
    """Protected names for one series: global layers first, the series' own layer last.

    The later layer wins per canonical name, decided by a max aggregate.
    """
    own = F.col("series").eqNullSafe(F.lit(series)) if series is not None else F.lit(False)
    d = entities.where(F.col("series").isNull() | own)
    rest = [c for c in d.columns if c != "canonical"]
    d = d.groupBy("canonical").agg(F.max_by(F.struct(*rest), F.struct(F.col("series").isNotNull(), "layer")).alias("_b")).select("canonical", "_b.*")
    lit = lambda v: F.lit(v).cast("int")
    return d.where("protected").where(F.lit(all_episodes) | in_scope(F.col("episodes"), lit(season), lit(episode)))


def latest_phrases(phrases: DataFrame, series: int | None) -> DataFrame:
    own = F.col("series").eqNullSafe(F.lit(series)) if series is not None else F.lit(False)
    d = phrases.where(F.col("series").isNull() | own).withColumn("phrase_key", phrase_key("source"))
    best = F.max_by(F.struct("translation", "language"), F.struct(F.col("series").isNotNull(), "layer"))
    return d.groupBy("phrase_key").agg(best.alias("_b")).select("phrase_key", "_b.*")


def apply_phrases(lines: DataFrame, phrases: DataFrame) -> DataFrame:
    """Fixed translations by phrase key, where the language fits or is universal."""
    d = lines.withColumn("_key", phrase_key("text"))
    p = phrases.select(F.col("phrase_key").alias("_key"), F.col("translation").alias("_fixed"), F.col("language").alias("_l"))
    j = d.join(p, "_key", "left")
    fits = F.col("_l").isNull() | (F.col("_l") == F.col("lang"))
    return j.select(*lines.columns, F.when(fits, F.col("_fixed")).alias("phrase_translation"))


# ---------------------------------------------------------------- placeholders

#: Letters of the third and later places of a code. Every case suffix has a vowel, so no code with a suffix is another code.
TAIL_LETTERS = "bcdfghjklmnpqrstvwxz"
TAIL_PLACES = 8


def placeholder_code(k: Column) -> Column:
    """``X`` plus two letters for the first 676 numbers; each later round of 676 adds the next tail.

    Tails are the numerals ``b, c, ..., z, bb, bc, ...`` of base 20 without a zero, so codes have no bound.
    """
    n, base = F.floor(k / 676), len(TAIL_LETTERS)
    ahead = [(base**i - 1) // (base - 1) for i in range(TAIL_PLACES)]  # numerals shorter than i + 1 places
    left = [F.floor((n - ahead[i]) / base**i) for i in range(TAIL_PLACES)]
    places = [F.when(m >= 1, F.substring(F.lit(TAIL_LETTERS), ((m - 1) % base + 1).cast("int"), F.lit(1))).otherwise("") for m in left]
    return F.concat(F.lit("X"), F.char(97 + F.floor((k % 676) / 26)), F.char(97 + k % 26), *reversed(places))


def assign_placeholders(forms: DataFrame, key: str = "series") -> DataFrame:
    """A placeholder per key and case-folded form, in order of first sight; any number of forms."""
    d = forms.withColumn("_f", X.casefold("form"))
    first = d.groupBy(key, "_f").agg(F.min_by(F.struct(*forms.columns), "form_order").alias("_r")).select("_r.*")
    d = scan(first, [key], "form_order", {"_k": ("count", F.lit(1))})
    return d.withColumn("placeholder", placeholder_code(F.col("_k"))).drop("_k")


def turkish_suffixes(form: Column) -> Column:
    """Case-suffix alternatives that fit the vowels of a form; NULL without a vowel."""
    low = X.casefold(form)
    vowel = F.regexp_extract(low, f"([{TURKISH_VOWELS}])[^{TURKISH_VOWELS}]*$", 1)
    high = F.translate(vowel, "aıoueiöü", "ııuuiiüü")
    open_ = F.when(vowel.rlike("[aıou]"), "a").otherwise("e")
    last = F.substring(low, -1, 1)
    ends_vowel = last.rlike(f"[{TURKISH_VOWELS}]")
    dt = F.when(last.rlike(f"[{TURKISH_VOICELESS}]"), "t").otherwise("d")
    buffered = lambda v: F.when(ends_vowel, F.concat(F.lit("y?"), v)).otherwise(v)
    genitive = F.when(ends_vowel, F.concat(F.lit("n"), high)).otherwise(F.concat(high, F.lit("n")))
    with_ = F.when(ends_vowel, F.concat(F.lit("yl"), open_)).otherwise(F.concat(F.lit("l"), open_))
    alternatives = F.concat_ws("|", genitive, buffered(high), buffered(open_), F.concat(dt, open_, F.lit("n?")), with_)
    return F.when(vowel != "", F.concat(F.lit("(?:"), alternatives, F.lit(")")))


def _bounded(form: Column) -> Column:
    return F.concat(F.lit(f"(?<!{WORD})\\Q"), form, F.lit(f"\\E(?!{WORD})"))


def glossary_entries(glossary: DataFrame, key: str = "series") -> DataFrame:
    """One row per series and form: the form as ``e``, with the case suffixes that may follow it. Slim, as this is what moves."""
    suffix = F.when(F.coalesce("turkish_case_suffixes", F.lit(False)), turkish_suffixes(F.col("form")))
    item = F.struct(F.col("form_order").alias("o"), "form", "placeholder", "canonical", F.coalesce("case_sensitive", F.lit(False)).alias("exact"), suffix.alias("suffix"))
    return glossary.select(key, item.alias("e"))


def _any_case(word: Column) -> Column:
    return F.concat(F.lit("(?iu)"), _bounded(word))


def _suffixed(e: Column, word: Column, flag: Column) -> Column:
    """Pattern of a word with one of the entry's case suffixes behind it; NULL if it takes none."""
    return F.concat(flag, F.lit(f"(?<!{WORD})\\Q"), word, F.lit("\\E(?="), e["suffix"], F.lit(f"(?!{TURKISH_LOWER}))"))


#: Longest part of a case suffix that may continue a run of word characters.
SUFFIX_CHARS = 3


def _runs(text: Column) -> Column:
    """Runs of word characters, lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0)), F.lower)


def _signs(text: Column) -> Column:
    """Distinct characters outside of words, for forms without any word character."""
    return F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.lower(text), f"{WORD}|\\s", ""), "")), "")


def glossary_keys(entries: DataFrame, key: str = "series") -> DataFrame:
    """(key, kind, token, e): the token under which a line meets an entry.

    A form in a line has its runs of word characters as whole runs of the line (its last run perhaps
    with a suffix behind it), so one run will do: the one that the fewest forms of the series have,
    the longest of these; a form without word characters has its first character. Kind 1 is a run that a
    suffix may follow. Placeholders are entered like forms of one run.
    """
    own = entries.select(key, "e", _runs(F.col("e.form")).alias("_r"))
    each = own.where(F.size("_r") > 0).select(key, "e", F.size("_r").alias("_n"), F.posexplode("_r").alias("_at", "token"))
    common = each.groupBy(key, "token").agg(F.count(F.lit(1)).alias("_c"))
    rare = F.min(F.struct("_c", (-F.length("token")).alias("_l"), "_at", "token", (F.col("_at") == F.col("_n") - 1).alias("_last")))
    ends = F.col("e.form").rlike(f"{WORD}$")
    picked = each.join(common, [key, "token"]).groupBy(key, "e").agg(rare.alias("_p"))
    forms = picked.select(key, F.when(F.col("e.suffix").isNotNull() & F.col("_p._last") & ends, 1).otherwise(0).alias("kind"), F.col("_p.token").alias("token"), "e")
    signs = own.where(F.size("_r") == 0).select(key, F.lit(0).alias("kind"), F.substring(F.lower("e.form"), 1, 1).alias("token"), "e")
    codes = entries.select(key, F.when(F.col("e.suffix").isNotNull(), 1).otherwise(0).alias("kind"), F.lower("e.placeholder").alias("token"), "e")
    return forms.unionByName(signs).unionByName(codes)


#: Names up to which they go to the lines as a broadcast.
HELD_NAMES = 200_000


def with_glossary(lines: DataFrame, glossary: DataFrame, key: str = "series", texts: Sequence[str] = ("text",)) -> DataFrame:
    """Lines with the glossary entries that any of ``texts`` mentions, as ``_g``, in glossary order.

    Tokens of a line meet the entries' tokens by equality, so the work follows the mentions and not lines times
    forms, and no line ever carries a glossary. Up to a counted size the entries go to the tasks, as in a broadcast
    join, and lines stay where they are. Beyond it entries are found once per distinct text of a series and come
    back to the lines by its hash. Forms are matched by their patterns; those only see entries found here.
    """
    met = glossary_keys(glossary_entries(glossary, key), key)
    d = lines.withColumn("_hay", F.concat_ws("\n", *texts))
    coded = met.select(_code(key, F.col("kind"), F.col("token")).alias("code"), "kind", (~F.col("token").rlike(f"^{WORD}")).alias("sign"), "e")
    held = coded.limit(HELD_TOKENS + 1).toArrow()
    found = _by_lookup(d, held, met.schema["e"].dataType, key) if held.num_rows <= HELD_TOKENS else _by_shuffle(d, met, key)
    hay = F.lower("_hay")
    mine = F.filter("_all", lambda e: F.contains(hay, F.lower(e["form"])) | F.contains(hay, F.lower(e["placeholder"])))
    return found.select(*lines.columns, once(mine).alias("_g"))


def _code(key: str, kind: Column, token: Column) -> Column:
    return F.xxhash64(key, kind, token)


def _by_lookup(d: DataFrame, met: pa.Table, entry: T.DataType, key: str) -> DataFrame:
    """``_all`` of every line from entries that each task holds, by the hashes of their tokens.

    An entry that only shares a hash with a token is not in the line's text and goes with the check that follows.
    """
    find = entry_finder(met)
    coded = lambda tokens, kind: F.transform(tokens, lambda t: _code(key, F.lit(kind), t))
    runs = _runs(F.col("_hay"))
    codes = coded(F.concat(runs, _signs(F.col("_hay"))) if pc.any(met["sign"]).as_py() else runs, 0)
    if pc.any(pc.equal(met["kind"], 1)).as_py():
        codes = F.concat(codes, coded(_prefixes(runs), 1))
    return d.withColumn("_codes", once(codes)).withColumn("_all", F.arrow_udf(find, T.ArrayType(entry))("_codes")).drop("_codes")


def _by_shuffle(d: DataFrame, met: DataFrame, key: str) -> DataFrame:
    """``_all`` of every line by joins on tokens; each distinct text of a series is looked up once."""
    d, found = d.withColumn("_id", F.unhex(F.md5("_hay"))), None
    texts = d.select(key, "_id", "_hay").dropDuplicates([key, "_id"])
    for kind, tokens in ((0, F.concat(_runs(F.col("_hay")), _signs(F.col("_hay")))), (1, _prefixes(_runs(F.col("_hay"))))):
        part = texts.select(key, "_id", F.explode(F.array_distinct(tokens)).alias("token"))
        part = part.join(met.where(F.col("kind") == kind).drop("kind"), [key, "token"]).select(key, "_id", "e")
        found = part if found is None else found.unionByName(part)
    gathered = found.groupBy(key, "_id").agg(F.array_sort(F.collect_set("e")).alias("_all"))
    none = F.array().cast(f"array<{met.schema['e'].dataType.simpleString()}>")
    return d.join(gathered, [key, "_id"], "left").withColumn("_all", F.coalesce("_all", none))


def _prefixes(runs: Column) -> Column:
    """Runs, whole and without what may be a suffix."""
    cut = lambda r: F.transform(F.sequence(F.lit(0), F.lit(SUFFIX_CHARS)), lambda n: F.left(r, F.length(r) - n))
    return F.array_remove(F.array_distinct(F.flatten(F.transform(runs, cut))), "")


def protected_lines(lines: DataFrame, text: str = "text", out: str = "protected") -> DataFrame:
    return lines.select("*", once(protect(text)).alias(out))


def _swap(text: Column, entries: Column, word: Callable[[Column], Column], flag: Callable[[Column], Column], put: Callable[[Column], Column]) -> Column:
    def step(t: Column, e: Column) -> Column:
        plain = F.regexp_replace(t, F.concat(flag(e), _bounded(word(e))), put(e))
        return F.when(e["suffix"].isNull(), plain).otherwise(F.regexp_replace(plain, F.coalesce(_suffixed(e, word(e), flag(e)), F.lit("(?!)")), put(e)))

    return F.coalesce(F.aggregate(entries, text, step), text)


def protect(text: str | Column = "text") -> Column:
    """Names to placeholders, longest form first. Needs ``_g`` from with_glossary.

    Only forms the line contains at all reach the pattern step.
    """
    t = F.col(text) if isinstance(text, str) else text
    present = F.filter("_g", lambda e: F.contains(F.lower(t), F.lower(e["form"])))
    longest = F.array_sort(present, lambda a, b: F.when(F.length(a["form"]) > F.length(b["form"]), -1).when(F.length(a["form"]) < F.length(b["form"]), 1).when(a["o"] < b["o"], -1).otherwise(1))
    return _swap(t, longest, lambda e: e["form"], lambda e: F.when(e["exact"], "").otherwise("(?iu)"), lambda e: e["placeholder"])


def restore(text: str | Column) -> Column:
    """Placeholders back to canonical names, in glossary order."""
    t = F.col(text) if isinstance(text, str) else text
    present = F.filter("_g", lambda e: F.contains(F.lower(t), F.lower(e["placeholder"])))
    return _swap(t, present, lambda e: e["placeholder"], lambda e: F.lit("(?iu)"), lambda e: F.regexp_replace(e["canonical"], r"([\\$])", r"\\$1"))


def repair_placeholders(candidate: Column, source: Column) -> Column:
    """Mistyped placeholders that are one letter from exactly one active placeholder."""
    shape = F.lit(f"(?<!{WORD})X[a-z]{{2}}[{TAIL_LETTERS}]*(?!{WORD})")
    active = F.array_distinct(F.regexp_extract_all(source, shape, F.lit(0)))
    wrong = F.array_except(F.regexp_extract_all(candidate, shape, F.lit(0)), active)

    def fix(t: Column, bad: Column) -> Column:
        near = F.filter(active, lambda p: (F.length(p) == F.length(bad)) & (F.levenshtein(p, bad) <= 1))
        return F.when(F.size(near) == 1, F.regexp_replace(t, _bounded(bad), F.get(near, F.lit(0)))).otherwise(t)

    return F.when(F.size(active) > 0, F.aggregate(wrong, candidate, fix)).otherwise(candidate)


def bare_entity(protected: str = "protected") -> Column:
    """Restored text when nothing but placeholders and punctuation remains, else NULL."""
    p = F.col(protected)
    present = F.filter("_g", lambda e: p.rlike("X") & F.rlike(p, _any_case(e["placeholder"])))
    residue = F.aggregate(present, p, lambda t, e: F.regexp_replace(t, _any_case(e["placeholder"]), F.lit("")))
    return F.when((F.size(present) > 0) & ~residue.rlike(r"[\p{L}\p{N}_]"), restore(protected))


def _hits(protected: str) -> Column:
    """Array of (o, canonical, source_count) of the placeholders in a line, in glossary order."""
    p = F.col(protected)
    present = F.filter("_g", lambda e: F.contains(F.lower(p), F.lower(e["placeholder"])))
    counted = F.transform(present, lambda e: F.struct(e["o"].alias("o"), e["canonical"].alias("canonical"), F.regexp_count(p, _any_case(e["placeholder"])).cast("bigint").alias("source_count")))
    return F.filter(counted, lambda e: e["source_count"] > 0)


def _reported(hits: Column, target: str, all_forms: bool = False) -> Column:
    """Report rows of hits that are computed already."""
    t = F.col(target)
    first = F.filter(hits, lambda e, i: ~F.exists(F.slice(hits, F.lit(1), i), lambda x: x["canonical"] == e["canonical"]))

    def report(e: Column) -> Column:
        n = e["source_count"]
        if all_forms:
            n = F.aggregate(F.filter(hits, lambda x: x["canonical"] == e["canonical"]), F.lit(0).cast("bigint"), lambda a, x: a + x["source_count"])
        return F.struct(e["canonical"].alias("canonical"), n.alias("source_count"), F.regexp_count(t, _any_case(e["canonical"])).cast("bigint").alias("target_count"))

    return F.transform(first, report)


def occurrences(protected: str, target: str, all_forms: bool = False) -> Column:
    """Array of (canonical, source_count, target_count) in glossary order.

    Only the first placeholder with hits counts per canonical name, unless
    ``all_forms`` adds the counts of every form.
    """
    return X.held(_hits(protected), lambda hits: _reported(hits, target, all_forms))


def entity_occurrences(lines: DataFrame, keys: Sequence[str], protected: str = "protected", target: str = "translated", all_forms: bool = False) -> DataFrame:
    """Report rows per line; the population of the entity stage."""
    d = lines.select(*keys, F.explode(occurrences(protected, target, all_forms)).alias("_o"))
    return d.select(*keys, "_o.*")


def recover_entities(protected: str = "protected", candidate: str = "translated") -> Column:
    """Missing names put in front of the candidate, each with the source's end mark."""
    tail = F.regexp_extract(F.regexp_replace(F.col(protected), r"(?U)\s+$", ""), "[.!?]$", 0)
    short = F.filter(occurrences(protected, candidate), lambda e: e["source_count"] > e["target_count"])

    def add(text: Column, e: Column) -> Column:
        names = F.array_repeat(F.concat(e["canonical"], tail), (e["source_count"] - e["target_count"]).cast("int"))
        front = F.array_join(names, " ")
        return F.when(X.strip(text) == "", front).otherwise(X.strip(F.concat(front, F.lit(" "), text)))

    return F.aggregate(short, F.col(candidate), add)


def prefer_candidate(d: DataFrame, first: str, second: str, protected: str = "protected") -> DataFrame:
    """True where the second candidate keeps more names, or only the first is far too short."""
    missing = lambda hits, c: F.aggregate(_reported(hits, c), F.lit(0).cast("bigint"), lambda a, e: a + F.greatest(e["source_count"] - e["target_count"], F.lit(0)))
    n = F.length(protected)
    short = lambda c: (n >= 15) & (F.length(c) * 4 < n)
    # the source's names are looked for once, not per candidate and again for every name
    choice = X.held(_hits(protected), lambda hits: F.when(F.size(hits) > 0, missing(hits, second) < missing(hits, first)).otherwise(short(first) & ~short(second)))
    return d.withColumn("prefer_second", choice)


# ---------------------------------------------------------------- names and vocabulary

def name_tokens(names: Column) -> Column:
    return F.filter(X.words(names), lambda t: (F.length(t) >= MIN_NAME) & t.rlike(r"^\p{Lu}\p{L}*$"))


def episode_names(forms: DataFrame, season: Column, episode: Column, key: str = "series") -> DataFrame:
    """Name tokens per series with a flag for those in scope of the episode."""
    d = forms.select(key, F.explode(name_tokens(F.col("form"))).alias("name"), in_scope(F.col("episodes"), season, episode).alias("_here"))
    return d.groupBy(key, "name").agg(F.bool_or("_here").alias("here"))


def series_vocabulary(words: DataFrame, keys: Sequence[str] = ("series",), token: str = "text") -> DataFrame:
    """Folded counts of lower-case words; folding runs once per distinct token."""
    t = F.explode(F.regexp_extract_all(F.col(token), F.lit(r"\p{L}+"), F.lit(0)))
    raw = words.select(*keys, t.alias("_t")).where(F.col("_t").rlike(r"^\p{Ll}")).groupBy(*keys, "_t").agg(F.count("*").alias("_n"))
    return raw.groupBy(*keys, X.fold("_t").alias("folded")).agg(F.sum("_n").alias("n"))


def casing_profile(words: DataFrame, keys: Sequence[str] = ("series",), token: str = "text") -> DataFrame:
    """Lower- and upper-case sightings per folded word and the ordinary-word verdict."""
    base = F.regexp_extract(token, NAME_WORD, 2)
    seen = words.groupBy(*keys, F.col(token).alias(token)).agg(F.count("*").alias("_n"))
    raw = seen.select(*keys, base.alias("_b"), "_n").where("_b <> ''").groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    low = F.col("_b").rlike(r"^\p{Ll}")
    d = raw.groupBy(*keys, X.fold("_b").alias("folded")).agg(F.sum(F.when(low, F.col("_n")).otherwise(0)).alias("lower"), F.sum(F.when(~low, F.col("_n")).otherwise(0)).alias("upper"))
    return d.withColumn("ordinary", (F.col("lower") > 0) & (F.col("lower") >= F.col("upper")))


def one_edit_keys(word: Column) -> Column:
    """A word and its one-letter deletions: words one edit apart share a key."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), cut))


def repair_names(words: DataFrame, names: DataFrame, profile: DataFrame, key: str = "series") -> DataFrame:
    """Capitalised words one letter from exactly one name of the episode.

    Work happens on distinct (series, word) pairs: known names and ordinary words
    drop out by anti joins, candidates meet names on deletion keys, and only the
    resulting corrections are joined back to the words, by their text.
    """
    texts = cut_lineage(words.groupBy(key, "text").agg(F.count("*").alias("_n")).select(key, "text", F.regexp_extract("text", NAME_WORD, 2).alias("_base")))
    d = texts.where((F.length("_base") >= MIN_NAME) & F.col("_base").rlike(r"^\p{Lu}")).select(key, "_base").distinct()
    d = d.withColumn("_f", X.fold("_base"))
    known = names.select(key, X.fold("name").alias("_f")).distinct()
    common = profile.where("ordinary").select(key, F.col("folded").alias("_f"))
    d = d.join(known, [key, "_f"], "left_anti").join(common, [key, "_f"], "left_anti")
    left = d.withColumn("_k", F.explode(one_edit_keys(F.col("_f"))))
    here = names.where("here").select(key, "name", once(X.fold("name")).alias("_nf")).withColumn("_k", F.explode(one_edit_keys(F.col("_nf"))))
    near = left.join(here, [key, "_k"]).where(F.levenshtein("_f", "_nf", 1) == 1)
    fix = near.groupBy(key, "_base").agg(F.countDistinct("name").alias("_n"), F.min("name").alias("_name")).where("_n = 1").drop("_n")
    g = lambda i: F.regexp_extract("text", NAME_WORD, i)
    fixed = cut_lineage(texts.join(fix, [key, "_base"]).select(key, "text", F.concat(g(1), "_name", g(3), g(4)).alias("_new")))
    j = words.join(fixed, [key, "text"], "left")
    return j.select(*words.columns, F.coalesce("_new", "text").alias("corrected"), F.when(F.col("_new").isNotNull(), F.lit(NAME_CONFIDENCE)).alias("confidence"))


def upsert_entities(base: DataFrame, changes: DataFrame, keys: Sequence[str] = ("series", "canonical")) -> DataFrame:
    """Promotions protect an entry and unite its aliases; edits replace; deletes remove."""
    c = changes.select(*keys, F.col("action").alias("_a"), F.col("aliases").alias("_al"), F.lit(True).alias("_c"))
    b = base.select(*keys, F.col("aliases").alias("_b"), F.col("protected").alias("_p"))
    j = b.join(c, list(keys), "full")
    none = F.array().cast("array<string>")
    united = F.array_sort(F.array_union(F.coalesce("_b", none), F.coalesce("_al", none)))
    aliases = F.when(F.col("_a") == "edit", F.col("_al")).when((F.col("_a") == "promote") & F.col("_b").isNull(), F.coalesce("_al", none)).when((F.col("_a") == "promote") & (F.size("_al") > 0), united).otherwise(F.col("_b"))
    gone = (F.col("_a") == "delete") | (F.col("_b").isNull() & (F.col("_a") != "promote"))
    return j.where(~F.coalesce(gone, F.lit(False))).select(*keys, aliases.alias("aliases"), F.when(F.col("_a") == "promote", True).otherwise(F.col("_p")).alias("protected"))


def rejected_changes(base: DataFrame, changes: DataFrame, keys: Sequence[str] = ("series", "canonical")) -> DataFrame:
    """Edits and deletes of entries that do not exist."""
    return changes.where("action <> 'promote'").join(base.select(*keys), list(keys), "left_anti").select(*keys, "action")
