"""Cast credits: parsing, scope, evidence and probe verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.functions.sequence import once, scan
from cueloom.session import cut_lineage

# Titles, non-characters, annotations and gates.
PREFIX_TITLES = """chef dr dr. doctor mr mr. mrs mrs. ms ms. miss prof prof. professor officer detective captain uncle aunt grandma grandpa young little old
şef doktor hemşire komiser avukat müdür bay bayan sayın hoca prens prenses kaptan profesör öğretmen""".split()
SUFFIX_TITLES = "bey hanım hanim abla abi ağabey teyze amca hoca efendi san kun chan sama sensei senpai ssi nim".split()
NOT_CHARACTERS = ("", "self", "himself", "herself", "themselves", "narrator", "voice", "guest", "host", "various", "unknown", "extra", "additional voices")
ANNOTATIONS = "voice uncredited archive footage young younger child teen adult old older credit only cameo flashback photo singing".split()
QUOTED = "[\"“”'‘’]([^\"“”'‘’]+)[\"“”'‘’]"
LETTER = "A-Za-zÇĞİÖŞÜÂÎÛçğıöşüâîû"
CJK = "[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ가-힯]"
SCOPE_MARGIN = 3
REGULAR_PCT = 60
MIN_LINES, MIN_EPISODES = 5, 2
MIN_FAILURES, FAILURE_PCT = 2, 10


def parse_credit(raw: str | Column) -> Column:
    """(given, full_name, nicknames) of a character credit, or NULL."""
    r = F.col(raw) if isinstance(raw, str) else raw
    titled = lambda titles: lambda a, w: X.held(a["go"] & X.casefold(w).isin(*titles), lambda on: F.struct((a["n"] + on.cast("int")).alias("n"), on.alias("go")))
    count = lambda words, titles: F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), titled(titles))["n"]

    def is_nickname(i: Column) -> Column:
        def short_name(w: Column) -> Column:
            named = F.get(w, F.lit(0)).rlike(r"^\p{Lu}|[^\x00-\x7F]")
            return F.size(w).between(1, 2) & F.coalesce(named, F.lit(False)) & ~F.exists(w, lambda x: X.casefold(x).isin(*ANNOTATIONS))

        return X.held(X.words(i), short_name)

    def credit(bare: Column) -> Column:
        quoted = F.filter(F.transform(F.regexp_extract_all(r, F.lit(QUOTED), F.lit(1)), X.strip), lambda n: n != "")
        inner = F.regexp_extract_all(bare, F.lit(r"\(([^)]*)\)"), F.lit(1))
        nick = F.concat(quoted, F.transform(F.filter(inner, is_nickname), X.strip))
        name = F.split_part(F.regexp_replace(bare, r"\([^)]*\)", " "), F.lit("/"), F.lit(1))

        def row(kept: Column) -> Column:
            def named(full: Column) -> Column:
                given = F.get(kept, F.lit(0))
                good = (F.size(kept) > 0) & ~X.casefold(full).isin(*NOT_CHARACTERS) & given.rlike(r"^\p{L}")
                return F.when(good, F.struct(given.alias("given"), full.alias("full_name"), nick.alias("nicknames")))

            return X.held(F.array_join(kept, " "), named)

        led = X.held(X.words(name), lambda ws: F.slice(ws, count(ws, PREFIX_TITLES) + 1, F.size(ws)))
        return X.held(X.held(led, lambda ws: F.slice(ws, F.lit(1), F.size(ws) - count(F.reverse(ws), SUFFIX_TITLES))), row)

    return X.held(F.regexp_replace(r, QUOTED, " "), credit)


def parse_credits(credits: DataFrame, column: str = "character") -> DataFrame:
    d = credits.select("*", once(parse_credit(column)).alias("_p")).where(F.col("_p").isNotNull())
    return d.select(*credits.columns, "_p.*")


def build_cast(parsed: DataFrame, series: str = "series") -> DataFrame:
    """Members by folded given name; the shown spelling prefers non-ASCII, then frequency.

    Every set is built from pre-distinct rows, so a name credited in a third of
    all rows is reduced before it is gathered.
    """
    full = F.when(F.col("full_name") != F.col("given"), F.col("full_name"))
    episode = F.when(F.col("episode").isNotNull(), F.struct("season", "episode"))
    per = parsed.groupBy(series, "given").agg(
        F.count("*").alias("_n"), F.collect_set(full).alias("_full"), F.collect_set("source").alias("_source"), F.collect_set(episode).alias("_episode"),
        F.bool_or(F.col("episode").isNull()).alias("_level"), F.array_distinct(F.flatten(F.collect_set("nicknames"))).alias("_nick"))
    # spellings and nicknames both read it; names are folded once per spelling
    d = cut_lineage(per.withColumn("member", X.fold("given")))
    united = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    shown = F.max_by("given", F.struct(F.col("given").rlike(r"[^\x00-\x7F]"), "_n", F.transform(F.split("given", ""), lambda c: -F.ascii(c))))
    members = d.groupBy(series, "member").agg(shown.alias("given"), united("_full").alias("full_names"), united("_source").alias("sources"), united("_episode").alias("episodes"), F.bool_or("_level").alias("series_level"))
    nicks = d.select(series, "member", F.explode("_nick").alias("_k")).distinct().withColumn("_kf", X.fold("_k")).where("_kf <> member")
    nicks = nicks.groupBy(series, "member").agg(F.array_sort(F.collect_set("_k")).alias("nicknames"))
    return members.join(nicks, [series, "member"], "left").withColumn("nicknames", F.coalesce("nicknames", F.array().cast("array<string>")))


def scope_for(cast: DataFrame, known: DataFrame, series: str = "series") -> DataFrame:
    """Scope strings per member; NULL means the whole series."""
    total = known.groupBy(series).agg(F.sum("last_episode").alias("_total"))
    c = cast.join(total, series, "left").withColumn("_total", F.greatest(F.coalesce("_total", F.lit(0)), F.lit(1)))
    wide = (F.col("series_level") & (F.size("episodes") == 0)) | (100 * F.size("episodes") >= REGULAR_PCT * F.col("_total"))
    per = c.where(~wide).select(series, "member", F.explode("episodes").alias("_e")).groupBy(series, "member", F.col("_e.season").alias("season")).agg(F.min("_e.episode").alias("_lo"), F.max("_e.episode").alias("_hi"))
    per = per.join(known, [series, "season"], "left")
    last = F.least(F.col("_hi") + SCOPE_MARGIN, F.coalesce("last_episode", F.col("_hi") + SCOPE_MARGIN))
    per = per.withColumn("_s", F.format_string("S%02dE%02d-E%02d", F.col("season").cast("int"), F.col("_lo").cast("int"), last.cast("int")))
    scopes = per.groupBy(series, "member").agg(F.transform(F.array_sort(F.collect_list(F.struct("season", "_s"))), lambda x: x["_s"]).alias("scope"))
    out = c.select(series, "member", wide.alias("_wide")).join(scopes, [series, "member"], "left")
    return out.select(series, "member", F.when(~F.col("_wide"), F.coalesce("scope", F.array().cast("array<string>"))).alias("scope"))


def name_shaped(text: str | Column, form: str | Column) -> Column:
    """The form is used as a name: apostrophe suffix, called out, or not sentence-initial."""
    t = F.col(text) if isinstance(text, str) else text
    f = F.col(form) if isinstance(form, str) else form
    q = F.concat(F.lit("\\Q"), f, F.lit("\\E"))
    kata = F.rlike(t, F.concat(F.lit("(?<![ァ-ンー])"), q, F.lit("(?![ァ-ンー])")))
    hang = F.rlike(t, F.concat(F.lit("(?<![가-힣])"), q))
    edge = F.concat(F.lit(f"(?<![{LETTER}])"), q, F.lit(f"(?![{LETTER}])"))
    called = F.rlike(t, F.concat(edge, F.lit(r"(?:['’]\p{L}|[,!?])")))
    # inside: the text before the hit is non-empty and does not end in a sentence start
    inside = F.rlike(t, F.concat(F.lit("(?s)^(?=.)(?:.*[^.!?…\"“”\\-–—:\\s]\\s*)"), edge))
    cjk = F.when(f.rlike("^[ァ-ンー]+$"), kata).when(f.rlike("^[가-힣]+$"), hang).otherwise(F.contains(t, f))
    return F.when((f == "") | (t == ""), False).when(f.rlike(CJK), cjk).otherwise(F.contains(t, f) & (called | inside))


def evidence_gate(hits: DataFrame, members: DataFrame, series: str = "series", min_episodes: int = MIN_EPISODES) -> DataFrame:
    """Name lines and episodes per member, with a skip reason where too few.

    ``members`` carries ``person_entry`` (already written by a person) and
    ``entry_everywhere`` for the series-wide flag.
    """
    n = hits.groupBy(series, "member").agg(F.count("*").alias("name_lines"), F.countDistinct("media_id").alias("name_episodes"))
    d = members.join(n, [series, "member"], "left").withColumns({"name_lines": F.coalesce("name_lines", F.lit(0)), "name_episodes": F.coalesce("name_episodes", F.lit(0))})
    few = (F.col("name_lines") < MIN_LINES) | (F.col("name_episodes") < min_episodes)
    why = F.when(F.col("person_entry"), "already in the glossary (entry written by a person)").when(
        few, F.format_string(f"used as a name in %d lines / %d episodes (needs {MIN_LINES} / {min_episodes})", "name_lines", "name_episodes"))
    return d.withColumns({"decision": F.when(why.isNotNull(), "skip"), "reason": why, "scope_flag": F.col("person_entry") & F.col("entry_everywhere") & F.col("scope").isNotNull()})


def probe_verdict(probes: DataFrame, keys: Sequence[str] = ("series", "member")) -> DataFrame:
    """Protect a name that translations lose often enough. Input: keys, translation, form."""
    out, form = X.fold("translation"), X.fold("form")
    d = probes.select(*keys, "line_id", once(out).alias("_o"), once(form).alias("_f"))
    kept = F.rlike("_o", F.concat(F.lit("(?<![a-z])\\Q"), "_f", F.lit("\\E(?![a-z])")))
    per = d.groupBy(*keys, "line_id").agg(F.bool_or(kept).alias("_kept"))
    v = per.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(~F.col("_kept")).alias("lost"))
    protect = (F.col("lost") >= MIN_FAILURES) & (100 * F.col("lost") >= FAILURE_PCT * F.col("total"))
    return v.withColumn("decision", F.when(protect, "protect").otherwise("skip"))


def even_sample(df: DataFrame, keys: Sequence[str], value: str, order: str, n: int) -> DataFrame:
    """Items ``floor(i*len/n)`` of the distinct values in order; all of them when few.

    ``order`` is an integer that grows with ``value``, used to split the scan.
    """
    d = df.select(*keys, value, order).distinct()
    size = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    r = scan(d, keys, order, {"_r": ("count", F.lit(1))}, ties=[value]).join(size, list(keys))
    # position p is taken when some i < n has floor(i*len/n) = p
    i = F.ceil(F.col("_r") * n / F.col("_n"))
    take = (F.col("_n") <= n) | ((i < n) & (F.floor(i * F.col("_n") / n) == F.col("_r")))
    return r.where(take).select(*keys, value)


def refresh_due(reports: DataFrame, counts: DataFrame, now: Column, days: float = 0.5, series: str = "series") -> DataFrame:
    """Reports that are old, or were blocked by the episode gate and now have more episodes."""
    blocked = F.exists("candidates", lambda c: (c["decision"] == "skip") & (c["name_lines"] >= MIN_LINES) & (c["name_episodes"] < MIN_EPISODES))
    d = counts.join(reports, series, "left")
    stale = F.col("checked_at").isNull() | (now - F.col("checked_at") > days * 86400)
    more = F.coalesce(blocked, F.lit(False)) & (F.col("episodes_now") > F.coalesce("episodes_with_subtitles", F.lit(0)))
    return d.where(stale | more).select(series, stale.alias("stale"))
