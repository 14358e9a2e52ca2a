"""Column expressions for subtitle text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sentence, clause and closer marks.
CLOSERS = r"['\"»)\]」』）】]*"
SENTENCE_END = r"[.!?…。？！]" + CLOSERS + "$"
CLAUSE_END = r"[,;:、]" + CLOSERS + "$"
UNSPACED = ("ja", "zh", "th")
#: Unicode white space, as ``(?U)\\s`` has it.
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The same as ranges: a class of single signs tests each of them on every character.
SPACE_RANGES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Between tokens that go as one text; below all signs of a token, so texts sort as arrays of tokens do.
TOKEN_MARK = "\u0001"
STRIP_PUNCT = ".,!?;:\"'()[]…、。？！「」『』（）【】"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used; inside of lambdas too, where plain expressions are computed anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def packed(tokens: Column) -> tuple[Column, Column]:
    """(text, array): tokens as one text, which takes a fraction of an array's room; the array only where the text does not give it back."""
    joined = F.array_join(tokens, TOKEN_MARK, TOKEN_MARK)
    whole = F.length(joined) - F.length(F.replace(joined, F.lit(TOKEN_MARK))) == F.size(tokens) - 1
    return F.when(whole, joined), F.when(~whole, tokens)


def strip(text: str | Column) -> Column:
    """Trim any Unicode white space, as a text editor would."""
    return F.btrim(_col(text), F.lit(SPACES))


def words(text: str | Column) -> Column:
    """White-space words; an empty text has none."""
    return F.regexp_extract_all(_col(text), F.lit(f"[^{SPACE_RANGES}]+"), F.lit(0))


def casefold(text: str | Column) -> Column:
    """Lower case that also folds sharp s and final sigma."""
    return F.translate(F.replace(F.lower(_col(text)), F.lit("ß"), F.lit("ss")), "ς", "σ")


def strip_chars(text: str | Column, chars: str) -> Column:
    return F.trim(_col(text), F.lit(chars))


def ends_sentence(text: str | Column) -> Column:
    return _col(text).rlike(SENTENCE_END)


def regex_quote(text: Column) -> Column:
    """Escape a literal for use inside a pattern column."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+\-?^$|/])", r"\\$1")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: str | Column) -> Column:
    """Compatibility form; ASCII is its own and does not reach the UDF."""
    c = _col(text)
    ascii_ = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_, c).otherwise(_nfkc(F.when(~ascii_, c)))


def with_nfkc(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``text`` in its compatibility form, rows read as batches: no row waits, on disk if need be, for a UDF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            c = b.column(i)
            if not pc.all(pc.string_is_ascii(c), min_count=0).as_py():
                forms = [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in c.to_pylist()]
                b = b.set_column(i, b.schema.field(i), pa.array(forms, c.type))
            yield b

    return df.mapInArrow(run, df.schema)


@F.pandas_udf(T.StringType())
def _fold_unicode(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        decomposed = unicodedata.normalize("NFKD", t.replace("ı", "i").replace("İ", "I"))
        return "".join(c for c in decomposed if not unicodedata.combining(c)).casefold()

    return text.map(one)


def fold(text: str | Column) -> Column:
    """Accent- and case-free form; pure ASCII is folded in the JVM, only other text by the UDF."""
    c = _col(text)
    ascii_ = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_, F.lower(c)).otherwise(_fold_unicode(F.when(~ascii_, c)))


def fold_ascii_first(text: str | Column) -> tuple[Column, Column]:
    """(needs Unicode folding, cheap folded form) for plans that split the two cases."""
    c = _col(text)
    return c.rlike(r"[^\x00-\x7F]"), F.lower(c)


def unbalanced_brackets(text: str | Column) -> Column:
    """A stack of awaited closers; ``!`` marks a mismatch."""
    only = F.regexp_replace(_col(text), r"[^()\[\]{}]", "")
    closer = F.translate(F.lit("([{"), "([{", ")]}")

    def step(stack: Column, ch: Column) -> Column:
        at = F.instr(F.lit("([{"), ch)
        push = F.concat(F.substring(closer, at, F.lit(1)), stack)
        pop = F.when(F.substring(stack, 1, 1) == ch, F.substring(stack, F.lit(2), F.length(stack))).otherwise(F.lit("!"))
        return F.when(F.startswith(stack, F.lit("!")), stack).when(at > 0, push).otherwise(pop)

    return F.when(only == "", False).otherwise(F.aggregate(F.split(only, ""), F.lit(""), lambda s, c: F.when(c == "", s).otherwise(step(s, c))) != "")


def is_run_on(source: str | Column) -> Column:
    """No sentence mark at all and eight words or more."""
    c = _col(source)
    return ~c.rlike("[.!?…]") & (F.size(words(c)) >= 8)


def clean_reference(text: str | Column) -> Column:
    """Human reference text without sounds, notes and speaker dashes."""
    c = F.regexp_replace(_col(text), r"\([^)]*\)|\[[^\]]*\]|♪|♫", " ")
    c = F.regexp_replace(c, r"(?U)(^|\s)-\s*", " ")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def is_lyric_start(text: str | Column) -> Column:
    return _col(text).rlike("^[\"“♪]")


def is_song_or_sound(text: str | Column) -> Column:
    c = _col(text)
    return is_lyric_start(F.ltrim(c, F.lit("-( "))) | (clean_reference(c) == "")


def srt_stamp(ms: str | Column) -> Column:
    """``HH:MM:SS,mmm``; negative times clamp to zero."""
    t = F.greatest(_col(ms), F.lit(0)).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000)
