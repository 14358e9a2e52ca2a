"""Spelling variants by bidirectional FM-index search: half a word exactly, the other half with one error.

Two words one edit apart share a half: with w cut after its first h = length // 2 code points, either the other
word begins with w[:h], or it ends with w[h:]. So every word is indexed under the halves that words of its own
length, one less and one more would ask for, at both ends; it asks under its own two halves. Words that share a
hashed half meet in a shard; a shard of more than BLOCK words is split into index blocks and query blocks.

A task builds the FM-index of a block's delimited vocabulary `$word$word$` and of its reverse (rows of cumulative
symbol counts, so that a step is a few lookups for all queries at once). A query walks left through its half and
the delimiter, keeping the suffix-rank intervals of both directions, then right across its other half: at each
place a state without an error also branches into one replaced, added or left-out code point, then goes on
exactly, to the closing delimiter. Words that share the last half are searched the same way, reversed. A pair
that both ways find is reported by the first alone. Only the number of near words and the best of them leave the
task: one row per word and block.

Counts are native and combined before the shuffle. The forms' chains rise by a factor in frequency, so they have
no cycles; roots follow by pointer jumping.

Defined results: null and empty texts have no words; a null doc_id is spelled as nothing in the draw of
deletions; equal rows count each; of near words with equal counts the smallest in code-point order is the form;
an empty table gives no rows. A block takes some 200 bytes of memory per code point; a word longer than a block is
a block of its own. Extra columns do not matter: only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import lower_ascii, stored

#: Least code points and occurrences of a word, and how much more frequent its form must be.
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point.
DELETION_EVERY = 199
#: Words of an index block and of a query block.
BLOCK = 6_000
#: States that are carried on at once.
STATES = 1 << 15


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, some of them with a code point left out, with their number."""
    run = F.explode(F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}"), F.lit(0))).alias("run")
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    drawn = docs.select("doc_id", run).withColumn("h", F.crc32(name.cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % DELETION_EVERY == 0, cut).otherwise(F.col("run")).alias("word")
    return drawn.select(word).where(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


# ------------------------------------------------------------------------------------------- index


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes in order: several symbols at once as a number, then prefix doubling."""
    bits = max(1, int(symbols).bit_length())
    step = 62 // bits
    key = np.zeros(len(text), np.int64)
    for i in range(step):
        key <<= bits
        if i < len(text):
            key[: len(text) - i] |= text[i:] + 1
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while rank.max() + 1 < len(text):
        after = np.zeros(len(text), np.int64)
        after[: len(text) - step] = rank[step:] + 1
        rank = np.unique(rank * (len(text) + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    out = np.empty(len(text), np.int64)
    out[rank] = np.arange(len(text))
    return out


class Direction:
    """counts[i, c]: symbols below c among the first i of the transformed text."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.order = suffix_array(text, symbols)
        before = text[self.order - 1]
        self.counts = np.zeros((len(text) + 1, symbols + 1), np.int32)
        self.counts[np.arange(1, len(text) + 1), before + 1] = 1
        np.cumsum(self.counts, axis=0, out=self.counts)
        np.cumsum(self.counts, axis=1, out=self.counts)
        self.first = self.counts[-1]


class Index:
    """A bidirectional FM-index of delimited words. A state is (lo, back, size): the interval of a pattern in the
    suffixes of the text, its start in those of the reversed text, and the length of both."""

    def __init__(self, words: list[np.ndarray], symbols: int):
        """words: arrays of symbols from 1 on; 0 is the delimiter."""
        sizes = np.array([len(w) for w in words], np.int64)
        self.text = np.zeros(int(sizes.sum()) + len(words) + 1, np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes
        self.text[_ragged(self.starts, sizes)] = np.concatenate(words)
        self.ahead = Direction(self.text, symbols)
        self.behind = Direction(self.text[::-1], symbols)

    @staticmethod
    def _step(way: Direction, at: np.ndarray, other: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, lower = way.counts[at, c], way.counts[at + size, c]
        rank = way.counts[at, c + 1] - low
        return way.first[c] + rank, other + (lower - low), way.counts[at + size, c + 1] - lower - rank

    def left(self, state, c):
        lo, back, size = state
        return self._step(self.ahead, lo, back, size, c)

    def right(self, state, c):
        lo, back, size = state
        back, lo, size = self._step(self.behind, back, lo, size, c)
        return lo, back, size

    def branches(self, state) -> tuple[np.ndarray, np.ndarray]:
        """(row, symbol) of every symbol but the delimiter that follows a state's pattern."""
        _, back, size = state
        counts = self.behind.counts
        gained = np.diff(counts[back + size] - counts[back], axis=1)
        gained[:, 0] = 0
        return np.nonzero(gained)

    def word_at(self, lo: np.ndarray) -> np.ndarray:
        """Number of the word whose `$word$` has rank lo."""
        return np.searchsorted(self.starts, self.ahead.order[lo] + 1)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def near_by_first_half(index: Index, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of the words that share a query's first half and are one edit away in the rest."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort([len(q) for q in queries], kind="stable")
    sizes = np.array([len(queries[i]) for i in order], np.int64)
    at = 0
    while at < len(order):  # queries of one length walk together
        end = min(int(np.searchsorted(sizes, sizes[at], "right")), at + 1024)
        rows = order[at:end]
        for q, word in _walk(index, np.stack([queries[i] for i in rows])):
            found.append((rows[q], word))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
    return pairs[0], pairs[1]


def _walk(index: Index, words: np.ndarray):
    n, length = words.shape
    half = length // 2
    state = (np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(index.text), np.int64))
    zero = np.zeros(n, np.int64)
    for i in range(half - 1, -1, -1):
        state = index.left(state, words[:, i])
    state = index.left(state, zero)
    alive = np.flatnonzero(state[2] > 0)
    state = tuple(x[alive] for x in state)
    for i in range(half, length + 1):
        for at in range(0, len(alive), STATES // 64):
            own, some = alive[at : at + STATES // 64], tuple(x[at : at + STATES // 64] for x in state)
            row, symbol = index.branches(some)
            grown = index.right(tuple(x[row] for x in some), symbol)
            # an added code point, a replaced one, one left out
            yield from _finish(index, words, own[row], i, grown)
            if i < length:
                other = symbol != words[own[row], i]
                yield from _finish(index, words, own[row][other], i + 1, tuple(x[other] for x in grown))
                yield from _finish(index, words, own, i + 1, some)
        if i == length:
            break
        state = index.right(state, words[alive, i])
        here = state[2] > 0
        alive, state = alive[here], tuple(x[here] for x in state)
        if not len(alive):
            break


def _finish(index: Index, words: np.ndarray, query: np.ndarray, at: int, state):
    """States with their error behind them go on exactly to the closing delimiter."""
    for i in range(at, words.shape[1] + 1):
        if not len(query):
            return
        state = index.right(state, words[query, i] if i < words.shape[1] else np.zeros(len(query), np.int64))
        here = state[2] > 0
        query, state = query[here], tuple(x[here] for x in state)
    if len(query):
        yield query, index.word_at(state[0])


# ------------------------------------------------------------------------------------------- blocks

_NEAR = "word string, near bigint, best_n bigint, best string"


def search_block(table: pa.Table) -> pa.Table:
    """Near words of the queries of a block among its indexed words."""
    side = table.column("side")[0].as_py()
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    words = table.column("word").to_pylist()
    n = table.column("n").to_numpy(zero_copy_only=False)
    known, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    empty = pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    if not len(known) or not len(asking):
        return empty
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    alphabet, flat = np.unique(np.concatenate(points), return_inverse=True)
    coded = np.split(flat.astype(np.int64) + 1, np.cumsum([len(p) for p in points])[:-1])
    if side:  # the last half is the first of the reversed word
        coded = [c[::-1] for c in coded]
    query, word = near_by_first_half(Index([coded[i] for i in known], len(alphabet) + 1), [coded[i] for i in asking])
    query, word = asking[query], known[word]
    if side and len(query):  # what shares the first half too has been found from there
        same = np.array([words[q][: len(words[q]) // 2] == words[w][: len(words[q]) // 2] for q, w in zip(query.tolist(), word.tolist(), strict=True)], bool)
        query, word = query[~same], word[~same]
    if not len(query):
        return empty
    names = np.array([words[i] for i in word], object)
    order = np.lexsort((np.unique(names, return_inverse=True)[1], -n[word], query))
    first = np.flatnonzero(np.diff(query[order], prepend=-1))
    best = word[order[first]]
    return pa.table({"word": pa.array([words[i] for i in query[order[first]]], pa.string()), "near": pa.array(np.diff(np.append(first, len(order)))), "best_n": pa.array(n[best].astype(np.int64)), "best": pa.array([words[i] for i in best], pa.string())})


def _half(word: Column, side: int, length: Column) -> Column:
    """What a word of `length` code points shares with this one at an end: its first half, or its last one."""
    half = F.floor(length / 2).cast("int")
    return F.concat(half.cast("string"), F.lit(":"), F.left(word, half)) if side == 0 else F.concat((length - half).cast("string"), F.lit(":"), F.right(word, (length - half).cast("int")))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best) from stored (word, n): words that have near words, with the most frequent of them."""
    size = F.char_length("word")
    halves = max(1, -(-words.count() * 4 // BLOCK))
    shard = lambda half: F.pmod(F.xxhash64(half), F.lit(halves))
    rows = None
    for side in (0, 1):
        known = words.select(F.lit(side).alias("side"), "word", "n", F.lit(False).alias("asks"), F.explode(F.array_distinct(F.array(*[shard(_half(F.col("word"), side, size + d)) for d in (-1, 0, 1)]))).alias("shard"))
        asking = words.select(F.lit(side).alias("side"), "word", "n", F.lit(True).alias("asks"), shard(_half(F.col("word"), side, size)).alias("shard"))
        both = known.unionByName(asking)
        rows = both if rows is None else rows.unionByName(both)
    rows = stored(rows)
    # code points count too: long words fill a block sooner
    weight = F.greatest(F.count(F.lit(1)), F.sum(F.char_length("word")) / 16)
    sizes = stored(rows.where("NOT asks").groupBy("side", "shard").agg(F.ceil(weight / BLOCK).alias("blocks")))
    split = rows.join(sizes, ["side", "shard"])
    own = F.pmod(F.xxhash64("word"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    known = split.where("NOT asks").select("side", "shard", own.alias("block"), F.explode(every).alias("turn"), "word", "n", "asks")
    asking = split.where("asks").select("side", "shard", F.explode(every).alias("block"), own.alias("turn"), "word", "n", "asks")
    found = known.unionByName(asking).groupBy("side", "shard", "block", "turn").applyInArrow(search_block, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form) without cycles: each round doubles how far a word sees."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = step.select("word", "root")
        if not step.where("_moved").limit(1).count():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = stored(words_of(docs))
    near = stored(words.join(near_words(words), "word", "left"))
    chosen = F.coalesce(F.col("best_n") >= RATIO * F.col("n"), F.lit(False))
    named = near.select("word", "n", F.coalesce("near", F.lit(0)).cast("bigint").alias("n_near"), F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n"))
    ends = roots(named.where(F.col("form").isNotNull()))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
