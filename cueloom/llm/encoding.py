"""Exact, cached encoding with a byte-level BPE of the tokenizers library, for use inside tasks.

The pre-tokenizer of such vocabularies opens a new piece at every space that a non-space follows, and
at every line feed between two non-spaces, so a text is the concatenation of its units (its start,
then ` word` by ` word`), and equal units have equal ids. A task encodes each unit once while its
bounded cache holds it; units are looked up and taken apart as Arrow columns, and the words that are new to
a group go to the library as one text with a delimiter between them. Added tokens of the vocabulary (`<|endoftext|>`) cut a text before that: what
lies between them is split as texts of their own, as the library does.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Beyond so many units or ids a task's cache keeps only units met again: the bound of its memory (about 100 MB).
CACHE_UNITS = 450_000
CACHE_IDS = 12_000_000
#: Characters handled at once; longer texts are taken in parts, cut before the space of a unit.
GROUP = 1 << 22

_UNIT = re.compile(r" (?=\S)")
_STARTS = re.compile(r"(?=(?: |(?<=\S)\n)\S)")
_WS = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Spaces and line feeds that stand in runs or at an end: texts with such are split by _STARTS.
_GLUED = f" ({_WS}|$)|\n({_WS}|$)|{_WS}\n"


def _units_of(text: str) -> list[str]:
    """The start of a text and its units, each without its opening space."""
    first, *rest = _STARTS.split(text)
    return [first, *[u[1:] if u[0] == " " else u for u in rest]]


def parts_of(text: str, size: int = GROUP) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cut = _UNIT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


#: Byte to character of such vocabularies: printable ones stand for themselves, the rest follow from 256 on.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _KEPT} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _KEPT)}
#: A word of letters with signs after it: one piece of letters and one of signs, by the pre-tokenizer's rule.
_WORD = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<signs>[.,!?;:*#$%&|]*)$"
#: Stands between words that are encoded together: a line feed, which no word has.
_BETWEEN = chr(_BYTES[10])
#: Words of one text given to the library.
JOINED = 4_096


@lru_cache(2)
def unit_encoder(path: str) -> UnitEncoder:
    """The encoder of this worker process; its cache lasts from task to task."""
    return UnitEncoder(path)


class UnitEncoder:
    """Texts of an Arrow column to their ids, flat and with the number of ids per text."""

    #: Part of the bounds above that an encoder uses.
    share = 1.0

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if self.tokenizer.normalizer or any(t.single_word or t.lstrip or t.rstrip for t in added.values()) or len({t.normalized for t in added.values()}) > 1:
            raise ValueError("only plain added tokens and no normalizer are known here")
        self.added = {t.content: i for i, t in added.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        # bytes go in as the characters that stand for them; pieces end at the delimiter, so nothing else has to be split
        self.piece = Tokenizer.from_file(path)
        self.piece.pre_tokenizer = Split(_BETWEEN, "isolated")
        self.between = self.piece.token_to_id(_BETWEEN)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self._clear()

    def _clear(self) -> None:
        self.count = 0
        self.names: list[pa.Array] = [pa.array([], pa.string())]  # known units, in order
        self.tails: dict[str, np.ndarray] = {}
        self.ids = np.empty(1 << 20, self.dtype)
        self.ends = np.zeros(1 << 18, np.int64)  # unit i has ids[ends[i]:ends[i + 1]]
        self.met = np.zeros(1 << 18, np.int32)  # groups that had unit i

    def _known(self) -> pa.Array:
        if len(self.names) > 1:
            self.names = [pa.concat_arrays(self.names)]
        return self.names[0]

    def _find(self, units: pa.Array) -> np.ndarray:
        """Places of units in the cache, or -1."""
        return pc.fill_null(pc.index_in(units, value_set=self._known()), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _shrink(self) -> None:
        """Keep the units that more than one group had, or nothing if these are too many."""
        names, ends, met, ids, count = self._known(), self.ends, self.met, self.ids, self.count
        keep = np.flatnonzero(met[:count] > 1)
        self._clear()
        if len(keep) <= CACHE_UNITS * self.share / 2:
            sizes = ends[keep + 1] - ends[keep]
            if sizes.sum() <= CACHE_IDS * self.share / 2:
                self._add(names.take(pa.array(keep)), ids[_ragged(ends[keep], sizes)], sizes)
                self.met[: len(keep)] = 1

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), self.dtype), np.fromiter(map(len, lists), np.int64, len(lists))

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of words of letters, each with a space in front."""
        texts = words.to_pylist()
        if not pc.all(pc.string_is_ascii(words)).as_py():
            texts = [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in texts]
        parts = [_BETWEEN.join(["Ġ" + w for w in texts[i : i + JOINED]]) + _BETWEEN for i in range(0, len(texts), JOINED)]
        flat = np.concatenate([np.array(e.ids, self.dtype) for p in parts for e in self.piece.encode_batch_fast([p], add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.between)
        return flat[flat != self.between], np.diff(ends, prepend=-1) - 1

    def _add(self, units: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Put new units in the cache; their places."""
        n = self.count
        if n + len(units) + 1 > len(self.ends):
            self.ends = np.resize(self.ends, 2 * (n + len(units) + 1))
            self.met = np.concatenate([self.met, np.zeros(len(self.ends) - len(self.met), np.int32)])
        at = self.ends[n]
        if at + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (at + len(flat)))
        self.ids[at : at + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(units)] = at + np.cumsum(sizes)
        self.names.append(units)
        self.count = n + len(units)
        return np.arange(n, self.count)

    def _spell(self, units: list[str]) -> list[str]:
        return [u if u[:1] == "\n" else " " + u for u in units]

    def _learn(self, units: pa.Array) -> np.ndarray:
        """Encode units that the cache does not hold; their places."""
        places = np.empty(len(units), np.int64)
        taken = pc.extract_regex(units, _WORD)
        is_word = pc.is_valid(taken).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~is_word)
        if len(rest):
            whole = units.take(pa.array(rest))
            places[rest] = self._add(whole, *self._encode(self._spell(whole.to_pylist())))
        word, signs = pc.struct_field(taken, 0), pc.struct_field(taken, 1)
        signed = np.flatnonzero(is_word & pc.fill_null(pc.not_equal(signs, ""), False).to_numpy(zero_copy_only=False))
        plain = is_word.copy()
        plain[signed] = False
        bare = np.flatnonzero(plain)
        heads = word.take(pa.array(signed)).dictionary_encode()
        at = self._find(heads.dictionary) if len(signed) else np.zeros(0, np.int64)
        lost = heads.dictionary.filter(pa.array(at < 0))
        # words of this group, with and without signs, once each
        fresh = pc.unique(pa.concat_arrays([units.take(pa.array(bare)), lost]))
        if len(fresh):
            first = self._add(fresh, *self._encode_words(fresh))[0]
            places[bare] = first + np.arange(len(bare))  # distinct, so they stand first
            if len(lost):
                at[at < 0] = first + pc.index_in(lost, value_set=fresh).to_numpy(zero_copy_only=False)
        if len(signed):
            at = at[heads.indices.to_numpy(zero_copy_only=False)]
            coded = signs.take(pa.array(signed)).dictionary_encode()
            names = coded.dictionary.to_pylist()
            for tail in set(names).difference(self.tails):
                self.tails[tail] = self._encode([tail])[0]
            tails = [self.tails[t] for t in names]
            length = np.fromiter(map(len, tails), np.int64, len(tails))
            which = coded.indices.to_numpy(zero_copy_only=False)
            heads_n, tails_n = self.ends[at + 1] - self.ends[at], length[which]
            flat = np.empty(heads_n.sum() + tails_n.sum(), self.dtype)
            begin = np.cumsum(heads_n + tails_n) - heads_n - tails_n
            flat[_ragged(begin, heads_n)] = self.ids[_ragged(self.ends[at], heads_n)]
            flat[_ragged(begin + heads_n, tails_n)] = np.concatenate(tails)[_ragged((np.cumsum(length) - length)[which], tails_n)]
            places[signed] = self._add(units.take(pa.array(signed)), flat, heads_n + tails_n)
        return places

    def _slots(self, units: pa.Array) -> np.ndarray:
        coded = units.dictionary_encode()
        names = coded.dictionary
        slots = self._find(names)
        fresh = np.flatnonzero(slots < 0)
        if self.count + len(fresh) > CACHE_UNITS * self.share or self.ends[self.count] > CACHE_IDS * self.share:
            self._shrink()
            slots = self._find(names)
            fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            slots[fresh] = self._learn(names.take(pa.array(fresh)))
        self.met[slots] += 1
        return slots[coded.indices.to_numpy(zero_copy_only=False)]

    def _between(self, text: str) -> tuple[list[str], list[int]]:
        """The parts of a text between its added tokens, and the ids of these."""
        return self.cut.split(text), [self.added[t] for t in self.cut.findall(text)]

    def _group(self, texts: pa.Array, tail: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per text; tail: an id put after each text."""
        tails = np.full(len(texts), -1 if tail is None else tail, np.int64)
        if not any(pc.any(pc.match_substring(texts, t)).as_py() for t in self.added):
            return self._parts(texts, tails)
        parts, after, counts = [], [], []
        for text, last in zip(texts.to_pylist(), tails.tolist(), strict=True):
            own, ids = self._between(text)
            parts += own
            after += [*ids, last]
            counts.append(len(own))
        flat, sizes = self._parts(pa.array(parts, pa.string()), np.array(after, np.int64))
        return flat, np.add.reduceat(sizes, np.cumsum(counts) - counts)

    def _parts(self, texts: pa.Array, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per text without added tokens; tails: an id put after each text, or -1."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        if pc.any(glued := pc.match_substring_regex(texts, _GLUED)).as_py():
            own = [_units_of(t.as_py()) if g else None for t, g in zip(texts, glued.to_pylist(), strict=True)]
            split = pa.array([o if o is not None else s.as_py() for o, s in zip(own, split, strict=True)], pa.list_(pa.string()))
        n, offsets = len(texts), split.offsets.to_numpy() - split.offsets[0].as_py()
        parts = split.flatten()
        is_first = np.zeros(len(parts), bool)
        is_first[offsets[:-1]] = True
        head, head_sizes = self._encode(parts.filter(pa.array(is_first)).to_pylist())
        slots = np.empty(len(parts), np.int64)
        slots[~is_first] = self._slots(parts.filter(pa.array(~is_first)))
        slots[is_first] = 0
        starts = self.ends[slots]
        sizes = np.where(is_first, 0, self.ends[slots + 1] - starts)
        extra = tails >= 0
        # lengths per text: head, units, tail
        unit_sizes = np.add.reduceat(sizes, offsets[:-1]) if n else np.zeros(0, np.int64)
        total = head_sizes + unit_sizes + extra
        out = np.empty(total.sum(), self.dtype)
        ends = np.cumsum(total)
        begin = ends - total
        out[_ragged(begin, head_sizes)] = head
        out[ends[extra] - 1] = tails[extra]
        out[_ragged(begin + head_sizes, unit_sizes)] = self.ids[_ragged(starts, sizes)]
        return out, total

    def _long(self, text: str, group: int) -> list[np.ndarray]:
        """Ids of a text that is taken in parts."""
        own, added = self._between(text)
        out = []
        for part, after in zip(own, [*added, -1], strict=True):
            *most, last = parts_of(part, group)
            out += [self._parts(pa.array([p]), np.array([-1]))[0] for p in most]
            out.append(self._parts(pa.array([last]), np.array([after]))[0])
        return out

    def __call__(self, texts: pa.Array, tail: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number per text) of consecutive runs of texts; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        chars = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        group = int(GROUP * self.share)
        at = 0
        while at < len(texts):
            before = chars[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(chars, before + group, "right")))
            if end == at + 1 and chars[at] - before > group:
                runs = self._long(texts[at].as_py(), group)
                if tail is not None:
                    runs.append(np.array([tail], self.dtype))
                ids = np.concatenate(runs)
                yield ids, np.array([len(ids)])
            else:
                yield self._group(texts[at:end], tail)
            at = end


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + sizes[i] - 1, one run after the other."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
