"""SentencePiece encoding and decoding of a byte-pair model, giant documents by a max-plus scan over chunks.

A text is normalised as the model says: a dummy space in front, spaces as U+2581. No piece has a U+2581 after
another character, nor a line feed, so a text falls into units that are cut on their own; the library encodes
each unit once while a task's bounded cache holds it.

A document longer than CHUNK is split into chunks at any place, also inside a unit. What makes a cut the library's
one, though its merges have an order, can be said of neighbours alone: two neighbouring pieces, joined, have to
encode to just these two. Such a pair weighs 0, any other minus infinity, and the best sum is 0 for exactly one
cut (the tests hold this against the library on random and tie-rich strings). The state at a boundary between
chunks is the piece that ends at it or reaches over it. A chunk yields the matrix of best sums from its entry to
its exit states, matrices are combined associatively (max-plus products of blocks of chunks, then of blocks),
prefix and suffix vectors give the state at every boundary, and each chunk is then traced back on its own between
its two states. An endless run without spaces is cut like any other text. A character without a piece of its own
is a state as well; it becomes its bytes.

Defined results: null and empty texts have no pieces; U+2581 in a text decodes as a space, as in the library;
ties between merges fall as in the library; repeated rows are encoded one by one; an empty table gives no rows.
Columns named n_tokens, ids or round_trip are replaced, all other columns are kept whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import small_side, stored
from cueloom.llm.encoding import UnitEncoder, _ragged

SPACE = "▁"
#: Characters of a chunk; longer documents are encoded by several tasks.
CHUNK = 1 << 16
#: Chunks whose matrices are combined into one block by a task.
BLOCK = 256
#: Pairs of pieces whose neighbourhood a task remembers.
PAIRS = 1 << 18
NONE = -(1 << 58)

_PIECES = re.compile("▁+[^▁\n]*|\n[^▁\n]*|^[^▁\n]+")
_ODD = "  |^ | $|▁| \n|\n "


class Model:
    """Pieces and byte pieces of a model file, and which pieces may stand side by side."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only identity normalisation with a dummy prefix is known here")
        kind = model.SentencePiece.Type
        self.pieces = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL]
        if model.trainer_spec.model_type != model.trainer_spec.BPE or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("a byte-pair model without user-defined or unused pieces is expected")
        self.byte_ids = np.array([i for i, p in enumerate(model.pieces) if p.type == kind.BYTE], np.int64)
        if len(self.byte_ids) != 256:
            raise ValueError("a model with byte pieces is expected")
        self.longest = max(len(self.pieces[i]) for i in normal)
        if any(SPACE in self.pieces[i].lstrip(SPACE) or "\n" in self.pieces[i] for i in normal):
            raise ValueError("a piece crosses the start of a unit")
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else b"" if p.type in (kind.CONTROL, kind.UNKNOWN) else p.piece.encode() for p in model.pieces]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_sizes = np.array([len(x) for x in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.ids = {self.pieces[i]: i for i in normal}
        import sentencepiece

        rules.add_dummy_prefix = False  # units bring their own
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.neighbours: dict[tuple[int, int], bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether piece b may stand behind piece a: joined they encode to just these two."""
        if a < 0 or b < 0:
            return True  # characters without a piece never merge
        known = self.neighbours.get((a, b))
        if known is None:
            if len(self.neighbours) >= PAIRS:
                self.neighbours.clear()
            known = self.neighbours[a, b] = self.library.encode(self.pieces[a] + self.pieces[b]) == [a, b]
        return known

    def chain(self, text: str, start: int, before: int | None, stop: int) -> tuple[list[int | None], list[int]]:
        """Per end from start to stop (counted from start) the one piece that a feasible cut can have there, and its length.

        before: the piece that ends at start, None at the start of a unit. -1 is a character without a piece.
        """
        piece: list[int | None] = [None] * (stop - start + 1)
        size = [0] * (stop - start + 1)
        for end in range(1, stop - start + 1):
            for n in range(1, min(self.longest, end) + 1):
                found = self.ids.get(text[start + end - n : start + end], -1 if n == 1 else None)
                if found is None or (n < end and piece[end - n] is None):
                    continue
                last = before if n == end else piece[end - n]
                if last is None or self.may_follow(last, found):
                    piece[end], size[end] = found, n
                    break
        return piece, size

    # -- boundary states ---------------------------------------------------------------------------

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(start, end) of every piece that ends at a place or reaches over it, in a fixed order.

        No piece reaches over the start of a unit, and what ends there does not matter: one state.
        """
        if at in (0, len(text)) or text[at] == "\n" or (text[at] == SPACE and text[at - 1] != SPACE):
            return [(at, at)]
        return [(start, end) for start in range(max(0, at - self.longest), at) for end in range(at, min(len(text), start + self.longest) + 1) if end - start == 1 or text[start:end] in self.ids]

    def piece_at(self, text: str, span: tuple[int, int]) -> int | None:
        return None if span[0] == span[1] else self.ids.get(text[span[0] : span[1]], -1)

    def transfer(self, text: str, left: int, right: int) -> np.ndarray:
        """Best sums (0 or none) from the entry states at left to the exit states at right."""
        entries, exits = self.states(text, left), self.states(text, right)
        place = {span: k for k, span in enumerate(exits)}
        # starts of units, where all that came before is alike
        marks = [c.start() for c in _PIECES.finditer(text) if left < c.start() <= right]
        if right == len(text):
            marks.append(right)

        def exits_behind(start: int, before: int | None) -> list[int]:
            if place.get((start, start)) is not None:
                return [0]
            piece, size = self.chain(text, start, before, min(len(text), right + self.longest))
            ends = range(max(right, start + 1) - start, len(piece))
            return [place[start + e - size[e], start + e] for e in ends if piece[e] is not None and start + e - size[e] < right]

        behind = exits_behind(marks[-1], None) if marks else []
        out = np.full((len(entries), len(exits)), NONE, np.int64)
        for k, (begin, end) in enumerate(entries):
            if (begin, end) in place:  # it reaches over the whole chunk
                out[k, place[begin, end]] = 0
            elif not marks:
                out[k, exits_behind(end, self.piece_at(text, (begin, end)))] = 0
            elif end == marks[0] or self.chain(text, end, self.piece_at(text, (begin, end)), marks[0])[0][-1] is not None:
                out[k, behind] = 0
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Pieces to text: bytes are joined, U+2581 is a space, the dummy space in front goes."""
        raw = self.raw[_ragged(self.raw_starts[ids], self.raw_sizes[ids])].tobytes()
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


class MergeEncoder(UnitEncoder):
    """Texts to piece ids with the bounded unit cache of its base: the library encodes each unit once."""

    share = 0.35  # a worker keeps this cache from stage to stage

    def __init__(self, path: str):
        self.model = Model(path)
        self.dtype = np.dtype(np.uint16 if len(self.model.pieces) <= 1 << 16 else np.uint32)
        self._clear()

    def _cuts(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, flat, and their number."""
        lists = self.model.library.encode(units, out_type=int, num_threads=1)
        return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))

    def _learn(self, units: pa.Array) -> np.ndarray:
        flat, sizes = self._cuts([u if u[:1] == "\n" else SPACE + u for u in units.to_pylist()])
        return self._add(units, flat.astype(self.dtype), sizes)

    def _group(self, texts: pa.Array, tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        odd = pc.match_substring_regex(texts, _ODD).to_pylist()
        if any(odd):
            own = [self.units_of(SPACE + t.as_py().replace(" ", SPACE)) if o else s.as_py() for t, o, s in zip(texts, odd, split, strict=True)]
            split = pa.array(own, pa.list_(pa.string()))
        return self._ids_of(split, np.array([bool(len(t.as_py())) for t in texts]))

    def _long(self, text: str, group: int) -> list[np.ndarray]:
        units = self.units_of(SPACE + text.replace(" ", SPACE))
        return [self._ids_of(pa.array([units]), np.array([True]))[0]]

    def _ids_of(self, split: pa.Array, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        parts = split.flatten()
        live = np.repeat(full, np.diff(offsets))
        slots = self._slots(parts if live.all() else parts.filter(pa.array(live)))
        sizes = np.zeros(len(parts), np.int64)
        sizes[live] = self.ends[slots + 1] - self.ends[slots]
        total = np.add.reduceat(np.append(sizes, 0), offsets[:-1]) if len(full) else np.zeros(0, np.int64)
        total[np.diff(offsets) == 0] = 0
        return self.ids[_ragged(self.ends[slots], sizes[live])], total

    @staticmethod
    def units_of(text: str) -> list[str]:
        """Units of a normalised text, without the U+2581 that opens them."""
        return [u[1:] if u[0] == SPACE else u for u in (m.group() for m in _PIECES.finditer(text))]

    def trace(self, text: str, start: int, before: int | None, stop: int) -> np.ndarray:
        """Ids of the cut from start, behind a piece, to stop, where a piece ends."""
        if start >= stop:
            return np.zeros(0, self.dtype)
        cuts = [c.start() for c in _PIECES.finditer(text) if start <= c.start() <= stop]
        out = []
        if not cuts or cuts[0] > start:
            out.append(self._back(text, start, before, cuts[0] if cuts else stop))
        if cuts:
            if cuts[-1] > cuts[0]:
                out.append(self._ids_of(pa.array([self.units_of(text[cuts[0] : cuts[-1]])]), np.array([True]))[0])
            out.append(self._back(text, cuts[-1], None, stop))
        return np.concatenate(out)

    def _back(self, text: str, start: int, before: int | None, stop: int) -> np.ndarray:
        piece, size = self.model.chain(text, start, before, stop)
        out: list[int] = []
        end = stop
        while end > start:
            if piece[end - start] is None:
                raise ValueError("a boundary state does not fit")
            if piece[end - start] < 0:
                out += reversed(self.model.byte_ids[list(text[end - 1].encode("utf-8", "surrogatepass"))].tolist())
            else:
                out.append(piece[end - start])
            end -= size[end - start]
        return np.array(out[::-1], self.dtype)


@lru_cache(2)
def merge_encoder(path: str) -> MergeEncoder:
    return MergeEncoder(path)


_DONE = "n_tokens bigint, ids array<int>, round_trip boolean"


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def _whole(model: str):
    """Rows to rows with pieces, for texts that one task encodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = merge_encoder(model)
        for batch in batches:
            at = 0
            kept = batch.column("row")
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            for ids, sizes in encode(texts):
                ends = np.cumsum(sizes)
                source = texts[at : at + len(sizes)].to_pylist()
                same = [encode.model.decode(ids[e - s : e].astype(np.int64)) == t for e, s, t in zip(ends.tolist(), sizes.tolist(), source, strict=True)]
                yield pa.record_batch([kept[at : at + len(sizes)], pa.array(sizes, pa.int64()), _lists(ids, sizes), pa.array(same)], ["row", "n_tokens", "ids", "round_trip"])
                at += len(sizes)
        pa.default_memory_pool().release_unused()

    return run


def encode_merges(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """docs plus n_tokens, ids (those of the library) and round_trip (decoding gives the text again)."""
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids", "round_trip")]
    # a row travels as one struct, so its columns may have any names
    rows = docs.select(F.struct(*kept).alias("row"), F.col("text").alias("text"))
    kind = dict(rows.dtypes)["row"]
    is_long = F.coalesce(F.char_length("text"), F.lit(0)) > chunk
    short = rows.where(~is_long).mapInArrow(_whole(model), f"row {kind}, {_DONE}")
    both = short.unionByName(_in_chunks(rows.where(is_long), kind, model, chunk))
    return both.select("row.*", "n_tokens", "ids", "round_trip")


def _in_chunks(rows: DataFrame, kind: str, model: str, chunk: int) -> DataFrame:
    """Documents of several chunks, by boundary states. Parts carry what a piece can reach on either side."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = 2 * merge_encoder(model).model.longest
        for batch in batches:
            for number, text in zip(batch.column("number").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = SPACE + text.replace(" ", SPACE)
                for no, at in enumerate(range(0, len(text), chunk)):
                    begin, end = max(0, at - reach), min(len(text), at + chunk + reach)
                    right = min(at + chunk, len(text))
                    # cut texts are told from the ends of the document by a margin of their own
                    yield pa.record_batch([pa.array([number]), pa.array([no]), pa.array([at - begin]), pa.array([right - begin]), pa.array([text[begin:end]])], ["number", "no", "left", "right", "part"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = merge_encoder(model).model
        for batch in batches:
            found = [known.transfer(p, a, b) for p, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "left", "right")), strict=True)]
            yield pa.record_batch([batch.column("number"), batch.column("no"), pa.array([len(t) for t in found], pa.int64()), pa.array([t.ravel() for t in found], pa.list_(pa.int64()))], ["number", "no", "height", "t"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = merge_encoder(model)
        for batch in batches:
            ids = []
            for part, left, right, enter, leave in zip(*(batch.column(c).to_pylist() for c in ("part", "left", "right", "enter", "leave")), strict=True):
                came, goes = known.model.states(part, left)[enter], known.model.states(part, right)[leave]
                ids.append(known.trace(part, came[1], known.model.piece_at(part, came), goes[1]).astype(np.int32))
            yield pa.record_batch([batch.column("number"), batch.column("no"), pa.array(ids, pa.list_(pa.int32()))], ["number", "no", "ids"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = merge_encoder(model).model
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("ids")
            same = [known.decode(np.asarray(i.values, np.int64)) == t for i, t in zip(ids, texts, strict=True)]
            yield pa.record_batch([batch.column("row"), pc.list_value_length(ids).cast(pa.int64()), ids, pa.array(same)], ["row", "n_tokens", "ids", "round_trip"])

    # the numbers are written before they are used, so a lost task cannot change them
    numbered = stored(rows.withColumn("number", F.monotonically_increasing_id()))
    parts = stored(numbered.select("number", "text").mapInArrow(cut, "number bigint, no bigint, left bigint, right bigint, part string").repartition("number", "no"))
    moves = stored(parts.mapInArrow(matrices, "number bigint, no bigint, height bigint, t array<bigint>"))
    states = small_side(stored(boundary_states(moves, BLOCK)))
    pieces = parts.join(states, ["number", "no"]).select("number", "no", "part", "left", "right", "enter", "leave").mapInArrow(spans, "number bigint, no bigint, ids array<int>")
    joined = pieces.groupBy("number").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    return numbered.join(joined, "number").select("row", "text", "ids").mapInArrow(compare, f"row {kind}, {_DONE}")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def boundary_states(moves: DataFrame, block: int = BLOCK) -> DataFrame:
    """(number, no, enter, leave): the states of every chunk on the best path of its document.

    Blocks of chunks are multiplied by many tasks; a document's block products give the vectors at
    block ends; each block then finds the states inside it.
    """
    import pandas as pd

    by = moves.withColumn("block", F.floor(F.col("no") / block))

    def matrix(t, height: int) -> np.ndarray:
        return np.asarray(t, np.int64).reshape(height, -1)

    def all_of(part: pd.DataFrame) -> list[np.ndarray]:
        return [matrix(t, h) for t, h in zip(part["t"], part["height"], strict=True)]

    def product(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("no")
        total = reduce(times, all_of(part))
        return pd.DataFrame({"number": [part["number"].iloc[0]], "block": [part["block"].iloc[0]], "height": [len(total)], "t": [total.ravel()]})

    def chained(mats: list[np.ndarray], start: int, end: int) -> list[int]:
        """States before, between and after the matrices on the best path from start to end."""
        tail = [np.where(np.arange(mats[-1].shape[1]) == end, 0, NONE)]
        for m in reversed(mats):
            tail.append(np.maximum((m + tail[-1][None, :]).max(axis=1), NONE))
        tail.reverse()
        states = [start]
        for m, rest in zip(mats, tail[1:], strict=True):
            states.append(int(np.argmax(m[states[-1]] + rest)))
        return states

    def ends(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        states = chained(all_of(part), 0, 0)
        return pd.DataFrame({"number": part["number"], "block": part["block"], "first": states[:-1], "last": states[1:]})

    def inner(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("no")
        states = chained(all_of(part), int(part["first"].iloc[0]), int(part["last"].iloc[0]))
        return pd.DataFrame({"number": part["number"], "no": part["no"], "enter": states[:-1], "leave": states[1:]})

    products = by.groupBy("number", "block").applyInPandas(product, "number bigint, block bigint, height bigint, t array<bigint>")
    borders = stored(products.groupBy("number").applyInPandas(ends, "number bigint, block bigint, first bigint, last bigint"))
    return by.join(small_side(borders), ["number", "block"]).groupBy("number", "block").applyInPandas(inner, "number bigint, no bigint, enter bigint, leave bigint")
