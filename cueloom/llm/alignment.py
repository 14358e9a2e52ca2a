"""Cross-tokenizer alignment by galloping intersection of token end offsets.

A text is encoded by a byte-level BPE (A) and a SentencePiece model (B) over the same bytes, a space and the text.
The shorter list of token ends drives: each of its ends gallops (steps of 1, 2, 4, ...) from the rank of an earlier
end into the longer list and is then placed by binary search. All ends of a run of texts move together: first
every 2^k-th end, then those between, each from the one on its left. Ends that both lists have cut the tokens into
groups, and the ranks of two neighbouring ends give the range of tokens that the token between them overlaps.

Corpus-wide counts of linked id pairs need a second look at the links, which are too many to move. Tasks gather
documents into blocks; a block keeps its links as numbers of its own distinct pairs, and only distinct pairs with
their number per block are summed, compared with the best pair of their B id and sent back to the block.

Long texts are cut before a space between two non-spaces, where both encodings start a token of their own; the
results of the parts are joined, so they are those of the whole text.

Defined results: null and empty texts, and texts whose joined A or B bytes are not the space and the text, have no
tokens: zeros and an empty string; repeated rows count each; equal counts are all a B id's highest; strings of
added tokens are plain text; an empty table gives no rows. Extra columns do not matter: only doc_id and text are
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import small_side, stored
from cueloom.llm.encoding import _BYTES, UnitEncoder, _ragged
from cueloom.llm.spm import SPACE, merge_encoder

#: Code points that are aligned at once, and that a block of documents holds.
RUN = 1 << 19
BLOCK = 1 << 23
#: Bits of a B id in the number of a pair.
B_BITS = 20

_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class PlainEncoder(UnitEncoder):
    """Ids of the byte-level BPE with the strings of added tokens as plain text."""

    share = 0.5

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.added, self.cut = {}, re.compile("(?!)")
        spelled = {chr(c): b for b, c in _BYTES.items()}
        words = sorted(vocabulary, key=vocabulary.get)
        self.raw = Raw([bytes(spelled[c] for c in w) if all(c in spelled for c in w) else b"" for w in words])


class Raw:
    """The bytes of tokens by id."""

    def __init__(self, words: list[bytes]):
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(words), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_ragged(self.starts[ids], self.sizes[ids])]


def gallop(longer: np.ndarray, driver: np.ndarray) -> np.ndarray:
    """For each driver end the number of ends of the longer list below it. Both rise and have the same last end."""
    last = len(longer) - 1
    rank = np.zeros(len(driver), np.int64)
    stride = 1 << max(0, len(driver) - 1).bit_length()
    while stride:
        at = np.arange(stride - 1, len(driver), 2 * stride)
        end = driver[at]
        below = np.where(at >= stride, rank[at - stride], 0)  # the rank of the end `stride` to the left
        above = below.copy()
        live, step = np.flatnonzero(longer[below] < end), 1
        start = below.copy()
        while len(live):
            probe = np.minimum(start[live] + step, last)
            short = longer[probe] < end[live]
            above[live] = probe
            below[live[short]] = probe[short]
            live, step = live[short], 2 * step
        live = np.flatnonzero(above - below > 1)
        while len(live):
            middle = (below[live] + above[live]) >> 1
            short = longer[middle] < end[live]
            below[live[short]] = middle[short]
            above[live[~short]] = middle[~short]
            live = live[above[live] - below[live] > 1]
        rank[at] = above
        stride >>= 1
    return rank


class Aligned:
    """Groups and links of two lists of token ends over the same bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        swapped = len(b) < len(a)
        driver, longer = (b, a) if swapped else (a, b)
        rank = gallop(longer, driver)
        common = longer[rank] == driver
        first = np.zeros(len(driver), np.int64)
        first[1:] = rank[:-1] + common[:-1]
        own = np.repeat(np.arange(len(driver)), rank - first + 1)
        other = _ragged(first, rank - first + 1)
        self.a, self.b = (other, own) if swapped else (own, other)
        # the number of groups that end before a token
        mark = np.zeros(len(longer), bool)
        mark[rank[common]] = True
        groups = [np.cumsum(m) - m for m in (common, mark)]
        self.group_a, self.group_b = groups[::-1] if swapped else groups
        self.ends_a = mark if swapped else common  # whether a token is the last A token of its group


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids with each of the signs , | ; after them as eight bytes, and their lengths."""
    texts = [b"%d" % i for i in range(size)]
    table = np.stack([np.frombuffer(b"".join((t + s).ljust(8, b"\0") for t in texts), np.uint64) for s in (b",", b"|", b";")])
    return table, np.array([len(t) + 1 for t in texts], np.int64)


class Aligner:
    def __init__(self, byte_level: str, pieces: str):
        self.a = PlainEncoder(byte_level)
        self.b = merge_encoder(pieces)
        model = self.b.model
        byte = {int(i): n for n, i in enumerate(model.byte_ids)}
        known = set(model.ids.values())
        self.raw_b = Raw([bytes([byte[i]]) if i in byte else p.replace(SPACE, " ").encode() if i in known else b"" for i, p in enumerate(model.pieces)])
        self.table, self.widths = _digits(max(len(self.a.raw.sizes), len(model.pieces)))

    @staticmethod
    def _ids(encoder: UnitEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        runs = list(encoder(texts))
        return np.concatenate([r[0] for r in runs]).astype(np.int64), np.concatenate([r[1] for r in runs])

    def __call__(self, texts: pa.Array) -> Run:
        """texts: neither null nor empty. Texts with other bytes are left out and marked."""
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        a, n_a = self._ids(self.a, spaced)
        b, n_b = self._ids(self.b, texts)
        sizes = pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
        want = np.frombuffer(b"".join(spaced.cast(pa.binary()).to_pylist()), np.uint8)
        ok = np.ones(len(texts), bool)
        for raw, ids, n in ((self.a.raw, a, n_a), (self.raw_b, b, n_b)):
            got = raw(ids)
            if len(got) != len(want) or not np.array_equal(got, want):
                ok &= self._same(raw, ids, n, want, sizes)
        if not ok.all():
            return Run(ok, self(texts.filter(pa.array(ok))) if ok.any() else None)
        run = Run(ok, None)
        ends_a, ends_b = np.cumsum(self.a.raw.sizes[a]), np.cumsum(self.raw_b.sizes[b])
        found = Aligned(ends_a, ends_b)
        text_ends = np.cumsum(sizes)
        run.n_a, run.n_b = n_a, n_b
        last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        run.n_groups = np.diff(found.group_a[last_a] + 1, prepend=0)
        run.n_links = np.bincount(np.searchsorted(text_ends, ends_a[found.a], "left"), minlength=len(texts))
        run.links = (a[found.a] << B_BITS) | b[found.b]
        run.spelled, run.spelled_ends = self._spell(a, b, found, last_a, last_b)
        return run

    @staticmethod
    def _same(raw: Raw, ids: np.ndarray, n: np.ndarray, want: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(n), bool)
        at, byte = 0, 0
        for k, (count, size) in enumerate(zip(n.tolist(), sizes.tolist(), strict=True)):
            out[k] = np.array_equal(raw(ids[at : at + count]), want[byte : byte + size])
            at, byte = at + count, byte + size
        return out

    def _spell(self, a: np.ndarray, b: np.ndarray, found: Aligned, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of all texts as bytes, each group with ; behind it, and where each text's end."""
        in_a, in_b = np.bincount(found.group_a), np.bincount(found.group_b)
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[found.group_a]
        place_b = np.arange(len(b)) + np.cumsum(in_a)[found.group_b]
        ends_b = np.diff(found.group_b, append=found.group_b[-1] + 1) > 0
        words = np.empty(len(a) + len(b), np.uint64)
        width = np.empty(len(words), np.int64)
        words[place_a] = self.table[np.where(found.ends_a, 1, 0), a]
        words[place_b] = self.table[np.where(ends_b, 2, 0), b]
        width[place_a], width[place_b] = self.widths[a], self.widths[b]
        flat = words.view(np.uint8).reshape(-1, 8)[np.arange(8) < width[:, None]]
        return flat, np.cumsum(width)[place_b[last_b]]


class Run:
    """Results of a run of texts; ok: whether a text's tokens have its bytes. Where some have not, the rest are in part."""

    def __init__(self, ok: np.ndarray, part: Run | None):
        self.ok, self.part = ok, part
        none = np.zeros(0, np.int64)
        self.n_a = self.n_b = self.n_groups = self.n_links = self.links = self.spelled_ends = none
        self.spelled = np.zeros(0, np.uint8)


@lru_cache(1)
def aligner(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


def parts_of(text: str, size: int) -> Iterator[str]:
    """Parts of a text; each but the first is without the space in front, which both encoders add."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


class Block:
    """Documents of a task until they are enough for a row."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.links: list[np.ndarray] = []
        self.held = 0

    def row(self, number: int) -> pa.RecordBatch:
        links = np.concatenate(self.links) if self.links else np.zeros(0, np.int64)
        pairs, place, counts = np.unique(links, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent pairs get small numbers
        rank = np.empty(len(pairs), np.uint32)
        rank[order] = np.arange(len(pairs), dtype=np.uint32)
        planes = np.ascontiguousarray(rank[place].view(np.uint8).reshape(-1, 4).T).tobytes()
        packed = zstandard.ZstdCompressor(level=1).compress(planes)
        columns = [[c] for c in zip(*self.docs, strict=True)]
        values = [[number], *columns, [packed], [pairs[order]], [counts[order]]]
        return pa.record_batch([pa.array(v, t) for v, t in zip(values, _BLOCK_TYPES, strict=True)], _BLOCK_NAMES)


_DOC = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}
_BLOCK_NAMES = ["block", *_DOC, "links", "pairs", "counts"]
_BLOCK_TYPES = [pa.int64(), *(pa.list_(t) for t in _DOC.values()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_BLOCK_SCHEMA = "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, links binary, pairs array<bigint>, counts array<bigint>"
_NOTHING = (0, 0, 0, 0, "")


def _documents(align: Aligner, ids: list, texts: pa.Array, size: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(document, links) of a batch, in order."""
    none = np.zeros(0, np.int64)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(ids):
        if sizes[at] > size:
            yield _long(align, ids[at], texts[at].as_py(), size)
            at += 1
            continue
        long = np.flatnonzero(sizes[at:] > size)
        total = np.cumsum(sizes[at:])
        end = at + max(1, min(int(np.searchsorted(total, size, "right")), int(long[0]) if len(long) else len(ids)))
        full = np.flatnonzero(sizes[at:end] > 0)
        run = align(texts[at:end].take(pa.array(full))) if len(full) else None
        good = full[run.ok] if run is not None else full
        whole = run.part or run if run is not None else None
        results = {}
        if len(good):
            starts = np.concatenate([[0], whole.spelled_ends[:-1]])
            cuts = np.cumsum(whole.n_links)
            spelled = whole.spelled.data
            for k, row in enumerate(good.tolist()):
                # without the sign behind the last group
                sha = hashlib.sha256(spelled[starts[k] : whole.spelled_ends[k] - 1]).hexdigest()
                results[row] = ((int(whole.n_a[k]), int(whole.n_b[k]), int(whole.n_groups[k]), int(whole.n_links[k]), sha), whole.links[cuts[k] - whole.n_links[k] : cuts[k]])
        for row in range(end - at):
            numbers, links = results.get(row, (_NOTHING, none))
            yield (ids[at + row], *numbers), links
        at = end


def _long(align: Aligner, doc: int | None, text: str, size: int) -> tuple[tuple, np.ndarray]:
    digest, links, sums = hashlib.sha256(), [], np.zeros(4, np.int64)
    held = b""
    for part in parts_of(text, size):
        run = align(pa.array([part]))
        if not run.ok.all():
            return (doc, *_NOTHING), np.zeros(0, np.int64)
        digest.update(held)
        digest.update(run.spelled[:-1].data)
        held = b";"
        sums += [run.n_a[0], run.n_b[0], run.n_groups[0], run.n_links[0]]
        links.append(run.links)
    return (doc, *sums.tolist(), digest.hexdigest()), np.concatenate(links)


def blocks(docs: DataFrame, byte_level: str, pieces: str, run: int = RUN, block_size: int = BLOCK) -> DataFrame:
    """Stored blocks of documents with their links."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align = aligner(byte_level, pieces)
        number = TaskContext.get().partitionId() << 32
        block = Block()
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            for doc, links in _documents(align, batch.column("doc_id").cast(pa.int64()).to_pylist(), texts, run):
                block.docs.append(doc)
                block.held += len(links) + 16
                if len(links):
                    block.links.append(links)
                if block.held >= block_size // 4:
                    yield block.row(number)
                    block, number = Block(), number + 1
        if block.docs:
            yield block.row(number)
        pa.default_memory_pool().release_unused()

    return stored(docs.select("doc_id", "text").mapInArrow(gather, _BLOCK_SCHEMA))


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, total, best): links of each id pair in all documents, and whether no pair of its B id has more."""
    each = held.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    totals = stored(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total")))
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b")
    most = small_side(stored(totals.groupBy(b).agg(F.max("total").alias("most"))))
    return totals.withColumn("b", b).join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            docs = [batch.column(c)[row].values for c in _DOC]
            n = docs[4].to_numpy()
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("links")[row].as_py()), np.uint8)
            place = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
            sums = [np.zeros(len(n), np.int64) for _ in range(2)]
            if len(place):
                # the sign of a total tells whether it is its B id's highest
                totals = batch.column("totals")[row].values
                signed = np.zeros(len(totals), np.int64)
                signed[totals.field("at").to_numpy()] = totals.field("total").to_numpy()
                some = n > 0
                starts = (np.cumsum(n) - n)[some]
                sums[0][some] = np.add.reduceat((signed[place] < 0).astype(np.int64), starts)
                sums[1][some] = np.add.reduceat(np.abs(signed[place]), starts)
            yield pa.record_batch([*docs[:5], *map(pa.array, sums), docs[5]], _RESULT_NAMES)


_RESULT_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str, run: int = RUN, block_size: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    held = blocks(docs, byte_level, pieces, run, block_size)
    counts = small_side(stored(pair_counts(held)))
    signed = F.when(F.col("best"), -F.col("total")).otherwise(F.col("total"))
    each = held.select("block", F.posexplode("pairs").alias("at", "pair"))
    totals = each.join(counts, "pair").select("block", F.struct("at", signed.alias("total")).alias("t")).groupBy("block").agg(F.collect_list("t").alias("totals"))
    joined = held.drop("pairs", "counts").join(totals, "block", "left")
    return joined.mapInArrow(_score, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
