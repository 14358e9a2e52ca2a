"""Language identification in two steps: the family first, then the languages inside it.

Features are hashed letter n-grams (1 to 3) of the whole text as relative frequencies. One linear
support vector machine separates each pair of families and each pair of languages of one family;
they are fitted by dual coordinate descent on a bounded sample, whose features tasks compute, and
applied to every text inside tasks.

Defined results: null texts and texts without a letter are `und` with score 0; null labels are never
learned; equal votes of machines go to the label first in the alphabet; with no labelled row everything is `und`, with one language everything with letters is that
language with score 1; repeated rows are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import small_side, stored, unused

DIMENSIONS = 2_048
#: Bound of the training sample: expected labelled rows of each language.
SAMPLE_PER_LANGUAGE = 800
EPOCHS = 20
#: Columns that a prediction adds.
PREDICTED = ("lang_pred", "score", "family_pred")
#: Weight of a training row's hinge loss against the size of the weights.
COST = 1.0
#: Characters a task turns into features at once; longer texts are taken in pieces and summed.
PIECE = 1 << 18

#: Families by ISO 639-1 code (fixed values); a language outside is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to its lower-case letter, or 0 for anything that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def _codes(points: np.ndarray) -> list[np.ndarray]:
    """Per order, hashed grams that end at each position but the first two; -1 for grams without letters enough."""
    c2, c1, c0 = points[:-2], points[1:-1], points[2:]
    one = (c0 * np.uint32(0x9E3779B1)) >> np.uint32(21)
    two = ((c0 * np.uint32(0x85EBCA77)) ^ (c1 * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(21)
    three = (((c0 * np.uint32(0x165667B1)) ^ (c1 * np.uint32(0xD3A2646D))) * np.uint32(0xFD7046C5) ^ (c2 * np.uint32(0xB55A4F09))) * np.uint32(0x9E3779B1) >> np.uint32(21)
    full = [c0 > 0, (c0 > 0) | (c1 > 0), (c0 > 0).astype(np.int8) + (c1 > 0) + (c2 > 0) > 1]
    return [np.where(ok, code, -1) for code, ok in zip((one.astype(np.int64), two.astype(np.int64), three.astype(np.int64)), full, strict=True)]


def frequencies(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Relative n-gram frequencies per text (scaled to about unit size) and its number of letters."""
    counts = np.zeros((len(texts), DIMENSIONS), np.float64)
    letters = np.zeros(len(texts), np.int64)
    pieces: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal pieces, held
        if not pieces:
            return
        points = np.concatenate([p for _, p in pieces])
        owner = np.repeat(np.arange(len(pieces)), [len(p) for _, p in pieces])
        first = np.concatenate([[True, True], (owner[2:] != owner[:-2])])[2:]  # positions that are only context
        first_owner = owner[2:]
        total = np.zeros(len(pieces) * DIMENSIONS)
        for code in _codes(points):
            ok = (code >= 0) & ~first
            total += np.bincount(first_owner[ok] * DIMENSIONS + code[ok], minlength=len(total))
        seen = np.bincount(first_owner[(points[2:] > 0) & ~first], minlength=len(pieces))
        for k, (i, _) in enumerate(pieces):
            counts[i] += total[k * DIMENSIONS : (k + 1) * DIMENSIONS]
            letters[i] += seen[k]
        pieces, held = [], 0

    table = _letters()
    for i, text in enumerate(texts):
        points = table[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
        for at in range(0, len(points), PIECE):
            context = points[max(at - 2, 0) : at]
            part = np.concatenate([np.zeros(2 - len(context), np.uint32), context, points[at : at + PIECE]])
            pieces.append((i, part))
            held += len(part)
            if held >= PIECE or len(pieces) >= 64:
                flush()
    flush()
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) * 100, letters


def held_out() -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(lang, features): labelled rows outside the held-out part, drawn by hash within the bound."""
    open_rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    counts = open_rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = small_side(stored(counts.select("lang", (F.least(F.lit(1.0), per_language / F.col("_n")) * (1 << 30)).cast("long").alias("_limit"))))
    open_rows = open_rows.select("doc_id", "text", "lang").join(share, "lang")
    limit = F.col("_limit")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                x, letters = frequencies(part.column("text").to_pylist())
                keep = letters > 0
                raw = [row.astype(np.float32).tobytes() for row in x[keep]]
                yield pa.record_batch([part.column("lang").filter(pa.array(keep)), pa.array(raw, pa.binary())], ["lang", "features"])

    return open_rows.where(draw < limit).select("lang", "text").mapInArrow(features, "lang string, features binary")


def support_vectors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine for labels of -1 and 1: dual coordinate descent on the hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    square, alpha, weights = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)).tolist():
            new = min(max(alpha[i] - (y[i] * (x[i] @ weights) - 1) / square[i], 0.0), COST)
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weights


def _machines(x: np.ndarray, labels: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
    """A linear machine for each pair of labels: positive margins speak for the first."""
    out = {}
    for a, b in combinations(sorted(set(labels.tolist())), 2):
        rows = (labels == a) | (labels == b)
        out[a, b] = support_vectors(x[rows], np.where(labels[rows] == a, 1.0, -1.0))
    return out


class Hierarchy:
    """Families, their languages and the machines between them."""

    def __init__(self, languages: list[str], machines: dict[str, dict[tuple[str, str], np.ndarray]]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(languages):
            self.families.setdefault(family_of(lang), []).append(lang)
        self.machines = machines

    def _choose(self, x: np.ndarray, group: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per row, the name with most pairwise wins (then the larger margins) and the confidence of its weakest win."""
        if len(names) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = np.zeros((len(x), len(names), len(names)))
        for (a, b), weights in self.machines[group].items():
            i, j = names.index(a), names.index(b)
            margin[:, i, j] = x @ weights[:-1] + weights[-1]
            margin[:, j, i] = -margin[:, i, j]
        score = (margin > 0).sum(axis=2) + np.tanh(margin.sum(axis=2)) * 0.49
        best = score.argmax(axis=1)
        own = margin[np.arange(len(x)), best]
        own[np.arange(len(x)), best] = np.inf
        return best, 1 / (1 + np.exp(-2 * np.clip(own.min(axis=1), -30, 30)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[str | None]]:
        x, letters = frequencies(texts)
        names = sorted(self.families)
        langs, scores, families = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
        if not names:
            return langs, scores, families
        family, sure = self._choose(x, "family", names)
        for k, name in enumerate(names):
            rows = np.flatnonzero((family == k) & (letters > 0))
            best, inner = self._choose(x[rows], name, self.families[name])
            for row, b, s in zip(rows.tolist(), best.tolist(), inner.tolist(), strict=True):
                langs[row], scores[row], families[row] = self.families[name][b], round(sure[row] * s, 6), name
        return langs, scores, families


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Hierarchy:
    # the bounded sample: per_language rows of 8 KB for each language
    rows = sorted((r["lang"], bytes(r["features"])) for r in training_sample(docs, per_language).collect())
    labels = np.array([lang for lang, _ in rows], dtype=object)
    x = np.array([np.frombuffer(raw, np.float32) for _, raw in rows]).reshape(len(rows), DIMENSIONS)
    languages = sorted(set(labels.tolist()))
    families = np.array([family_of(lang) for lang in labels], dtype=object)
    machines = {"family": _machines(x, families)}
    for name in sorted(set(families.tolist())):
        machines[name] = _machines(x[families == name], labels[families == name])
    return Hierarchy(languages, machines)


def predict(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """docs plus lang_pred, score and family_pred."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few weights per pair of languages
    kept = [c for c in docs.columns if c not in PREDICTED]
    kinds = dict(docs.dtypes)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                langs, scores, families = shared.value.predict(part.column("text").to_pylist())
                yield pa.record_batch([*(part.column(c) for c in kept), pa.array(langs), pa.array(scores), pa.array(families, pa.string())], [*kept, "lang_pred", "score", "family_pred"])
        pa.default_memory_pool().release_unused()

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", lang_pred string, score double, family_pred string"
    return docs.select(*kept).mapInArrow(label, schema)


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, family_pred."""
    labelled = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang"), per_language))
    return labelled.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "family_pred")


#: Least score of a document that the language stage of a pipeline keeps.
MIN_SCORE = 0.3


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with a recognised language, all columns kept."""
    names = {c: unused(docs, f"_{c}")[0] for c in PREDICTED if c in docs.columns}
    labelled = predict(docs.withColumnsRenamed(names), fit(docs.select("doc_id", "text", "lang")))
    good = labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return good.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
