import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cueloom.llm import alignment
from cueloom.llm.queries import tokenizer_path

pytestmark = pytest.mark.usefixtures("spark")
A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


def byte_of():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(rows):
    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    spelled, counts, docs = byte_of(), Counter(), []
    for doc, text in rows:
        want = (" " + (text or "")).encode()
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_bytes = [bytes(spelled[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_tok.id_to_piece(i)) for i in b)]
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            docs.append((doc, [], [], [], 0))
            continue
        span = lambda words: [(sum(map(len, words[:i])), sum(map(len, words[: i + 1]))) for i in range(len(words))]
        sa, sb = span(a_bytes), span(b_bytes)
        links = [(i, j) for i, (s, e) in zip(a, sa, strict=True) for j, (t, f) in zip(b, sb, strict=True) if s < f and t < e]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            part = lambda ids, spans: ",".join(str(i) for i, (_, e) in zip(ids, spans, strict=True) if lo < e <= hi)  # noqa: B023, E731
            groups.append(f"{part(a, sa)}|{part(b, sb)}")
        counts.update(links)
        docs.append((doc, a, b, links, groups))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for doc, a, b, links, groups in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups) if a else 0, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=repr)


def result(spark, rows, **sizes):
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, n_links int")
    return sorted((tuple(r) for r in alignment.align_tokenizers(df, A, B, **sizes).collect()), key=repr)


ODD = [(1, None), (2, ""), (None, "no name here"), (3, "a ▁ b"), (4, "<|endoftext|> and </s> <s>"), (5, "Zürich 🎉🎉 naïve\tété\r\n  two  spaces "), (6, " lead"), (7, "x" * 300), (8, "\n\n\nlines\n here"),
       (9, "word"), (9, "word"), (10, "\x00 control \x07"), (11, "日本語のテキスト"), (12, "​ zero ﻿ width"), (13, " "), (14, "<0x41> <unk>")]


def words(seed, n):
    rng = random.Random(seed)
    base = ["the", "tokenization", "of", "Übergröße", "antidisestablishment", "x1y2", "--", "…", "hello", "WORLDS", "naïveté", "12345"]
    return " ".join(rng.choice(base) + rng.choice(["", "", ",", ".\n", "  "]) for _ in range(n))


def test_equal_to_brute_force(spark):
    rows = ODD + [(100 + k, words(k, 40)) for k in range(30)]
    assert result(spark, rows) == brute(rows)


def test_parts_and_blocks_give_the_same(spark):
    rows = [(k, words(k, 60)) for k in range(12)] + [(50, "y" * 500), (51, "ok ▁ not " * 30)] + ODD
    want = brute(rows)
    for run, block in ((64, 400), (7, 1 << 20)):
        assert result(spark, rows, run=run, block_size=block) == want


def test_empty_table(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_gallop_gives_lower_bounds():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (1, 900), (7, 8), (100, 5_000), (3_000, 3_100)):
        longer = np.unique(rng.integers(1, 20 * m, m))
        driver = np.unique(np.append(rng.integers(1, longer[-1] + 1, n), longer[-1]))
        assert np.array_equal(alignment.gallop(longer, driver), np.searchsorted(longer, driver))
