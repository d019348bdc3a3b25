from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from surveyframe.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
tool = lambda: alignment.aligner(A, B)


def brute(texts):
    """The contract's columns of each text, pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(A)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = alignment.ByteLevelTokenizer(A, False).bytes_of
    found, counts = [], Counter()
    for text in texts:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [shown[i] for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:-1], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not (b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode()):
            found.append(None)
            continue
        spans = []
        for tokens in (a_bytes, b_bytes):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, side, strict=True) if before <= s and e <= c) for ids, side in zip((a, b), spans, strict=True)))
            before = c
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (t, f) in zip(b, spans[1], strict=True) if max(s, t) < min(e, f)]
        counts.update(links)
        found.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in found]


def rows_of(df):
    return sorted((repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(1)
    parts = ["a", "b", " ", " ", "  ", "\n", "\t", "'s", "don't", "é", "　", "\xa0", ".", "1", "<|endoftext|>", "中", "😀", "\x1c", "_", "</s>", "<0x41>", "the", "ing"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(26))) for _ in range(700)]
    return texts + ["▁", "a▁b c", " ", "  ", "a ", "", None, "the same words " * 400, "x" * 5000, "the", "the", "the"]


@pytest.mark.parametrize("pairs", [alignment.PAIRS, 0])  # counts sent to all tasks, and joined
def test_against_brute_force(spark, odd, pairs):
    docs = [(i if i % 50 else None, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, pairs long, n_a string").repartition(5)
    wanted = brute(odd)
    assert rows_of(alignment.align_documents(df, tool, pairs=pairs)) == sorted((repr(d), *w) for (d, _), w in zip(docs, wanted, strict=True))
    assert sum(w[0] == 0 for w in wanted) >= 4


def test_no_rows_and_no_tokens(spark):
    schema = "doc_id long, text string"
    assert alignment.align_documents(spark.createDataFrame([], schema), tool).count() == 0
    for pairs in (alignment.PAIRS, 0):
        df = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], schema)
        assert rows_of(alignment.align_documents(df, tool, pairs=pairs)) == [(str(i), 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_query(spark):
    from surveyframe.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    short = [d for d in docs if len(d[1] or "") < 20_000]  # brute force compares all pairs of tokens of a text
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert rows_of(alignment.align_documents(df, tool)) == sorted((repr(d), *w) for (d, _), w in zip(short, brute([t for _, t in short]), strict=True))
    found = queries.op13_token_alignment(spark, folder)
    assert found.count() == len(docs) and {c: k for c, k in found.dtypes if c != "groups_sha256"} == dict.fromkeys(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"], "bigint")
