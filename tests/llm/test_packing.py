from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from surveyframe.llm import chunks, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "don't", "é", "　", "\xa0", ".", "!", "1", "<|endoftext|>", "中", "😀", "\x1c", "\x85", "_", "​", "▁"]


@lru_cache
def library(special=True):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = not special
    return found


def odd_texts(n=4000, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(26))) for _ in range(n)] + ["", " ", "  ", "x " * 50, " x", "a" * 300, " " * 300]


@pytest.mark.parametrize("special", [True, False])
def test_ids_are_the_librarys(special):
    texts = odd_texts()
    tokenizer = chunks.ByteLevelTokenizer(PATH, special)
    ids, sizes = tokenizer.encode(pa.array([*texts, None]))
    ends = np.cumsum(sizes)
    wanted = [e.ids for e in library(special).encode_batch([*texts, ""], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends - sizes, ends, strict=True)] == wanted
    assert [b"".join(tokenizer.bytes_of[i] for i in w) for w in wanted] == [t.encode() for t in [*texts, ""]]


def test_other_files_go_to_the_library(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["ignore_merges"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    texts = ["some words here, and more", "a  b", ""]
    ids, sizes = chunks.ByteLevelTokenizer(str(tmp_path / "t.json"), False).encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in library().encode(t, add_special_tokens=False).ids] and len(sizes) == 3


def padding(n, size):
    return 0 if n & (n - 1) == 0 else size - n


def cheapest(points, prices, size):
    cost = [0] + [10**9] * (len(points) - 1)
    for j in range(1, len(points)):
        cost[j] = min(cost[i] + padding(points[j] - points[i], size) for i in range(j) if points[j] - points[i] <= size) + prices[j] + 1
    return cost[-1]


def test_cuts_are_the_cheapest():
    rnd = random.Random(7)
    for _ in range(600):
        size, n = rnd.choice([1, 4, 7, 16, 32]), rnd.randrange(60)
        points = np.cumsum([0] + [rnd.randint(1, size) for _ in range(n)])
        prices = np.array([0] + [rnd.choice([0, 2, 5]) for _ in range(n)])
        chosen, cost = packing.least_cost_cuts(points, prices, size)
        lengths = np.diff(points[chosen])
        assert cost == cheapest(points.tolist(), prices.tolist(), size) and (lengths <= size).all()
        assert cost == sum(padding(int(x), size) + 1 for x in lengths) + prices[chosen[1:]].sum()


def check(pieces, docs, size=2048):
    """Every id of every document lies in one piece; sequences are gapless and not too long. Gives the padding's share."""
    wanted = {d: (*library().encode(t or "", add_special_tokens=False).ids, 1) for d, t in docs}
    held = {d: {} for d in wanted}
    sequences = {}
    for p in pieces:
        part = wanted[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and p.doc_tokens == len(wanted[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        held[p.doc_id][p.start] = p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.doc_id, p.start))
    for d, pieces_of in held.items():
        assert sum(pieces_of.values()) == len(wanted[d]) and all(s == 0 or s in {a + n for a, n in pieces_of.items()} for s in pieces_of)
    for s in sequences.values():
        s.sort()
        assert [o for o, *_ in s] == [sum(n for _, n, *_ in s[:i]) for i in range(len(s))] and sum(n for _, n, *_ in s) <= size
    lengths = [sum(n for _, n, *_ in s) for s in sequences.values()]
    return sum(padding(n, size) for n in lengths) / sum(lengths)


def test_tables(spark):
    rnd = random.Random(2)
    sentence = lambda: " ".join(rnd.choice(["some", "words", "of", "prose"]) for _ in range(rnd.randint(3, 30))) + "."
    docs = [(i, " ".join(sentence() for _ in range(rnd.randint(0, 40)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "x" * 30_000), (203, "word " * 20_000), (204, "one.\nline\n" * 3000), (205, docs[3][1]), (206, "é　 \n " * 50)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, start string, ids long").coalesce(2)
    for block in (1 << 20, 3000):  # one block, and many with documents across them
        pieces = packing.pack_documents(df, lambda: packing.sentence_tokenizer(PATH, 1), block=block)
        rows = pieces.collect()
        assert check(rows, docs) < 0.02
        wanted = {d: [*library().encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
        assert all(p.ids == wanted[p.doc_id][p.start : p.start + p.length] for p in rows)
    whole = packing.sequences(pieces).collect()
    assert sum(r.n_tokens for r in whole) == sum(map(len, wanted.values()))
    assert all(len(r.ids) == (2048 if padding(r.n_tokens, 2048) else r.n_tokens) and r.begins[0] == 0 for r in whole)


def test_repeated_rows_and_none(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c"), (7, "a b c")], schema).coalesce(1)
    rows = packing.pack_documents(df, lambda: packing.sentence_tokenizer(PATH, 1), with_ids=False).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in rows] == [(d, 0, 4, 4, at) for d, at in ((None, 0), (None, 4), (7, 8), (7, 12))]
    empty = packing.pack_documents(spark.createDataFrame([], schema), lambda: packing.sentence_tokenizer(PATH, 1))
    assert empty.count() == 0 and packing.sequences(empty).count() == 0


def test_query(spark):
    from surveyframe.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert check(queries.op12_packing(spark, folder).collect(), docs) < 0.02
