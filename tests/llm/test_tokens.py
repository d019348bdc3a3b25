from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from surveyframe.llm import bpe, tokenfile

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ALPHABETS = ["abcdefghijklmnop etaoin", "aab", "aäöüßéè 日本語𝄞", "\n\t  x\x1c ", "0123 ab-=_.,!'st<|endoftext|>", "the ing tion ", "Áéİ. ²ⅷ "]


def texts(n, seed=1):
    rnd = random.Random(seed)
    return [None, "", " ", "a" * 3000, "-" * 2000, "don't, can't. <|endoftext|>x <|startoftext|>."] + ["".join(rnd.choice(a) for _ in range(rnd.choice([2, 9, 50, 200]))) for a in ALPHABETS for _ in range(n)]


# --- Byte-level BPE.


def library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_encoding_against_library(spark):
    lib, rows = library(), list(enumerate(texts(60)))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "null id", "x")], "doc_id long, text string, ids string")
    found = {r.doc_id: r.ids for r in bpe.encode_documents(df, RANKS).collect()}
    assert found == {i: lib.encode_ordinary(t or "") for i, t in rows} | {None: lib.encode_ordinary("null id")}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(bpe.encode_documents(df, RANKS), RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in rows} | {None: b"null id"}
    one, two = (d.select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256").collect() for d in (bpe.round_trip(df, RANKS), bpe.decode_documents(bpe.encode_documents(df, RANKS), RANKS)))
    assert sorted(map(str, one)) == sorted(map(str, two))
    assert "ids" not in bpe.round_trip(df, RANKS, with_ids=False).columns
    assert bpe.decode_documents(bpe.encode_documents(df.limit(0), RANKS), RANKS).count() == 0


def test_every_prefix_append_and_edit():
    rnd, v = random.Random(7), bpe.load_ranks(RANKS)
    for _ in range(150):
        data = bytes(rnd.choice(b"abcdetionthinger \xc3\xa9") for _ in range(rnd.randrange(1, 60)))
        whole = bpe.Prefixes(v, data)
        assert all(whole.tokens(i) == v.merge(data[:i]) for i in range(1, len(data) + 1))
        grown = bpe.Prefixes(v)
        for at in range(0, len(data), 7):
            grown.append(data[at : at + 7])
        assert grown.last == whole.last
        a = rnd.randrange(len(data) + 1)
        b, new = rnd.randrange(a, len(data) + 1), bytes(rnd.choice(b"abcdetion") for _ in range(rnd.randrange(6)))
        grown.edit(a, b, new)
        assert bytes(grown.data) == data[:a] + new + data[b:] and grown.last == bpe.Prefixes(v, bytes(grown.data)).last


def test_an_edit_stays_near():
    v = bpe.load_ranks(RANKS)
    data = b"some words that stand here " * 200
    p = bpe.Prefixes(v, data)
    assert p.edit(10, 14, b"word") < 4 * v.longest


def test_memo_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    lib, enc = library(), bpe.Encoder(RANKS)
    assert all(enc.encode(t or "") == lib.encode_ordinary(t or "") for t in texts(10, 2))


def test_memo_takes_no_long_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "LONGEST", 6)
    lib, enc = library(), bpe.Encoder(RANKS)
    text = "short and extraordinarily long words, " * 3 + " " * 5000 + "z" * 3000
    assert enc.encode(text) == enc.encode(text) == lib.encode_ordinary(text)
    assert max(map(len, enc._memo)) <= 6 and max(map(len, enc._kept)) <= 6


# --- Token files.


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], [0, 3, 3, 900, 901, 10**12], list(range(0, 5000, 7)), sorted(random.Random(3).choices(range(10**6), k=3000))])
def test_elias_fano(values):
    ef = tokenfile.EliasFano.build(np.array(values, dtype=np.int64))
    assert ef.all().tolist() == values and [ef.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        ef.select(len(values))
    if len(values) > 1000:
        assert ef.bytes * 8 < len(values) * (2.3 + np.log2(max(values) / len(values)))


def test_elias_fano_rejects():
    for bad in ([3, 2], [-1]):
        with pytest.raises(ValueError):
            tokenfile.EliasFano.build(np.array(bad))


def test_file_round_trip():
    buffers = [np.array(x, dtype="<u2").tobytes() for x in ([1, 2, 65535], [], [7])]
    file = tokenfile.TokenFile(tokenfile.pack([None, -5, 9], buffers, 2, 3, 4))
    assert [file.document(i).tolist() for i in range(3)] == [[1, 2, 65535], [], [7]] and (file.nulls, file.part, file.number) == (1, 3, 4) and file.doc_ids[1:].tolist() == [-5, 9]
    with pytest.raises(ValueError):
        tokenfile.TokenFile(b"x" * 100)


@pytest.mark.parametrize("file_ids", [50, 1 << 22])
def test_files_against_library(spark, tmp_path, file_ids):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD_BPE)
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts(25))]
    random.Random(1).shuffle(rows)
    rows += [(None, "no id"), (None, None), (4, "same"), (4, "same"), (5, "long " * 50_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")
    folder = str(tmp_path / "files")
    tokenfile.write_token_files(df, folder, lambda: tokenfile.word_tokenizer(WORD_BPE, 2), file_ids=file_ids)
    found = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read_documents(spark, folder).collect()))
    assert [r[1] for r in found] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    at, expected = 0, []
    for start, doc, n, crc in found:
        assert start == at
        at += n
        expected.append((doc, n, crc))
    own = []
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        own.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted(expected, key=str) == sorted(own, key=str)


def test_no_documents(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    tokenfile.write_token_files(df, str(tmp_path / "none"), lambda: tokenfile.word_tokenizer(WORD_BPE, 2))
    assert tokenfile.read_documents(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "a <|EndOfText|> b", "x <|EndOfText|>. <|STARTOFTEXT|>y", "A<|endoftext|>B", "<|endoftext|>.", "J̌", "H̱x T̈ Áb.", "\u0958.", "ÉTÉ, Straße! ABC.", "İİ KK", "ΣΑΣ. Σ", "It's, IT'S.", "a\x1cb\x85c\xa0d", " ", ""])
def test_words_keep_their_ids(text):
    from tokenizers import Tokenizer

    enc, lib = tokenfile.WordTokenizer(WORD_BPE, None), Tokenizer.from_file(WORD_BPE)
    found = enc.encode_buffers(pa.array([None, text, text]))
    ids = enc._bytes(lib.encode(text, add_special_tokens=False).ids)
    assert found == [b"", ids, ids]


def test_random_texts_against_the_library(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "MEMO", 3000)
    rnd = random.Random(5)
    alphabet = [*"aAbZ19 .,;:!?)('-<|>\n\t", "<|endoftext|>", "<|EndOfText|>", "|>", "\u0301", "\u030c", "\u0331", "\u0958", "\u093c", "ß", "İ", "K", "Σ", "é", "É", "가", "\u11a8", "\x85", "\u2028", "日", "😀", "'s", "'LL"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(12))) for _ in range(30_000)]
    enc, lib = tokenfile.WordTokenizer(WORD_BPE, 2), Tokenizer.from_file(WORD_BPE)
    found = [x for at in range(0, len(texts), 5000) for x in enc.encode_buffers(pa.array(texts[at : at + 5000]))]
    assert found == [enc._bytes([*e.ids, 2]) for e in lib.encode_batch(texts, add_special_tokens=False)]
