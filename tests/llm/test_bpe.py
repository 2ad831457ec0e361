import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from granary.llm.bpe import Codec, decode_column, encode_digests

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def lib():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(5)
    bits = ["the ", "don't ", "we'll", "  ", "\n\n", "日本語", "été", "123", "!!", "'", "'l", "l", "a" * 300, "\t", "é", "🙂", "  "]
    out = ["", "x", " ", "a" * 3000, " " * 2500, "ab " * 2000, "'ll" * 900]
    return out + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 700))) for _ in range(60)]


def test_codec_matches_library(lib):
    c = Codec(PATH, P.PATTERN)
    for t in texts():
        ids = c.encode(t)
        assert ids == lib.encode_ordinary(t)
        assert c.decode(ids) == t.encode()


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (200, 16), (32768, 512)])
def test_whole_table(spark, lib, chunk, overlap):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(900, None, "x"), (3, "a" * 3000, "y"), (3, "a" * 3000, "y"), (None, "ab " * 500, "z")]
    got = encode_digests(spark.createDataFrame(rows, "doc_id long, text string, key string"), PATH, P.PATTERN, chunk=chunk, overlap=overlap).collect()
    want = []
    for i, t, _ in rows:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table_and_decoding(spark, lib):
    assert encode_digests(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
    import numpy as np

    ids = np.asarray(lib.encode_ordinary("né ok"), np.int32).tobytes()
    got = decode_column(spark.createDataFrame([(1, bytearray(ids)), (2, None)], "doc_id long, ids binary"), PATH, P.PATTERN, "doc_id", "ids").collect()
    assert {r.doc_id: bytes(r.data) for r in got} == {1: "né ok".encode(), 2: b""}


def test_memo_and_merges_of_odd_strings(lib, monkeypatch):
    monkeypatch.setattr("granary.llm.bpe.REMEMBERED", 50)
    c, rnd = Codec(PATH, P.PATTERN), random.Random(1)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "Straße", "don't", "'s", "12", "!", "..", "é", "日本", "🙂", "x" * 300, "the", "\ud800"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
        whole = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        assert c.encode(text) == lib.encode_ordinary(whole)
        data = whole.encode()[:256]
        if data not in c.ranks:
            assert c.merge(data) == c._merge_long(data)
