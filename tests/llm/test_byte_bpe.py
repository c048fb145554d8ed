import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from twinraster.llm import byte_bpe
from twinraster.llm.byte_bpe_query import round_trip

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello, world! it's we'll I'M", "naïve Ünïcode 日本語 テスト 🙂🙂", "a" * 3000, " " * 700 + "x" + " " * 5,
    "<|endoftext|> is text", "1234567890 12 ½ ²", "x\x85y z　w", "Ab" * 400 + " 'll've'", "a\x00b\x1c\x1d c",
    "the the the quick brown fox " * 50, "\r\n\r\n \n", "don't can't\n\n\nwon't  ", "́combining é",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.load_ranks(PATH))


def test_perfect_hash_is_minimal_and_perfect(vocabulary):
    n = len(vocabulary.tokens)
    assert sorted(vocabulary.whole.owner.tolist()) == list(range(n))
    assert vocabulary.whole.probe(vocabulary.tokens).tolist() == list(range(n))
    assert (vocabulary.whole.probe([b"qzxqzxqzx", b"\xff\xfe\xfd"]) == -1).all()


@pytest.mark.parametrize("window", [8, 64, 1 << 18])
def test_ids_equal_the_library(vocabulary, reference, monkeypatch, window):
    monkeypatch.setattr(byte_bpe, "WINDOW", window)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    encoder = byte_bpe.Encoder(vocabulary, P.PATTERN)
    for text in TEXTS[1:]:
        assert encoder.ids(text).tolist() == reference.encode_ordinary(text), text[:40]


def test_all_code_points(vocabulary, reference):
    encoder = byte_bpe.Encoder(vocabulary, P.PATTERN)
    for start in range(0, 0x3200, 64):
        text = "".join(f"{chr(c)} a{chr(c)}" for c in range(start, start + 64))
        assert encoder.ids(text).tolist() == reference.encode_ordinary(text), hex(start)


def test_round_trip_query(spark, reference):
    rows = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, ids string, decoded string")
    found = round_trip(rows).collect()
    assert len(found) == 2 * len(TEXTS)
    for r in found:
        text = TEXTS[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "k int, ids array<int>")
    found = {r.k: bytes(r.decoded) for r in byte_bpe.decode(rows, PATH).collect()}
    tokens = byte_bpe.load_ranks(PATH)
    assert found == {1: b"", 2: b"", 3: tokens[0] + tokens[1]}
