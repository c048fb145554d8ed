import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from twinraster.llm import token_align
from twinraster.llm.stream_bpe import MergeList, byte_letters
from twinraster.llm.token_align_query import aligned_counts

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", "Hello, world! it's we'll I'M", "naïve Ünïcode 日本語 テスト 🙂🙂", "a" * 3000, " " * 300 + "x" + " " * 5, "<|endoftext|> is <s> text </s> <0x41> <unk>",
    "has the mark ▁ in it", "▁", "1234567890 12 ½ ²", "x\x85y z　w", "a\x00b\x1c\x1d c", "the the the quick brown fox " * 50, "\r\n\r\n \n", "tab\t tab \t\n x",
    "don't can't\n\n\nwon't  ", "́combining é ﬁ ﬂ Ⅷ", "der die das und die ", "the cat sat on the mat", "the cat sat on the mat", " leading  and   double ",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def _tokens(libraries, text):
    """Ids and bytes of both sides by definition, or nothing."""
    a, b = libraries
    if not text:
        return None
    letters = byte_letters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    want = (" " + text).encode()
    return None if b"".join(bytes_a) != want or b"".join(bytes_b) != want else (ids_a, bytes_a, ids_b, bytes_b)


def brute_force(libraries, texts):
    """One tuple per text, from the definitions: tokens are compared pair by pair."""
    parts, corpus = [], Counter()
    for text in texts:
        found = _tokens(libraries, text)
        if found is None:
            parts.append(None)
            continue
        ids_a, bytes_a, ids_b, bytes_b = found
        ends_a, ends_b = list(accumulate(map(len, bytes_a))), list(accumulate(map(len, bytes_b)))
        shared = sorted(set(ends_a) & set(ends_b))
        groups = []
        for low, high in zip([0, *shared], shared):
            groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a) if low < e <= high) + "|" + ",".join(str(i) for i, e in zip(ids_b, ends_b) if low < e <= high))
        links = [(i, j) for i, e, t in zip(ids_a, ends_a, bytes_a) for j, f, u in zip(ids_b, ends_b, bytes_b) if e - len(t) < f and f - len(u) < e]
        corpus.update(links)
        parts.append((len(ids_a), len(ids_b), groups, links))
    most = {}
    for (_, j), n in corpus.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for part in parts:
        if part is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = part
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((n_a, n_b, len(groups), len(links), sum(corpus[k] == most[k[1]] for k in links), sum(corpus[k] for k in links), digest))
    return out


def _query(spark, texts, partitions=3):
    rows = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, block string, n_a string").repartition(partitions)
    found = aligned_counts(rows).collect()
    assert len(found) == len(texts)
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in sorted(found, key=lambda r: r.doc_id)]


def test_query_equals_brute_force(spark, libraries, monkeypatch):
    assert _query(spark, TEXTS) == brute_force(libraries, TEXTS)


def test_random_texts_equal_brute_force(spark, libraries):
    rng = random.Random(3)
    pieces = [" ", "  ", "\n", "\t", "a", "the", " the", "'s", "re", "12", "é", "日", "🙂", "!", "...", " ", "<s>", "Zz", "__", "ss" * 9, "-" * 30, "▁", "chsch", "ung"]
    weights = [9] * 21 + [0.1] + [9] * 2
    texts = ["".join(rng.choices(pieces, weights, k=rng.randint(0, 40))) for _ in range(150)]
    assert _query(spark, texts) == brute_force(libraries, texts)


def test_blocks_do_not_change_the_result(spark, libraries):
    """Slices of one document, of a few characters, and of the whole table hold the same tokens and groups."""
    with open(B, "rb") as file:
        sides = token_align.Sides(MergeList(A), file.read())
    texts = [t or "" for t in TEXTS]
    whole = sides.align(texts)
    for k, text in enumerate(texts):
        one = sides.align([text])
        assert [one[c][0] for c in ("n_a", "n_b", "n_groups", "n_links")] == [whole[c][k] for c in ("n_a", "n_b", "n_groups", "n_links")]
        assert one["groups"][0].as_py() == whole["groups"][k].as_py()
    empty = sides.align(["", ""])
    assert empty["n_links"].tolist() == [0, 0] and empty["groups"].to_pylist() == ["", ""]


@pytest.mark.parametrize("seed", range(20))
def test_cuts_by_halves_equal_the_intersection(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 400))
    density = rng.choice([0.02, 0.3, 0.9])
    a = np.union1d(rng.choice(size, int(size * density)), [size, 2 * size])
    b = np.union1d(rng.choice(size, int(size * rng.choice([0.02, 0.5, 1.0]))), [size, 2 * size])
    lo = np.array([0, np.searchsorted(a, size) + 1])
    found, found_b = token_align.shared_cuts(a, b, lo, np.append(lo[1:], len(a)))
    assert a[found].tolist() == b[found_b].tolist() == np.intersect1d(a, b).tolist()


def test_link_counts(spark, libraries):
    rows = spark.createDataFrame([(1, "the cat"), (2, "the cat"), (None, "the")], "doc_id long, text string")
    aligned = token_align.align(rows, A, B)
    found = {(r.a_id, r.b_id): (r.links, r.best) for r in token_align.link_counts(aligned).collect()}
    a, b = libraries
    the, cat = (a.encode(" the").ids[0], b.encode("the")[0]), (a.encode(" cat").ids[0], b.encode("cat")[0])
    assert found == {the: (3, True), cat: (2, True)}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(7, "a b")] * 3 + [(None, "a b")], "doc_id long, text string")
    found = aligned_counts(rows).collect()
    assert sorted((r.doc_id or 0) for r in found) == [0, 7, 7, 7]
    assert {(r.n_a, r.n_links, r.n_best, r.count_sum) for r in found} == {(2, 2, 2, 8)}
    assert aligned_counts(rows.limit(0)).collect() == []


def test_a_text_longer_than_a_block(spark, libraries, monkeypatch):
    text = ("the quick brown fox jumps over it, " * 9 + "日本\n") * 60
    with open(B, "rb") as file:
        sides = token_align.Sides(MergeList(A), file.read())
    found = sides.align([text])
    want = brute_force(libraries, [text[:0], text])[1]
    assert (found["n_a"][0], found["n_b"][0], found["n_groups"][0], found["n_links"][0]) == want[:4]
    assert hashlib.sha256(found["groups"][0].as_py().encode()).hexdigest() == want[6]


def test_a_block_without_tokens(spark):
    found = aligned_counts(spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string").coalesce(1)).collect()
    assert sorted(tuple(r) for r in found) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]
