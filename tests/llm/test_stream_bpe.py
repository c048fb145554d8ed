import hashlib
import itertools
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from twinraster.llm import stream_bpe
from twinraster.llm.stream_bpe_query import streamed
from twinraster.llm.units import UnitMemory, unit_keys

PATH = P.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = [
    None, "", " ", "  ", "\n\n  \t x", "Hello, world! it's we'll I'M", "naïve Ünïcode 日本語 テスト 🙂🙂", "a" * 9000, " " * 7000 + "x" + " " * 5,
    f"{END} is one", f"a {END}{END} b{END}", f"x {END}'s \n{END}  y", "<|endof", "<|endoftext|", "1234567890 12 ½ ²", "x\x85y z　w",
    "Ab" * 4000 + " 'll've'", "a\x00b\x1c\x1d c", "the the the quick brown fox " * 50, "\r\n\r\n \n", "don't can't\n\n\nwon't  ", "́combining é",
    "<" * 5000 + "|endoftext|>" + ">" * 5000, " \n" * 3000 + "'s", "é" * 6000 + "7" * 6000 + " ", "'" * 5000 + "ll", "a\n b \n c\t d", "x  y   z",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return stream_bpe.MergeList(PATH)


def _each(encoder, texts):
    ids, counts = encoder.encode(texts)
    stops = counts.cumsum()
    return [ids[b - n: b].tolist() for b, n in zip(stops, counts)]


@pytest.mark.parametrize("chunk, open_from, window", [(1 << 16, 1 << 12, None), (7, 5, 50), (64, 16, 300), (1000, 100, 2000)])
def test_ids_equal_the_library(merges, library, chunk, open_from, window):
    encoder = stream_bpe.Encoder(merges, chunk, open_from, window)
    for text, ids in zip(TEXTS, _each(encoder, TEXTS)):
        assert ids == library.encode(text or "", add_special_tokens=False).ids, repr(text)[:60]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_equal_the_library(merges, library, seed):
    rng = random.Random(seed)
    pieces = [" ", "  ", "\n", "\t", " \n", "a", "the", " the", "'s", "'", "re", "12", "é", "日", "🙂", "!", "...", " ", " ", END, "<|", "|>", "Zz", "__", "s" * 40, "-" * 70]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 120))) for _ in range(150)]
    encoder = stream_bpe.Encoder(merges, chunk=rng.choice([5, 33, 200]), open_from=rng.choice([4, 20]), window=rng.choice([60, 500]))
    for text, ids in zip(texts, _each(encoder, texts)):
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_all_code_points(merges, library):
    encoder = stream_bpe.Encoder(merges)
    for start in [*range(0, 0xD800, 64), *range(0xE000, 0x11000, 64), *range(0x1D000, 0x20000, 64)]:
        text = "".join(f"{chr(c)} a{chr(c)} {chr(c)}{chr(c)}b" for c in range(start, start + 64))
        assert _each(encoder, [text])[0] == library.encode(text, add_special_tokens=False).ids, hex(start)


def test_long_runs_stay_within_the_window(merges, library):
    rng = random.Random(5)
    text = "".join(rng.choices(["ment", "blood", "ation", "ed", "ly", "x", "qu", "es", "tr", "Especially", "hat", "ched"], k=6000))
    machine, out = stream_bpe.ByteTransducer(merges, window=4000), []
    for at in range(0, len(text), 500):
        out += machine.feed(text[at: at + 500].encode())
        assert len(machine.held) <= 4000
    assert out + machine.close() == library.encode(text, add_special_tokens=False).ids


def _merge(rules, data):
    parts = [data[k: k + 1] for k in range(len(data))]
    while True:
        ranks = [rules.get((a, b), len(rules)) for a, b in zip(parts, parts[1:])]
        if not ranks or min(ranks) == len(rules):
            return parts
        k = ranks.index(min(ranks))
        parts[k: k + 2] = [parts[k] + parts[k + 1]]


@pytest.mark.parametrize("seed", range(30))
def test_lookahead_settles_tokens(seed):
    """Brute force: every continuation of every short text leaves the boundaries beyond the lookahead as they are."""
    rng = random.Random(seed)
    made, merges = [b"a", b"b", b"c"][: rng.choice([2, 3])], []
    letters = list(made)
    while len(merges) < 7:
        u, v = rng.choice(made), rng.choice(made)
        if u + v not in made and len(u + v) <= 4:
            made.append(u + v)
            merges.append((u, v))
    bound = stream_bpe.sufficient_lookahead(merges)
    rules = {m: r for r, m in enumerate(merges)}
    length = 11 if len(letters) == 2 else 7
    seen: dict[bytes, dict[int, bool]] = {}
    for text in map(b"".join, itertools.product(letters, repeat=length)):
        ends = set(itertools.accumulate(map(len, _merge(rules, text))))
        for known in range(bound + 1, length + 1):
            state = tuple(p in ends for p in range(1, known - bound))
            assert seen.setdefault(text[:known], state) == state


def test_improper_lists_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "improper.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="proper"):
        stream_bpe.MergeList(str(path))


def test_text_machine_equals_whole_decoding():
    data = "aé日🙂".encode() + b"\xff\xe6\x97 \xf0\x9f\x99\x80\xc3"
    for cuts in itertools.combinations(range(len(data)), 3):
        machine, text, at = stream_bpe.TextMachine(), "", 0
        for cut in [*cuts, len(data)]:
            text += machine.feed(data[at:cut])
            at = cut
        assert text + machine.close() == data.decode("utf-8", "replace")


def test_decode_equals_the_library(spark, library):
    ids = [[0, 255, 50256, 100], [188, 189], [50256], [], None, [12520, 247], [226, 50256, 226], [39115, 34402]]
    found = {r.k: r.decoded for r in stream_bpe.decode(spark.createDataFrame(list(enumerate(ids)), "k int, ids array<int>"), PATH).collect()}
    assert found == {k: library.decode(one or [], skip_special_tokens=False) for k, one in enumerate(ids)}


def test_query_on_hard_texts(spark, library):
    rows = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] * 2 + [(None, "x", "", "")], "doc_id long, text string, ids string, decoded string")
    found = streamed(rows).collect()
    assert len(found) == 2 * len(TEXTS) + 1
    for r in found:
        text = "x" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark):
    assert streamed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_units_join_to_the_text_and_the_memory_forgets():
    for text in ["a b", " a  b ", "x \n y", "  ", "a", " ", "a  b", "a \x1cb c"]:
        assert "".join(" " + k for k in unit_keys(text, True)) == " " + text
    sized = lambda keys: (np.array([len(k) for k in keys for _ in range(len(k) % 3)]), np.array([len(k) % 3 for k in keys]))
    memory = UnitMemory(sized, entries=4, longest=3)
    for keys in (["a", "bb", "cccc", "a"], ["dddd", "e", "ff"], ["g", "h", "bb", "cccc"], [], ["xxx"], ["i", "dddd"]):
        ids, sizes = memory.ids(keys)
        assert sizes.tolist() == [len(k) % 3 for k in keys]
        assert ids.tolist() == [len(k) for k in keys for _ in range(len(k) % 3)]
