import hashlib
import random
import re

import numpy as np

from twinraster.llm import secrets_scan as S

SCHEMA = "doc_id long, text string, source string, start string"


def corpus(n=240):
    rng = random.Random(6)
    words = [a + b for a in ("over", "under", "mid", "fore") for b in ("stand", "ground", "line", "night", "day")]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    rows, truth = [], {}
    for i in range(n):
        kind = i % 6
        key = "".join(rng.choices("0123456789abcdef", k=40)) if i % 4 else "".join(rng.choices("ABCDEFGHabcdefghijk0123456789+/", k=32))
        if kind == 0:
            text, secret = f'{prose(8)} token = "{key}" {prose(5)}', key
        elif kind == 1:
            text, secret = f"{prose(6)} api_key: {key} {prose(5)}", key
        elif kind == 2:
            text, secret = f"{prose(6)} {rng.randrange(10**15, 10**16)} {prose(3)}", None
        elif kind == 3:
            text, secret = f"see {prose(2)} overstandundergroundline{rng.randrange(100)} {prose(4)}", None
        elif kind == 4:
            text, secret = f"id {rng.randrange(16**8):08x}-1234-4abc-8def-{rng.randrange(16**12):012x} {prose(4)}", None
        else:
            text, secret = prose(20), None
        rows.append((i, text, f"src/{kind % 3}/file.py", "clash"))
        truth[i] = secret
    return rows, truth


def test_forest_removes_false_positives(spark):
    rows, truth = corpus()
    found = S.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = {(r.doc_id, r.value_sha256) for r in found if r.is_secret}
    assert kept == {(i, hashlib.sha256(s.encode()).hexdigest()) for i, s in truth.items() if s}
    assert len(found) > len(kept)


def test_held_out_findings(spark):
    """Trained on given labels of one half, the other half is told apart without any rule."""
    rows, truth = corpus(400)
    docs = spark.createDataFrame(rows, SCHEMA)
    labelled = S.candidates(docs.filter("doc_id < 200"))
    given = spark.createDataFrame([(*r, int(truth[r.id] is not None)) for r in labelled.collect()], labelled.schema.add("label", "integer"))
    found = S.scan(docs.filter("doc_id >= 200"), given).collect()
    assert np.mean([r.is_secret == (truth[r.doc_id] is not None) for r in found]) > 0.97


def test_candidates_follow_the_pattern(spark):
    text = "a1b2c3d4e5f6g7h8 short1 " + "x" * 20 + " é" + "9" * 16 + "é 1234-5678-9012-3456 " + "q1" * 300
    rows = [(1, text, None, ""), (None, text, "p", ""), (2, None, "p", ""), (3, "", "p", ""), (4, "plain " * 50_000 + "k" * 15 + "7", "p", "")]
    found = S.candidates(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = [(m.start(), m.group()) for m in re.finditer(r"[A-Za-z0-9+/_=\-]+", text) if 16 <= len(m.group()) <= 512 and re.search("[0-9]", m.group())]
    for i in (1, None):
        assert sorted((r.start, r.value) for r in found if r.id == i) == expected
    assert [(r.start, r.value) for r in found if r.id == 4] == [(300_000, "k" * 15 + "7")] and not [r for r in found if r.id in (2, 3)]


def test_nothing_to_learn(spark):
    rows = [(1, "id 1234567890123456 and", "p", ""), (1, "id 1234567890123456 and", "p", ""), (2, "odd a9b8c7d6e5f4g3h2i1 here", None, "")]
    found = S.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.label, r.probability, r.is_secret) for r in found[:]if r.doc_id == 1) == [(1, 0, 0.0, False)] * 2
    assert [(r.label, r.probability, r.is_secret) for r in found if r.doc_id == 2] == [(None, 0.5, True)]
    assert S.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_short_and_digitless_secrets_are_scanned(spark):
    long, bearer = "MIIEvQIBADANBgkqhkiG9w0B" + "aB3+/" * 320, "x9Y" * 300
    rows = [(0, f'private_key = "{long}" end', long), (1, f"Authorization: Bearer {bearer}", bearer), (2, "password: p@s,s!;", "p@s,s!"),
            (3, "pwd='my pass phrase'", "my pass phrase"), (4, 'db_password="é"', "é"), (5, "SECRET_TOKEN=onlyLettersHere", "onlyLettersHere"), (6, f"data {long}", long),
            (7, 'auth: token=abc', "abc")]
    found = S.scan(spark.createDataFrame([(i, t, "p", "") for i, t, _ in rows], SCHEMA)).collect()
    shown = {(r.doc_id, r.n_chars, r.value_sha256) for r in found}
    assert {(i, len(v), hashlib.sha256(v.encode()).hexdigest()) for i, _, v in rows} <= shown
    assert len(shown) == len(found) and not S.spans("the token of a secret password, and no more:\nnext") and not S.spans("password = ''")
    nested = "token=" * 20_000 + "x"
    assert len(S.spans(nested)) == 2 and S.spans('{"auth": {"token": "x"}}')[-1] == (20, 21) and (12, 15) in S.spans('password = "abc')
    assert S.spans('secret: "' + "a " * 100_000)
