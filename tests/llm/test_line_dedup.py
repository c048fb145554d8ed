import re
import string

import pytest

from twinraster.llm.line_dedup import drop_repeated_lines

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)


def brute(rows, min_docs):
    holders = {}
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [i is not None and len(key(x)) >= 10 and len(holders[key(x)]) >= min_docs and i != min(holders[key(x)]) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, None if text is None else kept, len(lines), sum(gone)))
    return sorted(out, key=str)


ROWS = [
    (1, "shared line here\nown line number one\nSHARED line here  "), (2, "\t Shared Line HERE\r\nshort\nshort\nÄÖÜ ÄÖÜ ÄÖÜ"), (3, "shared line here"),
    (4, None), (5, ""), (6, "\n\n"), (7, "short\n123456789\n1234567890"), (8, "123456789\n1234567890\näöü äöü äöü"), (9, "x" * 300_000 + "\nshared line here"),
    (10, "x" * 300_000), (None, "shared line here\nnull ids keep all lines"), (None, "null ids keep all lines"), (3, "shared line here"), (3, "another text, shared line here\nrepeat of id three"),
    (11, "repeat of id three\n" * 500), (12, "\x0brepeat of id three\x0c\nlast"), (13, "only\nhere only here"),
]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_equals_brute_force(spark, min_docs):
    docs = spark.createDataFrame([(i, t, "clash", 7, "x") for i, t in ROWS], "doc_id long, text string, pos string, n_lines int, h string").repartition(4)
    found = drop_repeated_lines(docs, min_docs=min_docs)
    assert sorted(found.columns) == ["doc_id", "h", "n_dropped", "n_lines", "pos", "text"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=str) == brute(ROWS, min_docs)
    assert {(r.pos, r.h) for r in found.collect()} == {("clash", "x")}


def test_empty_table_and_native_plan(spark):
    empty = drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == []
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
