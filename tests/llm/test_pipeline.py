import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from twinraster.llm import byte_bpe
from twinraster.llm.common import table
from twinraster.llm.mixing import draw, mix_sources
from twinraster.llm.near_dedup import near_duplicates

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "po", "ru", "sa", "ti") for b in ("ban", "dor", "fel", "gim", "hus", "jak", "len", "mor", "nit", "pel")]


def folder(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def corpus():
    rng = random.Random(12)
    rows, clean, junk = [], [], []
    for i in range(240):
        lines = [" ".join(rng.choices(WORDS, k=rng.randrange(8, 30))) + "." for _ in range(8)]
        if i % 6 == 5:
            lines = [line.upper().replace(" ", "### ") for line in lines]
            junk.append(i)
        else:
            clean.append(i)
        if i % 4 == 0:
            lines.insert(3, "All rights reserved by the makers of this text")
        rows.append([i, "\n".join(lines), rng.choice(["en", "de"]), rng.choice(["src0", "src1"]), 0])
    rows[100][1] = rows[40][1]
    rows[102][1] = rows[44][1].replace(".\n", ".\n", 1) + " end"
    rows += [[900, None, None, None, None], [901, "", "en", "src0", 0], [None, rows[1][1], "en", "src1", 0], [3, rows[3][1], rows[3][2], rows[3][3], 0]]
    labels = [(i, int(i in clean), 0) for i in range(0, 240, 2)] + [(i, int(i in clean), 0) for i in range(5, 240, 12)]
    return [tuple(r) for r in rows], labels, junk


def test_stages_keep_clean_rows_and_columns(spark, tmp_path):
    rows, labels, junk = corpus()
    sf_dir = folder(spark, tmp_path, rows, labels)
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        path = f"{tmp_path}/{name}.parquet"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns
    assert {r.doc_id for r in kept["quality_rules"]} == {r[0] for r in rows} - set(junk) - {900, 901}
    # line dedup by definition
    texts = {}
    first = {}
    for r in sorted((r for r in kept["quality_rules"] if r.doc_id is not None), key=lambda r: r.doc_id):
        for line in r.text.split("\n"):
            first.setdefault(line.strip().lower(), r.doc_id)
    for r in kept["quality_rules"]:
        if r.doc_id is not None:
            texts[r.doc_id] = "\n".join(x for x in r.text.split("\n") if len(x.strip()) < 10 or first[x.strip().lower()] == r.doc_id)
    assert {r.doc_id: r.text for r in kept["line_dedup"] if r.doc_id is not None} == texts
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"])
    # one row of each class stays, and the others are all there
    before = sorted(kept["line_dedup"], key=lambda r: (r.doc_id is None, r.doc_id))
    numbered = spark.createDataFrame([(k, r.text) for k, r in enumerate(before)], "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in near_duplicates(numbered).collect()}
    assert sorted(map(str, kept["near_dedup"])) == sorted(str(before[k]) for k, c in classes.items() if k == c)
    assert [r.doc_id for r in kept["near_dedup"]].count(3) == 1 and None not in {r.doc_id for r in kept["near_dedup"]}
    probability = {r.doc_id: r.keep_probability for r in mix_sources(spark.createDataFrame(kept["near_dedup"])).collect()}
    drawn = {i: int(hashlib.md5(f"11|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52 < p for i, p in probability.items()}
    assert {r.doc_id for r in kept["mixing"]} == {i for i, d in drawn.items() if d} and 0 < len(kept["mixing"]) < len(kept["near_dedup"])
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    expected = {r.doc_id: hashlib.sha256(" ".join(map(str, reference.encode_ordinary(r.text))).encode()).hexdigest() for r in kept["mixing"]}
    assert {r.doc_id: r.ids_sha256 for r in kept["byte_bpe"]} == expected
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, kept["byte_bpe"]))


def test_empty_documents(spark, tmp_path):
    sf_dir = folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf_dir).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_draw_is_even(spark, seed):
    from pyspark.sql import functions as F
    values = [r.u for r in spark.range(2000).select(draw(F.col("id"), seed).alias("u")).collect()]
    assert 0 <= min(values) and max(values) < 1 and abs(sum(values) / 2000 - .5) < .03


def test_copies_with_null_and_repeated_ids_go(spark):
    text = " ".join(WORDS)
    rows = [(3, text), (3, text), (None, text), (4, text), (None, None), (None, "a text of its own"), (7, "another one altogether, and longer")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert found == sorted([(3, text), (None, None), (None, "a text of its own"), (7, "another one altogether, and longer")], key=str)
