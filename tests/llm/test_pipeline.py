"""The pipeline on a small table with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

WORDS = [a + b + c for a in "ba ce di fo gu ha".split() for b in "n r s t l".split() for c in "a e i o u".split()]


def prose(n, seed):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) for _ in range(12)) + "." for _ in range(n // 12))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    text = {i: prose(96, i) if i % 5 else prose(96, i).upper().replace(" ", "## ") for i in range(200)}
    passage = prose(36, 999)
    text |= {301: text[1], 302: text[2], 303: prose(60, 77) + "\n" + passage, 304: None, 305: "", 306: "few words"}
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in text.items()] + [(7, text[7], "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("score", F.lit("mine")).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, folder)
        assert docs.columns == want, name
    ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert ids == [i for i in range(200) if i % 5]


def test_run_gives_encodings(spark, folder):
    from tokenizers import Tokenizer

    from mnemos.llm.queries import vocabulary

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    text = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(out) == 160
    assert all(r["ids"] == lib.encode(text[r["doc_id"]], add_special_tokens=False).ids for r in out)


def test_near_dedup_finds_every_edited_copy(spark):
    """Held against all pairs of a similarity of 0.8: no link is lost and none is made."""
    from mnemos.llm import simhash

    text = {i: prose(96, 500 + i) for i in range(30)}
    edit = lambda t, *at: " ".join("zz" if k in at else w for k, w in enumerate(t.split()))
    text |= {100 + i: edit(text[i], 40) for i in range(10)} | {200 + i: edit(text[i], 10, 30, 50, 70) for i in range(10, 20)}
    text |= {1000 + k: edit(text[25], k, (7 * k) % 96) for k in range(60)}  # a crowd of one base
    text |= {2000 + k: edit(text[26], k, (k + 30) % 96, (k + 60) % 96) for k in range(40)}  # a crowd whose members differ more
    docs = spark.createDataFrame(list(text.items()), "doc_id bigint, text string")
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in text.items()}
    up = {i: i for i in text}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in text:
        for j in text:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    got = sorted(r["doc_id"] for r in corpus_pipeline.apply_near_dedup(spark, docs, "").select("doc_id").collect())
    assert got == sorted(i for i in text if find(i) == i) and {*range(210, 220)} < {*got}


def test_near_dedup_of_tables_without_links(spark):
    schema = "doc_id bigint, text string"
    assert corpus_pipeline.apply_near_dedup(spark, spark.createDataFrame([], schema), "").count() == 0
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "b"), (6, None)]
    got = corpus_pipeline.apply_near_dedup(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 4, 5]  # null and empty texts are copies of one another


def test_near_dedup_keeps_null_ids_and_texts_that_share_an_id(spark):
    a, b, c, d, e = (prose(60, 700 + k) for k in range(5))
    data = [(None, a), (None, b), (None, b), (1, c), (1, d), (None, d), (2, e), (2, e), (3, e)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    got = corpus_pipeline.apply_near_dedup(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, a), (None, b), (1, c), (1, d), (2, e)], key=str)


def test_stages_hold_little_memory(spark, folder, tmp_path):
    """Texts move in small batches when the caller writes a stage's result, and workers keep no encoder after it."""
    import pyarrow as pa

    from mnemos.llm import bpe_trie

    spark.range(3000).selectExpr("id doc_id", "cast(id as string) text").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = {name: spark.conf.get(name) for name in corpus_pipeline.BATCHES}

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "encoders": [len(bpe_trie._encoders)]})

    probe = lambda df: df.mapInArrow(seen, "n bigint, encoders bigint").collect()
    try:
        out = corpus_pipeline.apply_bpe(spark, docs, folder)
        assert max(r["n"] for r in probe(docs)) <= 1000 and out.agg(F.sum("n_tokens")).first()[0] >= 3000
        assert not any(r["encoders"] for r in probe(spark.range(8).repartition(8).select(F.col("id").cast("string"))))
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "256"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
