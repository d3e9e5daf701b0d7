"""The same odd tables for every operator: empty, null ids and texts, repeated rows, columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from foliant.llm import decontamination, jpeg, mainhtml, ordinal, packing, queries, similar, simhash, substrings, token_transducer, urlfilter

LONG = " ".join(f"w{i % 5000}" for i in range(30_000))
CLASH = "doc_id long, text string, id string, node int, bucket string, hits string, n long, fp string, _text string, size string, members string, items string, hit_spans string, url string, html string, page_id long, __k1 string, key string, count long, root string"
ROWS = [(1, "some words, here"), (1, "some words, here"), (None, "no id"), (None, None), (2, None), (3, ""), (4, LONG), (5, LONG + " more"), (6, "some words, here"), (7, "é \U0001f600 \x00 \x1c x")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "x", 1, "b", "h", 7, "f", "t", "s", "m", "i", "h", f"http://a.b/{i}", t, i, "k", "k", 3, "r") for i, t in rows], CLASH)


OPERATORS = {
    "token_transducer": lambda d: token_transducer.count_tokens(d, queries.BYTE_BPE, limit=512),
    "jpeg": lambda d: jpeg.read_back(jpeg.store(d)),
    "mainhtml": mainhtml.extract,
    "urlfilter": lambda d: urlfilter.judge_urls(d, queries.URL_RULES),
    "substrings": lambda d: substrings.remove_repeats(d),
    "simhash": simhash.near_duplicates,
    "similar": similar.similar_groups,
    "decontamination": lambda d: decontamination.find_benchmark(d, d.sparkSession.createDataFrame([(1, "some words"), (1, None), (None, "no id")], "item_id long, text string")),
    "ordinal": lambda d: ordinal.grade_documents(d, d.sparkSession.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(spark, name):
    run = OPERATORS[name]
    got = run(frame(spark)).collect()
    assert len(got) == len(ROWS)
    empty = run(frame(spark).limit(0))
    assert empty.count() == 0 and empty.columns == run(frame(spark)).columns


def test_packing_of_odd_tables(spark):
    got = packing.pack_documents(frame(spark), queries.WORD_BPE).collect()
    assert sum(r.piece == 0 for r in got) == len(ROWS)
    assert packing.pack_documents(frame(spark).limit(0), queries.WORD_BPE).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    docs = frame(spark)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        if name == "near_duplicates":
            # 1 for the copies, one of the texts without words (2), 4 for 5, 7, and the text without an id.
            assert sorted((r.doc_id for r in now.collect()), key=str) == [1, 2, 4, 7, None] and now.columns == docs.columns
    assert now.where(F.col("piece") == 0).count() == 5
    empty = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, folder).count() == 0
