"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statewell.llm import brown, decontaminate, extract, licenses, mixing, near_copies, neighbours, pii, sharding, simhash, toxicity
from statewell.llm.base import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, score double, fp long, size long, _k long"
LONG = "word " * 60_000
TEXTS = [None, "", " \n", "a", "One two three four five six seven eight nine ten eleven", LONG, LONG, "x" * 200_000, "é" * 50, "\u0000  ퟿ 1"]


def documents(spark, rows=None):
    if rows is None:
        rows = [(i, t, None, None if i % 3 else f"s{i % 2}", None, "r", "s", 0.5, 7, 3, 1) for i, t in enumerate(TEXTS)]
        rows += [rows[4], rows[4], (None, "no id", *rows[0][2:]), (None, None, *rows[0][2:]), (None, "no id", *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def labels(spark, rows=None):
    return spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 0, None), (None, 1, 1), (1, 1, 1)] if rows is None else rows, "doc_id long, quality int, toxic int")


def items(spark, rows=None):
    return spark.createDataFrame(
        [(1, "two three four five six seven eight nine ten eleven"), (2, None), (None, "a"), (3, ""), (3, "nine ten")] if rows is None else rows,
        "item_id long, text string",
    )


OPERATORS = {
    "toxicity": lambda s, d, e: toxicity.score(d, toxicity.fit(d, labels(s, e))),
    "toxicity_stage": lambda s, d, e: toxicity.keep_clean(d, labels(s, e)),
    "decontaminate": lambda s, d, e: decontaminate.digest_columns(decontaminate.scan_documents(d, items(s, e))),
    "decontaminate_stage": lambda s, d, e: decontaminate.decontaminate(d, items(s, e)),
    "simhash": lambda s, d, e: simhash.near_duplicates(d),
    "simhash_stage": lambda s, d, e: near_copies.keep_first(d),
    "licenses": lambda s, d, e: licenses.scan(d),
    "license_parts": lambda s, d, e: licenses.scan_parts(d),
    "extract": lambda s, d, e: extract.extract(d, "doc_id", "source", "text"),
    "brown": lambda s, d, e: brown.score(d, ~held_out(5, 1)),
    "pii": lambda s, d, e: pii.digest_columns(pii.find_spans(d)),
    "mixing": lambda s, d, e: mixing.mix(d),
    "mixing_stage": lambda s, d, e: mixing.mix_documents(d),
    "sharding": lambda s, d, e: sharding.shard_documents(d),
}
FILTERS = {"toxicity_stage", "decontaminate_stage", "simhash_stage", "mixing_stage"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = documents(spark)
    out = OPERATORS[name](spark, docs, None)
    n = len(out.collect())
    if name in FILTERS:
        assert out.columns == docs.columns
    else:
        assert n == docs.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, documents(spark, []), []).collect() == []


def test_empty_side_tables_leave_documents_alone(spark):
    docs = documents(spark)
    assert toxicity.keep_clean(docs, labels(spark, [])).count() == docs.count()
    found = decontaminate.decontaminate(docs, items(spark, []))
    assert found.exceptAll(docs).isEmpty() and docs.exceptAll(found).isEmpty()


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(i, f"text {i} of some words", "en", f"s{i % 3}", 20) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        else:
            assert set(docs.columns) < set(out.columns)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, vector string")


def test_vectors_odd_rows(spark):
    one, nan = [1.0, 0.0, 0.5], float("nan")
    rows = [(1, one), (2, one), (2, one), (3, [2.0, 0.0, 1.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 1.0]), (7, [1.0, None, 1.0]),
            (8, [float("inf"), 1.0, 1.0]), (None, one), (9, [1.0, 0.0]), (10, []), (11, [-1.0, 0.0, -0.5]), (None, None)]
    out = neighbours.near_duplicates(vectors(spark, [(*r, 0, 1, "x") for r in rows]))
    got = {r["vec_id"]: r for r in out.collect() if r["vec_id"] is not None}
    assert out.count() == len(rows)
    assert got[1]["n_links"] == got[3]["n_links"] == 4 and got[3]["component_id"] == 1 and not got[3]["kept"] and got[1]["kept"]
    for alone in (4, 5, 6, 7, 8, 9, 10, 11):
        assert (got[alone]["n_links"], got[alone]["component_id"], got[alone]["kept"]) == (0, alone, True)
    assert neighbours.near_duplicates(vectors(spark, [])).collect() == []


def test_held_out_is_crc32(spark):
    import zlib

    got = {r["doc_id"]: r["h"] for r in spark.range(50).select(F.col("id").alias("doc_id")).withColumn("h", held_out(5, 1)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(50)}
