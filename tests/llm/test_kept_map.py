"""A stored slot-to-shard map is loaded and edited."""

import pytest

from statewell.llm import sharding


def test_calls_on_one_path(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.createDataFrame([(i, "x" * (i % 97)) for i in range(600)], "doc_id long, text string")
    versions = lambda: {r["version"]: r["count"] for r in spark.read.parquet(path).groupBy("version").count().collect()}
    place = lambda rows: {r["row"]["doc_id"]: (r["vslot"], r["shard"], r["slot"]) for r in rows}
    call = lambda d, shards: sharding.shard_documents(d, shards, slots=64, map_path=path).collect()

    first = call(docs, 4)
    again = call(docs, 4)
    assert len(first) == len(again) == 600 and place(first) == place(again) and versions() == {1: 64}

    grown = call(docs, 5)
    assert len(grown) == 600 and versions() == {1: 64, 2: 64}
    before, after = ({r["vslot"]: r["shard"] for r in rows} for rows in (first, grown))
    assert set(after.values()) == set(range(5)) and sum(before[v] == after[v] for v in before) > 32

    more = docs.unionByName(spark.createDataFrame([(1000, "y" * 9000)], docs.schema))
    assert len(call(more, 5)) == 601 and versions() == {1: 64, 2: 64, 3: 64}
    assert len(call(more, 5)) == 601 and versions() == {1: 64, 2: 64, 3: 64}
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, 4, slots=32, map_path=path)
