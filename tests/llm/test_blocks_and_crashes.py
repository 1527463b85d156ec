"""Benchmark blocks that meet through a cut, maps after a crash, vectors of extreme size."""

import numpy as np

from statewell.llm import decontaminate, neighbours, sharding


def windows(items, width):
    return {tuple(w[i:i + width]) for w in items for i in range(len(w) - width + 1)}


def test_window_that_another_blocks_cut_completes(spark):
    """Each item is taken out of the middle of each other: whatever the blocks are, no window may stay."""
    own = [[f"{chr(97 + k)}{i}" for i in range(10)] for k in range(8)]
    items = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(own)], "item_id long, text string")
    filler = " ".join(f"z{i}" for i in range(200))
    texts = [f"{filler} {' '.join(a[:5] + b + a[5:])}" for a in own for b in own if a is not b]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    known = windows(own, 10)
    for size in (15, 1_000_000):
        got = decontaminate.decontaminate(docs, items, item_words=size).collect()
        assert len(got) == len(texts)
        assert all(r["text"].split() == filler.split() and r["n_chars"] == len(r["text"]) for r in got)
        assert not any(windows([r["text"].split()], 10) & known for r in got)


def test_pieces_hold_all_windows_of_a_long_item(spark):
    words = [f"w{i * 7919 % 997}" for i in range(700)]
    items = spark.createDataFrame([(None, " ".join(words)), (None, "one two"), (3, None), (4, " ")], "item_id long, text string")
    pieces = decontaminate.item_pieces(items, 10, "item_id", "text", 160).collect()
    assert windows([r["text"].split() for r in pieces if r["n"] > 2], 10) == windows([words], 10)
    assert max(r["n"] for r in pieces) <= 29 and sum(r["n"] == 2 for r in pieces) == 1
    docs = spark.createDataFrame([(1, " ".join(words[300:345])), (2, "a one two b"), (3, None)], "doc_id long, text string")
    for size in (160, 200_000):
        rows = decontaminate.digest_columns(decontaminate.scan_documents(docs, items, item_words=size)).collect()
        assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in rows} == {1: (45, 1), 2: (2, 1), 3: (0, 0)}


def test_map_after_a_crash_and_a_second_writer(spark, tmp_path):
    path = str(tmp_path / "map")
    (tmp_path / "map" / ".staging-left").mkdir(parents=True)
    (tmp_path / "map" / ".staging-left" / "part-0.parquet").write_bytes(b"half")
    (tmp_path / "map" / "version=1").mkdir()
    docs = spark.createDataFrame([(i, "x" * (i % 31)) for i in range(200)], "doc_id long, text string")
    first = sharding.shard_documents(docs, 4, slots=32, map_path=path).collect()
    assert len(first) == 200
    stored = sharding.load_map(spark, path).collect()
    assert len(stored) == 32
    other = spark.createDataFrame([(1, v, 0) for v in range(32)], "version int, vslot int, shard int")
    assert not sharding.save_map(other, path)
    assert sorted(sharding.load_map(spark, path).collect()) == sorted(stored)
    again = sharding.shard_documents(docs, 4, slots=32, map_path=path).collect()
    assert {r["row"]["doc_id"]: r["shard"] for r in again} == {r["row"]["doc_id"]: r["shard"] for r in first}


def test_map_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    for _ in range(2):
        assert sharding.shard_documents(empty, 3, slots=16, map_path=str(tmp_path / "map")).count() == 0
    assert sharding.load_map(spark, str(tmp_path / "map")).count() == 16


def test_map_folder_setting(spark, tmp_path):
    spark.conf.set("statewell.map.folder", str(tmp_path))
    try:
        assert sharding.map_folder(spark, "op9", "/a").startswith(str(tmp_path) + "/map-op9-")
    finally:
        spark.conf.unset("statewell.map.folder")


def test_vectors_whose_squares_vanish_or_overflow(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    x = np.repeat(base, 3, axis=0) * np.tile([1e-200, 1.0, 1e200], 12)[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(frame).collect()}
    assert got == {i: (2, i // 3 * 3) for i in range(36)}
