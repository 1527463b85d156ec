from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statewell.llm import brown

TEXTS = ["a b a  zz", None, "", "b B\tq q q", "a " * 40, "zz"]


@pytest.mark.parametrize("counts", [{b"": 9, b"a": 5, b"b": 3}, {}])
def test_texts_are_stored_once_as_numbers(spark, counts):
    words = sorted(counts)
    args = (words, [counts[w] for w in words], sum(counts.values()))
    lexicon = brown.Lexicon(*args)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string").withColumn("held_out", F.lit(False))
    rows = {r["key"]: r for r in brown.encode(docs, spark.sparkContext.broadcast(args)).collect()}
    assert len({r["rid"] for r in rows.values()}) == len(TEXTS)
    for key, text in enumerate(TEXTS):
        tokens = [*brown.words_of(text), brown.END]
        at, unit = lexicon.places(np.array(rows[key]["codes"], np.int32))
        assert at.tolist() == [lexicon.index.get(w, -1) for w in tokens]
        wanted = [lexicon.unit[lexicon.index[w]] if w in lexicon.index else 0 if not w else lexicon.first_ending + brown.ending(w) for w in tokens]
        assert unit.tolist() == wanted
        assert {bytes(r["word"]): r["n"] for r in rows[key]["rare"]} == Counter(w for w in tokens if w not in lexicon.index)


def test_batches_are_cut_between_texts(monkeypatch):
    monkeypatch.setattr(brown, "FOLD", 5)
    lists = [[1, 2], [3], [4, 5, 6], list(range(9)), [7]]
    batch = pa.RecordBatch.from_arrays([pa.array([[0], *lists], pa.list_(pa.int32()))], names=["codes"]).slice(1)
    got = [codes[i:j].tolist() for ends, codes in brown.whole_texts(batch, 0) for i, j in zip(ends, ends[1:])]
    assert got == lists
