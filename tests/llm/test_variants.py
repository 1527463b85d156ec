"""Spelling variants against plain Python and SQL."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from check import canonical
from statewell.llm import catalog, variants

SF = "/root/testdata/sf0.001"
LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(c) for c in range(0xC0, 0x100)}


def count(rows, least=5, most=3):
    seen = Counter()
    for doc, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if c in LETTERS:
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                seen[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
                run = ""
    return {w: n for w, n in seen.items() if len(w) >= least and n >= most}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def want(words):
    form, beside = {}, {}
    for a in words:
        mine = [b for b in words if near(a, b)]
        beside[a] = len(mine)
        best = min(mine, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 2 * words[a] else None
    out = []
    for a in words:
        root = a
        while form[root] is not None:
            root = form[root]
        out.append((a, words[a], beside[a], form[a], words.get(form[a]), root))
    return sorted(out)


def got(frame):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in frame.collect())


@pytest.mark.parametrize("parts", [3, 5])
def test_all_pairs(spark, parts):
    """Random words over few letters, so that most are near several others, with repeats, accents, x-times signs and ties."""
    rng = np.random.default_rng(parts)
    words = Counter()
    for _ in range(500):
        words["".join(rng.choice(list("abcé×"), rng.integers(5, 8)))] += int(rng.integers(3, 40))
    words |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert got(variants.variants(frame, parts=parts)) == want(words)


def test_long_words_at_every_edit(spark):
    base = "internationalisierung"
    words = {base: 100}
    for i in range(len(base)):
        words[base[:i] + base[i + 1:]] = 3
        words[base[:i] + "q" + base[i + 1:]] = 4
        words[base[:i] + "z" + base[i:]] = 5
    assert got(variants.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == want(words)


def test_nothing_is_broadcast(spark, monkeypatch):
    """Signatures are forty rows a word, but Spark takes them to be as small as the words; so no join may go by that size."""
    words = {f"{a}{b}{c}word": 3 * 2 ** i for i, a in enumerate("abcdef") for b in "ghi" for c in "jkl"}
    plans, kept = [], variants.stored

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def stored(df, name):
        plans.append(plan(df))
        return kept(df, name)

    monkeypatch.setattr(variants, "stored", stored)
    frame = variants.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    plans.append(plan(frame))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5
    assert not [p for p in plans if "Broadcast" in p]
    assert got(frame) == want(words)


def test_counts_of_odd_rows(spark):
    long = "Straße straße " * 100_000
    rows = [(1, None), (2, ""), (3, long), (None, "Hello hello HELLO hellò hellò hellò"), (None, "Hello"), (5, "naïve×naïve " * 9), (5, "naïve×naïve " * 9), (6, "x" * 2_000_000)]
    rows += [(i, "counting words again, counting Words") for i in range(200)]
    frame = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    assert {r["word"]: r["n"] for r in variants.word_counts(frame).collect()} == count(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(variants.word_counts(empty)).collect() == []


def test_query_by_brute_force_and_sql(spark):
    frame = catalog.op13_spelling_variants(spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    words = count([tuple(r) for r in docs])
    assert {r[0]: r[1] for r in rows} == words
    # all pairs over the words of the smallest table
    by_rest = {}
    for w in words:
        for i in range(len(w)):
            by_rest.setdefault(w[:i] + w[i + 1:], set()).add(w)
    beside = {w: {b for i in range(len(w)) for b in by_rest[w[:i] + w[i + 1:]] if near(w, b)} | {b for b in by_rest.get(w, ()) if near(w, b)}
              | {w[:i] + w[i + 1:] for i in range(len(w)) if w[:i] + w[i + 1:] in words} for w in words}
    assert {r[0]: r[2] for r in rows} == {w: len(b) for w, b in beside.items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(catalog.oracle_sql()["op13_spelling_variants"])
    assert canonical(frame.columns, rows) == canonical([d[0] for d in cur.description], cur.fetchall())
