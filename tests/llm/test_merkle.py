"""Merkle manifest against trees built in plain Python."""

import zlib
from hashlib import sha256

import duckdb
import pytest

from check import canonical
from statewell.llm import catalog, merkle
from statewell.llm.base import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, pos int, n int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    out = []
    for name in merkle.FIELDS:
        v = row[name]
        v = v + more if name == "n_chars" and v is not None else v
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*out)


def levels(nodes):
    tree = [nodes]
    while len(tree[-1]) > 1:
        low = tree[-1]
        tree.append([h(*low[i:i + 2]) for i in range(0, len(low), 2)])
    return tree


def want(rows):
    """Sorted result rows; every version is a whole tree built anew."""
    first = lambda v: (v is not None, v or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    for mine in groups.values():
        mine.sort(key=lambda r: (first(r["doc_id"]), leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in langs}
    tops = levels([trees[g][-1][0] for g in langs])
    out = []
    for g in langs:
        for i, r in enumerate(groups[g]):
            beside = []
            for tree, at in ((trees[g], i), (tops, langs.index(g))):
                for level in tree[:-1]:
                    if at ^ 1 < len(level):
                        beside.append(level[at ^ 1])
                    at >>= 1
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            base = trees[g][0]
            own = base[:i] + [leaf(r, 1)] + base[i + 1:] if changed else base
            heads = [levels(own)[-1][0] if x == g else trees[x][-1][0] for x in langs]
            root = tops[-1][0]
            folded = levels(heads)[-1][0]
            out.append((r["doc_id"], base[i], trees[g][-1][0], root, h(*beside), folded, folded == root))
    return sorted(out, key=repr)


def got(frame, bits):
    names = ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in merkle.manifest(frame, bits=bits).collect()), key=repr)


@pytest.mark.parametrize("bits", [2, 10])
def test_trees_of_many_shapes(spark, bits):
    """Groups of 1 to 21 leaves, null, empty and odd names, repeated rows; block borders inside and outside the trees."""
    sizes = {None: 21, "": 1, "a": 2, "=": 3, "é": 5, "z": 16, "zz": 17, "b": 1}
    rows = [
        {"doc_id": 100 * j + i, "source": None if i % 3 else "s", "lang": g, "n_chars": None if i % 5 == 4 else i, "text": None if i % 4 == 3 else "té" * i}
        for j, (g, n) in enumerate(sizes.items()) for i in range(n)
    ]
    rows += [rows[3], rows[3], {"doc_id": None, "source": "x", "lang": "z", "n_chars": 7, "text": "no id"}, {"doc_id": 3, "source": "", "lang": None, "n_chars": 3, "text": "t"}]
    frame = spark.createDataFrame([(*[r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")], "g", 1, 2) for r in rows], SCHEMA).repartition(3)
    assert got(frame, bits) == want(rows)


def test_one_leaf_one_group_and_nothing(spark):
    one = [{"doc_id": 1, "source": None, "lang": "x", "n_chars": 2, "text": "ab"}]
    frame = lambda rows: spark.createDataFrame([(*[r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")], "g", 1, 2) for r in rows], SCHEMA)
    assert got(frame(one), 10) == want(one)
    three = [one[0] | {"doc_id": i} for i in range(3)]
    assert got(frame(three), 1) == want(three)
    assert merkle.manifest(frame([])).collect() == []


def test_long_text(spark):
    row = {"doc_id": 7, "source": "s", "lang": "x", "n_chars": 3_000_000, "text": "wörd " * 600_000}
    frame = spark.createDataFrame([(*[row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")], "g", 1, 2)], SCHEMA)
    assert got(frame, 10) == want([row])


def test_versions_share_what_they_do_not_copy(spark):
    """Reading a version, own copies first and the base for the rest, gives the tree rebuilt with the tampered leaf."""
    docs = table(spark, SF, "documents")
    base = {(r["g"], r["height"], r["pos"]): r["digest"].hex() for r in merkle.base_nodes(docs, bits=3).collect()}
    rows = merkle.manifest(docs, bits=3, versions=True).collect()
    count = {}
    for r in rows:
        count[r["g"]] = count.get(r["g"], 0) + 1
    checked = 0
    for r in rows:
        assert base[r["g"], 0, r["pos"]] == r["leaf"]
        if r["copies"] is None:
            continue
        checked += 1
        n = count[r["g"]]
        top = (n - 1).bit_length()
        own = {(k, r["pos"] >> k): r["copies"][k] for k in range(top + 1)}
        read = lambda k, p: own.get((k, p), base.get((r["g"], k, p)))  # noqa: B023, E731
        tree = levels([read(0, p) for p in range(n)])
        assert [[read(k, p) for p in range(len(level))] for k, level in enumerate(tree)] == tree
        assert len(r["copies"]) > top and r["copies"][-1] == r["folded_root"]
        assert not r["verified"]
    assert checked > 10 and len([k for k in base if k[1] == 0]) == len(rows)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = catalog.queries()["op11_merkle_manifest"](spark, SF)
    cur = con.execute(catalog.oracle_sql()["op11_merkle_manifest"])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([d[0] for d in cur.description], cur.fetchall())
