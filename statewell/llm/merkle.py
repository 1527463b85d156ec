"""Merkle manifest of a table as a persistent, path-copying tree.

A row's leaf is the SHA-256 of its fields; per group the leaves, in order of the key, are hashed in pairs up to a subroot,
and the subroots, in order of the group, in pairs up to the root. A tampered leaf makes a version of that tree: the version
owns copies of the leaf and of its ancestors, every other node is the base's, which is never changed.

The tree is cut into blocks of 2^BITS neighbours whose borders are aligned, so a block's subtree needs no other block. A
round hashes every block to one node and hands those to the next round, until a group has one node; the subroots go through
the same rounds. On the way down each node is told the siblings of its ancestors above its block. Blocks of leaves then
hash their own part once more, copy the ancestors of each tampered leaf inside the block, and continue its version through
the siblings above. A task holds one block, whatever the size of a group, and only 32-byte digests are shuffled.

Definitions:
* a field is ``-`` if null, else its UTF-8 length, ``:`` and its text; digests enter a node as hex text;
* an odd last node is hashed alone; a group of one leaf is its leaf, a table of one group has its subroot as root;
* null groups and null keys come first; rows of one key are ordered by their leaf, equal rows are told apart by counting;
* a null counter stays null when tampered with, and a row without a key is never tampered with;
* other columns are not read, so their names cannot clash; texts of any length are hashed where they are;
* every row gives one row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewell.common import small_side, with_scalar
from statewell.llm.base import stored
from statewell.operators.ranking import grouped_row_number

#: Levels of a block: 1,024 neighbours are hashed in one task.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: An entry of a path: which side the sibling stands on (none, left, right), then its digest.
NONE, LEFT, RIGHT = b"\0", b"\1", b"\2"
WIDE = 33


def field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def _pairs(nodes: list[bytes]) -> list[bytes]:
    """The next level: neighbours hashed as hex text, an odd last one alone."""
    text = [n.hex() for n in nodes]
    return [sha256("".join(text[i:i + 2]).encode()).digest() for i in range(0, len(text), 2)]


def _levels(count: int, bits: int) -> int:
    """Levels of a block in a group that has ``count`` nodes in this round: none if it is the last one."""
    return min(bits, (count - 1).bit_length())


def block_tree(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """All levels of a block's subtree, the leaves first."""
    tree = [nodes]
    for _ in range(levels):
        tree.append(_pairs(tree[-1]))
    return tree


def siblings(tree: list[list[bytes]], at: int) -> bytes:
    """The path of node ``at`` through its block: one entry for each level."""
    out = []
    for level in tree[:-1]:
        other = at ^ 1
        out.append((LEFT if at & 1 else RIGHT) + level[other] if other < len(level) else NONE + bytes(32))
        at >>= 1
    return b"".join(out)


def copied(node: bytes, path: bytes) -> list[bytes]:
    """The version's own nodes: ``node`` and a copy of each ancestor, next to the shared siblings of the path."""
    out = [node]
    for i in range(0, len(path), WIDE):
        side, other = path[i:i + 1], path[i + 1:i + WIDE].hex()
        own = out[-1].hex()
        text = own if side == NONE else other + own if side == LEFT else own + other
        out.append(sha256(text.encode()).digest())
    return out


def proof(path: bytes) -> str:
    """SHA-256 of the siblings' hex text, from the leaf to the root."""
    held = (path[i + 1:i + WIDE].hex() for i in range(0, len(path), WIDE) if path[i:i + 1] != NONE)
    return sha256("".join(held).encode()).hexdigest()


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _rounds(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """``(g, pos, digest, n)`` of every round; in the last one each group has one node. ``n`` counts the group's nodes."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0

    def fold(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n = block["n"][0].as_py()
        top = block_tree(block["digest"].to_pylist(), _levels(n, bits))[-1]
        return pa.table(
            {"g": block["g"][:1], "pos": pa.array([block["pos"][0].as_py() >> bits], pa.int64()), "digest": _binary(top),
             "n": pa.array([-(-n >> bits)], pa.int64())}
        )

    while most > 1:
        out.append(stored(_blocks(out[-1], bits).applyInArrow(fold, "g string, pos long, digest binary, n long"), "merkle-round"))
        most = -(-most >> bits)
    return out


def _blocks(nodes: DataFrame, bits: int):
    return nodes.withColumn("b", F.shiftright("pos", bits)).groupBy("g", "b")


def _with_paths(nodes: DataFrame, known: DataFrame, bits: int):
    """Blocks of a round's nodes, each beside the path of the node it folds to."""
    return _blocks(nodes, bits).cogroup(known.select("g", F.col("pos").alias("b"), "path").groupBy("g", "b"))


def _spread(nodes: DataFrame, known: DataFrame, bits: int) -> DataFrame:
    """``(g, pos, path)`` of the nodes of a round: their siblings inside the block, then the block's own path."""

    def spread(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        tree = block_tree(block["digest"].to_pylist(), _levels(block["n"][0].as_py(), bits))
        rest = above["path"][0].as_py()
        paths = [siblings(tree, i) + rest for i in range(block.num_rows)]
        return pa.table({"g": block["g"], "pos": block["pos"], "path": _binary(paths)})

    return _with_paths(nodes, known, bits).applyInArrow(spread, "g string, pos long, path binary")


def _paths(rounds: list[DataFrame], top: DataFrame, bits: int) -> DataFrame:
    """``(g, pos, path)`` for the blocks of leaves; ``top`` has the paths ``(g, path)`` of the groups' last nodes."""
    paths = top.select("g", F.lit(0).cast("long").alias("pos"), "path")
    for nodes in reversed(rounds[1:-1]):
        paths = stored(_spread(nodes, paths, bits), "merkle-paths")
    return paths


def positions(docs: DataFrame, key: str, fields: Sequence[str], group: str, counter: str, modulus: int) -> DataFrame:
    """``(key, g, digest, changed, pos, n)``: the leaf of every row and its place in its group, hot groups spread by range.

    ``changed`` is the leaf after tampering, null where nothing is tampered with.
    """
    chosen = F.crc32(F.col(key).cast("string").cast("binary")) % modulus == 0
    tampered = [F.col(c) + 1 if c == counter else F.col(c) for c in fields]
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = stored(
        docs.select(
            F.col(key).alias("key"), named.alias("g"), leaf([F.col(c) for c in fields]).alias("digest"),
            F.when(chosen, leaf(tampered)).alias("changed"),
        ),
        "merkle-leaves",
    )
    numbered = grouped_row_number(leaves, ["g"], ["key", "digest"], "rank")
    count = small_side(stored(leaves.groupBy("g").agg(F.count("*").alias("n")), "merkle-counts"))
    placed = numbered.select("key", "g", "digest", "changed", (F.col("rank") - 1).cast("long").alias("pos"))
    return stored(placed.join(count, "g"), "merkle-placed")


def manifest(
    docs: DataFrame, key: str = "doc_id", fields: Sequence[str] = FIELDS, group: str = "lang", counter: str = "n_chars",
    modulus: int = 7, bits: int = BITS, versions: bool = False,
) -> DataFrame:
    """``(key, g, pos, leaf, subroot, root, proof_sha256, folded_root, verified, copies)`` for every row, digests in hex.

    Rows whose key's crc32 ``modulus`` divides are tampered with: ``counter`` grows by one. ``folded_root`` is the root of
    the row's version, ``verified`` whether that is the base's root. With ``versions`` the array ``copies`` holds the nodes
    that the version owns, the leaf first; all others it shares. Otherwise it is null.
    """
    leaves = positions(docs, key, fields, group, counter, modulus)
    rounds = _rounds(leaves.select("g", "pos", "digest", "n"), bits)
    # the subroots in order of their groups are the leaves of one more tree
    ranked = grouped_row_number(rounds[-1].select("g", "digest", F.lit("").alias("all")), ["all"], ["g"], "rank")
    places = ranked.select("g", "digest", (F.col("rank") - 1).cast("long").alias("pos"))
    upper = stored(with_scalar(places, rounds[-1].agg(F.count("*")), "n"), "merkle-groups")
    above = _rounds(upper.select(F.lit("").alias("g"), "pos", "digest", "n"), bits)
    start = _paths(above, above[-1].select("g", F.lit(b"").alias("path")), bits)
    path_of_group = _spread(above[0], start, bits).select("pos", "path")
    tops = stored(upper.select("g", "pos", "digest").join(path_of_group, "pos"), "merkle-tops")
    paths = _paths(rounds, tops, bits)
    kind = leaves.schema["key"].dataType.simpleString()

    def finish(block: pa.Table, known: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        nodes = block["digest"].to_pylist()
        tree = block_tree(nodes, _levels(block["n"][0].as_py(), bits))
        rest = known["path"][0].as_py()
        proofs, folded, copies = [], [], []
        for i, changed in enumerate(block["changed"].to_pylist()):
            path = siblings(tree, i) + rest
            version = copied(nodes[i] if changed is None else changed, path)
            proofs.append(proof(path))
            folded.append(version[-1])
            copies.append(version if versions and changed is not None else None)
        return pa.table(
            {"key": block["key"], "g": block["g"], "pos": block["pos"], "digest": block["digest"], "proof": pa.array(proofs, pa.string()),
             "folded": _binary(folded), "copies": pa.array(copies, pa.list_(pa.binary()))}
        )

    done = _with_paths(leaves, paths, bits).applyInArrow(
        finish, f"key {kind}, g string, pos long, digest binary, proof string, folded binary, copies array<binary>"
    )
    whole = with_scalar(done, above[-1].select("digest"), "_root")
    return whole.join(small_side(tops.select("g", F.col("digest").alias("_subroot"))), "g").select(
        "key", _group_name().alias("g"), "pos", _hex("digest").alias("leaf"), _hex("_subroot").alias("subroot"), _hex("_root").alias("root"),
        F.col("proof").alias("proof_sha256"), _hex("folded").alias("folded_root"), (F.col("folded") == F.col("_root")).alias("verified"),
        F.transform("copies", _hex).alias("copies"),
    )


def _hex(column: Column | str) -> Column:
    return F.lower(F.hex(column))


def _group_name() -> Column:
    """The group as given; inside, it is marked so that null and the empty text differ and null comes first."""
    return F.when(F.col("g") != "", F.expr("substring(g, 2)"))


def base_nodes(
    docs: DataFrame, key: str = "doc_id", fields: Sequence[str] = FIELDS, group: str = "lang", counter: str = "n_chars",
    modulus: int = 7, bits: int = BITS,
) -> DataFrame:
    """``(g, height, pos, digest)``: the nodes of every group's base tree, which all versions share."""
    rounds = _rounds(positions(docs, key, fields, group, counter, modulus).select("g", "pos", "digest", "n"), bits)

    def laid(nodes: DataFrame, below: int) -> DataFrame:
        def lay(block: pa.Table) -> pa.Table:
            block = block.sort_by("pos")
            first = block["pos"][0].as_py()
            tree = block_tree(block["digest"].to_pylist(), _levels(block["n"][0].as_py(), bits))
            rows = [(below + h, (first >> h) + i, d) for h, level in enumerate(tree[:-1]) for i, d in enumerate(level)]
            return pa.table(
                {"g": pa.array([block["g"][0].as_py()] * len(rows), pa.string()), "height": pa.array([r[0] for r in rows], pa.int32()),
                 "pos": pa.array([r[1] for r in rows], pa.int64()), "digest": _binary([r[2] for r in rows])}
            )

        return _blocks(nodes, bits).applyInArrow(lay, "g string, height int, pos long, digest binary")

    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).cast("int")
    tops = rounds[-1].select("g", "digest").join(rounds[0].filter("pos = 0").select("g", height.alias("height")), "g")
    out = tops.select("g", "height", F.lit(0).cast("long").alias("pos"), "digest")
    for turn, nodes in enumerate(rounds[:-1]):
        out = out.unionByName(laid(nodes, turn * bits))
    return out.select(_group_name().alias("g"), "height", "pos", "digest")
