"""Benchmark decontamination with a generalised suffix automaton of the items' words.

One automaton holds every run of words of every item. Streaming a document through it gives, at each word, the longest
run ending there that occurs in an item; where it reaches the window length the window is hit.

Definitions:
* words are runs of a-z, 0-9 and non-ASCII characters after A-Z became a-z; null and empty texts have none;
* a window is ``window`` consecutive words of an item; an item of fewer words, but some, is one window;
* items that share an id count once; an item without an id counts under the text "null";
* every row of the documents gives one row, repeated rows included; other columns travel in a struct and cannot clash;
* without items nothing is hit; an empty table of documents gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewell.llm.base import LOWER_BYTES, stored

#: Item words in one automaton; more items make more automata, shipped and used one after the other.
ITEM_WORDS = 200_000

#: Lower-cases A-Z and turns every other ASCII byte that is not a digit or a letter into a blank.
WORD_BYTES = bytes(LOWER_BYTES[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
PAIR_BITS = 22


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; states are numbers, 0 is the empty run."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.word: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.word.setdefault(w, len(self.word)))
        self.in_window: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        self.least = min((min(window, len(words)) for _, words in items), default=0)
        for name, words in items:
            self._note(name, words)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, words in items:
            ids = np.array([self.word[w] for w in words])
            self.pairs[self._pair(ids[:-1], ids[1:])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7919) & ((1 << PAIR_BITS) - 1)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(w)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._split(last, w, known)
        state = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and w not in nxt[at]:
            nxt[at][w] = state
            at = link[at]
        if at != -1:
            q = nxt[at][w]
            link[state] = q if length[q] == length[at] + 1 else self._split(at, w, q)
        return state

    def _split(self, at: int, w: int, q: int) -> int:
        """A state of its own for the shorter runs of q, those that continue ``at``."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while at != -1 and self.next[at].get(w) == q:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def _note(self, name: str, words: list[bytes]) -> None:
        """Write the item's name at the states of its windows."""
        at = 0
        for w in words:
            at = self.next[at][self.word[w]]
            if len(words) >= self.window:
                if self.length[at] >= self.window:
                    self.in_window.setdefault(self.at_window(at), set()).add(name)
        if len(words) < self.window:
            self.whole.setdefault(at, []).append((len(words), name))

    def at_window(self, state: int) -> int:
        """The state of the last ``window`` words of a longer run."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """``(start, end)`` of the stretches whose neighbouring words follow each other in some item; others reach no window."""
        known = ids >= 0
        if self.least > 1:
            if len(ids) < self.least:
                return np.empty((0, 2), int)
            good = known[:-1] & known[1:]
            good &= self.pairs[self._pair(ids[:-1], ids[1:])]
            extra, need = 1, self.least - 1
        else:
            good, extra, need = known, 0, 1
        edge = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
        spans = edge.reshape(-1, 2)
        spans = spans[spans[:, 1] - spans[:, 0] >= need]
        return spans + np.array([0, extra])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches of word positions (end exclusive, merged) and the names of the items."""
        if not self.least:
            return [], set()
        get = self.word.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        hits: list[tuple[int, int]] = []
        names: set[str] = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for start, end in self.runs(ids).tolist():
            state = run = 0
            for i, w in enumerate(ids[start:end].tolist(), start):
                while state and w not in nxt[state]:
                    state = link[state]
                    run = length[state]
                to = nxt[state].get(w)
                if to is None:
                    continue
                state, run = to, run + 1
                reach = 0
                if run >= window:
                    names |= self.in_window.get(self.at_window(state), set())
                    reach = window
                if self.whole:
                    up = state
                    while up:
                        for n, name in self.whole.get(up, ()):
                            if n <= run:
                                names.add(name)
                                reach = max(reach, n)
                        up = link[up]
                if reach:
                    hits.append((i + 1 - reach, i + 1))
        return merged(hits), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def built(items: Broadcast, window: int) -> Automaton:
    """The automaton of a block; each task builds its own, which is linear in the block."""
    return Automaton([(name, words_of(text)) for name, text in items.value], window)


def item_pieces(items: DataFrame, window: int, item: str, text: str, item_words: int) -> DataFrame:
    """``(name, text, n)``: items of more than an eighth of a block as overlapping pieces that hold all their windows."""
    step = max(item_words // 8, 1)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(body.as_py())
                windows = max(len(words) - window + 1, 1)
                pieces = [words[at:min(at + step, windows) + window - 1] for at in range(0, windows, step)] if words else []
                out += [(name, b" ".join(piece).decode("utf-8", "surrogatepass"), len(piece)) for piece in pieces]
            names, texts, sizes = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["name", "text", "n"]
            )

    named = items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("name"), F.col(text).alias("text")).filter("text is not null")
    return named.mapInArrow(cut_up, "name string, text string, n long")


def shipped_blocks(
    items: DataFrame, item: str = "item_id", text: str = "text", item_words: int = ITEM_WORDS, window: int = 10
) -> tuple[int, Callable[[int], Broadcast]]:
    """The number of blocks of item words and what ships one of them; the caller releases a block before the next.

    The words are counted first; a hash of an item's piece names its block, so rows without id spread like others.
    """
    pieces = stored(item_pieces(items, window, item, text, item_words), "decontaminate-items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = -(-2 * total // item_words) if total > item_words else 1
    block = F.pmod(F.xxhash64("name", "text"), F.lit(blocks))

    def ship(b: int) -> Broadcast:
        return items.sparkSession.sparkContext.broadcast([(r["name"], r["text"]) for r in pieces.filter(block == b).collect()])

    return blocks, ship


def scan_documents(
    docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text",
    carry: list[str] | None = None, item_words: int = ITEM_WORDS,
) -> DataFrame:
    """``(row, text, n_words, hits, items)``: hit word stretches and the ids of the items hit, for every document; no text."""
    schema = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    found = docs.select(
        F.struct(*(docs.columns if carry is None else carry)).alias("row"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    blocks, ship = shipped_blocks(items, item, item_text, item_words, window)
    for b in range(blocks):
        shipped = ship(b)

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped, last=b == blocks - 1) -> Iterator[pa.RecordBatch]:
            automaton = built(shipped, window)
            for batch in batches:
                n, hits, names = [], [], []
                earlier = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
                for body, (spans, ids) in zip(batch.column(1), earlier):
                    words = words_of(body.as_py())
                    new, more = automaton.scan(words)
                    n.append(len(words))
                    hits.append([{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in spans] + new)])
                    names.append(sorted(more.union(ids)))
                body = pa.nulls(len(n), pa.string()) if last else batch.column(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), body, pa.array(n, pa.int64()), pa.array(hits, schema), pa.array(names, pa.list_(pa.string()))],
                    names=["row", "text", "n_words", "hits", "items"],
                )

        found = found.mapInArrow(scan, found.schema)
        if b < blocks - 1:
            found = stored(found, "decontaminate-block")
            shipped.unpersist()
    return found


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        F.col("row")[key].alias(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut(text: str, stretches: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each stretch."""
    raw = text.encode("utf-8", "surrogatepass")
    flags = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))).reshape(-1, 2)
    out, at = [], 0
    for a, b in stretches:
        out.append(raw[at:edge[a, 0]])
        at = edge[b - 1, 1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def clean(text: str, automaton: Automaton) -> tuple[str, int, int]:
    """The text without hit stretches, the words cut and the words it had; what a cut brings together is scanned again."""
    words = words_of(text)
    n, gone = len(words), 0
    hits, _ = automaton.scan(words)
    while hits:
        gone += sum(b - a for a, b in hits)
        text = cut(text, hits)
        hits, _ = automaton.scan(words_of(text))
    return text, gone, n


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.5, text: str = "text", n_chars: str | None = "n_chars",
    item: str = "item_id", item_text: str = "text", item_words: int = ITEM_WORDS,
) -> DataFrame:
    """The documents without the stretches of ``window`` or more item words; same columns.

    A document goes altogether when more than ``coverage`` of its words are hit. ``n_chars`` (if there is one) is counted
    anew for texts that were cut; a text without a hit stays as it is, null and empty ones included. A cut can bring words
    of another block's window together, so several blocks are gone through until a whole round cuts nothing; a later round
    scans only the texts that the round before it cut.
    """
    found = docs.select(
        F.struct("*").alias("row"), F.col(text).alias("text"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("words"),
        F.lit(True).alias("due"), F.lit(False).alias("again"),
    )
    blocks, ship = shipped_blocks(items, item, item_text, item_words, window)

    def washed(found: DataFrame, shipped: Broadcast) -> DataFrame:
        def wash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = built(shipped, window)
            for batch in batches:
                texts, gone, words, again = [], [], [], []
                before = zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
                for body, (n_before, first, due, more) in zip(batch.column(1), before):
                    body = body.as_py()
                    new, n_gone, n = clean(body, automaton) if body and due else (body, 0, 0)
                    texts.append(new)
                    gone.append(n_before + n_gone)
                    words.append(max(first, n))
                    again.append(more or n_gone > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64()), pa.array(words, pa.int64()),
                     batch.column(4), pa.array(again, pa.bool_())],
                    names=["row", "text", "gone", "words", "due", "again"],
                )

        return found.mapInArrow(wash, found.schema)

    if blocks == 1:
        found = washed(found, ship(0))
    else:
        while True:
            for b in range(blocks):
                shipped = ship(b)
                found = stored(washed(found, shipped), "decontaminate-block")
                shipped.unpersist()
            if found.filter("again").isEmpty():
                break
            found = found.withColumns({"due": F.col("again"), "again": F.lit(False)})
    kept = found.filter(F.col("gone") <= F.lit(coverage) * F.col("words"))
    columns = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == text:
            value = F.col("text")
        elif c == n_chars:
            value = F.when(F.col("gone") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return kept.select(*columns)
