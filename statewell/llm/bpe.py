"""Byte-level BPE by corpus-level merge replay.

Not text by text: the distinct words of a block of the corpus are laid end to end, an inverted index keeps for each token
pair the positions where it stands, and the merges are replayed once over all of them in rank order. A merge visits only
the positions of its pair; the two neighbours of a merged position are the only ones whose pairs change, and they enter
the index under their new pair. Each distinct word is so encoded once per block, whatever its number of occurrences.

A block is what a task reads until its new words reach BLOCK_BYTES. Nothing is shuffled: the encodings of all the corpus's
words would have to travel back to every text that uses them, several times the input, while a block finds them in memory.
The results do not depend on where a block ends, and a lost task repeats its own blocks only.

Definitions:
* the pre-tokeniser's matches are encoded separately; a match that is a token of the vocabulary is that token;
* of equal lowest pairs in a word the leftmost is merged first, and a merge may bring up a pair of lower rank, which then
  goes first, as in the public library;
* a null text is an empty one and has no tokens; no token of the vocabulary is treated as special;
* texts of any length are read match by match; every row gives one row, repeated rows too; an empty table gives none;
* only the columns in ``carry`` and the text are read, so other names cannot clash.
"""

from __future__ import annotations

from array import array
from base64 import b64decode
from collections.abc import Iterator, Sequence
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of new words after which a block is replayed, matches after which its texts are written, words kept for later blocks.
BLOCK_BYTES, BLOCK_WORDS, KEPT_WORDS = 1 << 20, 1 << 22, 300_000
#: Texts longer than this are read through an iterator.
LONG_TEXT = 1 << 20

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path() -> str:
    """Where the public 50k vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank from a file of base64 tokens and ranks, one a line."""
    with open(path, "rb") as file:
        return {b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def replay(words: Sequence[bytes], ranks: dict[bytes, int], token: dict[int, bytes]) -> list[list[int]]:
    """Token ids of every word (none empty), all merges replayed together in rank order; ``token`` inverts ``ranks``."""
    part: list[bytes] = []  # the token that starts at a position, b"" once merged into an earlier one
    ends = [0]
    single = [bytes((i,)) for i in range(256)]
    for word in words:
        part += [single[b] for b in word]
        ends.append(len(part))
    size = len(part)
    after = array("q", range(1, size + 1))  # next live position of the word, size at its end
    before = array("q", range(-1, size - 1))  # previous live position, -1 at its start
    for start, end in zip(ends, ends[1:]):
        before[start] = -1
        after[end - 1] = size
    # the inverted index: rank of the merged token, hence the pair's token, to positions of its left half
    index: dict[int, list[int]] = {}
    rank_of = ranks.get
    for i in range(size):
        j = after[i]
        if j != size and (r := rank_of(part[i] + part[j])) is not None:
            (index.get(r) or index.setdefault(r, [])).append(i)
    queue = list(index)
    heapify(queue)
    while queue:
        rank = heappop(queue)
        places = index.pop(rank, None)
        if places is None:
            continue
        merged = token[rank]
        places.sort()
        for k, i in enumerate(places):
            left = part[i]
            j = after[i]
            # stale if either half has been merged otherwise since it was noted
            if not left or j == size or left + part[j] != merged:
                continue
            part[i], part[j] = merged, b""
            n = after[i] = after[j]
            lowest = rank
            if n != size:
                before[n] = i
                if (r := rank_of(merged + part[n])) is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        heappush(queue, r)
                    lowest = min(lowest, r)
            p = before[i]
            if p >= 0 and (r := rank_of(part[p] + merged)) is not None:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heappush(queue, r)
                lowest = min(lowest, r)
            if lowest < rank:  # a lower pair has come up: it goes first, the rest of this one waits
                rest = places[k + 1:]
                if rest:
                    index[rank] = rest
                    heappush(queue, rank)
                break
    ids = [ranks[p] if p else -1 for p in part]
    return [[t for t in ids[a:b] if t >= 0] for a, b in zip(ends, ends[1:])]


class Words(dict):
    """Numbers words as they are met and lists the new ones."""

    def __init__(self) -> None:
        self.new: list[bytes] = []
        self.new_bytes = 0

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word.encode("utf-8", "surrogatepass"))
        self.new_bytes += len(self.new[-1])
        return number


class Encoder:
    """Collects the words of texts and encodes those that are new by one replay."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.find = ranks, regex.compile(pattern)
        self.tokens = {r: t for t, r in ranks.items()}
        self.clear()

    def clear(self) -> None:
        self.words = Words()
        #: What each word adds to a text: number of tokens, ids as text, bytes of the ids.
        self.count: list[int] = []
        self.ids: list[str] = []
        self.bytes: list[bytes] = []

    def numbers(self, text: str | None) -> array:
        """The numbers of a text's matches."""
        out = array("i")
        if not text:
            return out
        number = self.words.__getitem__
        if len(text) <= LONG_TEXT:
            out.extend(map(number, self.find.findall(text)))
            return out
        found = (m.group() for m in self.find.finditer(text))
        while piece := list(islice(found, 1 << 16)):
            out.extend(map(number, piece))
        return out

    def settle(self) -> None:
        """Encode the words met since the last time."""
        new = self.words.new
        whole = [self.ranks.get(w) for w in new]
        others = iter(replay([w for w, r in zip(new, whole) if r is None], self.ranks, self.tokens))
        for rank in whole:
            own = next(others) if rank is None else [rank]
            self.count.append(len(own))
            self.ids.append(" ".join(map(str, own)))
            self.bytes.append(b"".join([self.tokens[t] for t in own]))
        self.words.new, self.words.new_bytes = [], 0


def blocks(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.RecordBatch, list[array]]]:
    """Pieces of the batches with their texts' word numbers, once the encoder has settled the words."""
    held: list[tuple[pa.RecordBatch, list[array]]] = []
    matches = 0
    for batch in batches:
        start, numbers = 0, []
        for row, text in enumerate(batch.column(1)):
            numbers.append(encoder.numbers(text.as_py()))
            matches += len(numbers[-1])
            if encoder.words.new_bytes > BLOCK_BYTES or matches > BLOCK_WORDS:
                held.append((batch.slice(start, row + 1 - start).select([0]), numbers))
                encoder.settle()
                yield from held
                held, start, numbers, matches = [], row + 1, [], 0
                if len(encoder.words) > KEPT_WORDS:
                    encoder.clear()
        if numbers:
            held.append((batch.slice(start).select([0]), numbers))
    encoder.settle()
    yield from held


def encode(
    docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] | None = None, pattern: str = PATTERN, digests: bool = True
) -> DataFrame:
    """``(row, n_tokens, ids, decoded)`` for every row; ``row`` holds the columns ``carry``, all if none are named.

    ``decoded`` are the bytes of the ids. With ``digests`` both are given as SHA-256 of the ids as decimals joined by one
    blank, and of the bytes; otherwise as they are. The vocabulary (about 1 MB) goes to the executors as one broadcast.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, pattern)
        for rows, numbers in blocks(batches, encoder):
            sizes = [sum(map(encoder.count.__getitem__, mine)) for mine in numbers]
            said = (" ".join(map(encoder.ids.__getitem__, mine)) for mine in numbers)
            heard = (b"".join(map(encoder.bytes.__getitem__, mine)) for mine in numbers)
            if digests:
                ids = pa.array([sha256(v.encode()).hexdigest() for v in said], pa.string())
                decoded = pa.array([sha256(v).hexdigest() for v in heard], pa.string())
            else:
                ids = pa.array([list(map(int, v.split())) for v in said], pa.list_(pa.int32()))
                decoded = pa.array(list(heard), pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), ids, decoded], names=["row", "n_tokens", "ids", "decoded"])

    source = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col(text).alias("text"))
    ids, decoded = ("string", "string") if digests else ("array<int>", "binary")
    schema = source.select(
        "row", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast(ids).alias("ids"), F.lit(None).cast(decoded).alias("decoded")
    ).schema
    return source.mapInArrow(run, schema)


def digest_columns(coded: DataFrame) -> DataFrame:
    """``(row, n_tokens, ids_sha256, decoded_sha256)`` of what ``encode`` gives with digests."""
    return coded.select("row", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The table with a further column ``text_bytes``: the bytes of a list of ids; null for a null list."""
    spark = coded.sparkSession
    tokens = spark.sparkContext.broadcast({r: t for t, r in read_ranks(path).items()})
    schema = coded.withColumn("text_bytes", F.lit(None).cast("binary")).schema
    at = coded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.value
        for batch in batches:
            made = [None if v is None else b"".join([table[t] for t in v]) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=schema.names)

    return coded.mapInArrow(run, schema)
