"""Spelling variants of the corpus's words by PartEnum signatures.

A word's letters are a multiset, written as a binary vector: one dimension for each letter and each number of times it
occurs. Words one insertion, deletion or replacement apart have vectors at Hamming distance one or two. PartEnum cuts the
dimensions into parts and enumerates: of PARTS parts at most as many differ as there are differing dimensions, so two
words within the distance agree on all parts but that many. Each choice of the parts left over, with the letters in them, is
a signature; equal signatures meet in an equi-join and the pair is verified.

Two exact facts make the buckets small. Words of one length can only differ by a replacement (distance two), words of
neighbouring lengths by an insertion (distance one), so the lengths are part of a signature. And one edit leaves either
the first or the last half of the shorter word as it is, so that half is part of it too, and every signature is sent with
either half. Buckets are joined with the verification as part of the join condition, so only near pairs leave the join.

Nothing is broadcast: Spark sizes the signatures by the table of words that they come from, one fortieth of their rows, and
stored words by their compressed files; so the joins ask for a sort and merge, whatever the threshold.

Definitions:
* a null text has no runs, a null id is the empty text in the hash, repeated rows count again; texts of any length are read;
* a word is near another if it differs by exactly one code point inserted, deleted or replaced, so never to itself;
* of near words with the same largest count the form is the smallest in code-point order;
* the root follows forms to the last one; counts at least double on the way, so there are no rings;
* other columns are not read, so their names cannot clash; an empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewell.llm.base import LOWER_BYTES, stored

#: Parts of the dimensions; with PARTS = 5 a replacement leaves 3 of 5 parts equal (10 signatures), an insertion 4 (5).
PARTS = 5
#: Distinct words that a task holds before it sends their counts.
HELD = 200_000
LONG_TEXT = 1 << 20
LEAST_LENGTH, LEAST_COUNT, NOISE = 5, 3, 97
RUN = re.compile("[a-zÀ-ÿ]+")


def read_words(key: str, text: str, least: int, noise: int) -> Iterator[tuple[str, int]]:
    """Words of one text with their counts: runs of letters, one letter dropped where the hash of id and run says so."""
    low = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).decode("utf-8", "surrogatepass")
    runs = Counter(RUN.findall(low)) if len(low) <= LONG_TEXT else Counter(m.group() for m in RUN.finditer(low))
    start = zlib.crc32(f"{key}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= least:
            yield run, n


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT, noise: int = NOISE
) -> DataFrame:
    """``(word, n)`` of the corpus's words of ``least`` or more code points with ``count`` or more occurrences; tasks send sums."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, body in zip(batch.column(0), batch.column(1)):
                body = body.as_py()
                if body:
                    for word, n in read_words(doc.as_py() or "", body, least, noise):
                        seen[word] += n
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        yield out()

    source = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return source.mapInArrow(read, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def letter_parts(words: DataFrame, parts: int) -> dict[str, int]:
    """Part of each letter, so that the parts hold about as many letters of the words; an alphabet is bounded, so it is collected.

    Letters go, most frequent first, to the part with the fewest so far. All dimensions of one letter share a part.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    load, part = [0] * parts, {}
    for r in sorted(letters.collect(), key=lambda r: (-r["n"], r["c"])):
        least = load.index(min(load))
        part[r["c"]] = least
        load[least] += r["n"]
    return part


def signatures(words: DataFrame, part: dict[str, int], parts: int = PARTS) -> DataFrame:
    """``(sig, side, word, n)``: 64-bit signatures; ``side`` is 0 for replacements, 1 and 2 for the shorter and the longer
    word of an insertion. A 64-bit clash only adds a pair that the verification drops.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, one = list(combinations(range(parts), parts - 2)), list(combinations(range(parts), parts - 1))
        for batch in batches:
            sig, side, at = [], [], []
            for row, word in enumerate(batch.column(0).to_pylist()):
                held: list[list[str]] = [[] for _ in range(parts)]
                for c in sorted(word):
                    held[part[c]].append(c)
                # letters of a part in order are its dimensions: the second "e" stands after the first
                text = ["".join(h) for h in held]
                for kind, short, chosen in ((0, len(word), two), (1, len(word), one), (2, len(word) - 1, one)):
                    half = short // 2
                    ends = (f"{short}|{min(kind, 1)}<{word[:half]}", f"{short}|{min(kind, 1)}>{word[len(word) - half:]}")
                    for turn, which in enumerate(chosen):
                        letters = f"|{turn}|" + "|".join([text[p] for p in which])
                        for end in ends:
                            sig.append(end + letters)
                            side.append(kind)
                            at.append(row)
            index = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig, pa.string()), pa.array(side, pa.int8()), batch.column(0).take(index), batch.column(1).take(index)],
                names=["sig", "side", "word", "n"],
            )

    return words.mapInArrow(sign, "sig string, side byte, word string, n long").select(F.xxhash64("sig").alias("sig"), "side", "word", "n")


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``(word, other, m)`` for every ordered pair of near words; ``m`` is the count of ``other``."""
    signed = signatures(words, letter_parts(words, parts), parts)
    left, right = (signed.select("sig", "side", F.col("word").alias(w), F.col("n").alias(n)) for w, n in (("a", "an"), ("b", "bn")))
    one_edit = F.levenshtein("a", "b", 1) == 1
    same = left.filter("side = 0").join(right.filter("side = 0").drop("side").hint("merge"), "sig").filter((F.col("a") < F.col("b")) & one_edit)
    longer = left.filter("side = 1").join(right.filter("side = 2").drop("side").hint("merge"), "sig").filter(one_edit)
    found = same.select("a", "an", "b", "bn").unionByName(longer.select("a", "an", "b", "bn")).distinct()
    turned = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("m")),
                               F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("m"))))
    return found.select(turned.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for every word that has a form; ``forms`` has ``(word, form)``. Each turn doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(
            now.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "variants-roots",
        )
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(counted: DataFrame, ratio: int = 2, parts: int = PARTS) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of the words ``(word, n)``: the near word of largest count, if that is at least
    ``ratio`` (above 1) times the word's own, is its form."""
    words = stored(counted.select("word", "n"), "variants-words")
    # a struct's least value: largest count first, then the smallest word
    best = near_pairs(words, parts).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("b"))
    named = stored(
        words.join(best.hint("merge"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(-F.col("b.m") >= ratio * F.col("n"), F.col("b.other")).alias("form"),
            F.when(-F.col("b.m") >= ratio * F.col("n"), -F.col("b.m")).alias("form_n"),
        ),
        "variants-forms",
    )
    return named.join(roots(named.filter("form is not null")).hint("merge"), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )

