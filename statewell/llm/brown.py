"""Language-model scores from Brown classes: exchange clustering, class transitions, word emissions.

Words are counted over all training texts; then every text is stored as numbers, which the later passes read. Words with at least a set share of all tokens are clustering units of their
own, the others share units by their ending; the number of units is bounded by that share. Unit bigrams are counted over
all training texts. Exchange moves units between classes while the likelihood of the class bigrams grows.

Words of at least another, smaller share travel to the tasks with their counts, again bounded in number by the share.
Each of them that was no unit of its own and was seen often enough then leaves its ending for the class that makes the classes seen to its left and
right likeliest, counted over all training texts. Transitions are counted again with these classes. The words left meet
their counts in a join and stay with their ending.

A token's probability is class transition times word in class (of the words left: ending in class times word in ending),
each smoothed, so that the words of a class, its endings and one place for unseen words in each ending sum to 1.

Definitions:
* a null text is an empty one, with the end as its only token; every row gives one row, repeated rows included;
* a null id counts as the empty text for the fold; only id and text are read, so other columns cannot clash;
* without training tokens every probability is that of the base, which is 1 a token; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewell.llm.base import LOWER_BYTES, stored

CLASSES, ENDINGS, SWEEPS = 64, 256, 10
#: A word with 1/UNIT_SHARE of all tokens is a unit of its own, one with 1/KNOWN_SHARE travels with its count; at most so many can.
UNIT_SHARE, KNOWN_SHARE = 10_000, 2_000_000
#: A word seen fewer times says too little about its neighbours to leave its ending.
FEW = 3
HELD = 200_000
#: Bigrams that a task holds before it folds them into its sums, and sums before it sends them.
FOLD, SUMS = 500_000, 1_500_000
END = b""
#: Code of an end without training tokens.
AWAY = -1 - ENDINGS


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def ending(word: bytes) -> int:
    """Which of the shared units a word belongs to: a hash of its last three bytes."""
    return zlib.crc32(word[-3:]) % ENDINGS


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, c)`` over one text column, ends included; tasks send sums, never more than HELD words at once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"]
            )

        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                seen[END] += 1
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        yield out()

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """The words that travel with their counts, and which unit each word has. Unit 0 is the end."""

    def __init__(self, words: list[bytes], counts: list[int], tokens: int):
        self.index = {w: i for i, w in enumerate(words)}
        own = {w: i for i, w in enumerate(sorted(w for w, c in zip(words, counts) if c * UNIT_SHARE >= tokens and w != END), 1)}
        self.first_ending = 1 + len(own)
        self.units = self.first_ending + ENDINGS
        self.unit = np.array([own.get(w, 0 if w == END else self.first_ending + ending(w)) for w in words] or [0], np.int64)
        self.log_count = np.log10(np.array(counts or [0], float) + 0.5)
        self.follows = (self.unit >= self.first_ending) & (np.array(counts or [0]) >= FEW)

    def classes(self, at: np.ndarray, unit: np.ndarray, cls: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token by the classes of units and of words (-1: none of its own), and its ending (-1: none)."""
        given = np.where(at >= 0, own[at], -1)
        ending = np.where((given < 0) & (unit >= self.first_ending), unit - self.first_ending, -1)
        return np.where(given >= 0, given, cls[unit]), ending

    def encode(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """A number for each token, and the words not here; the end comes last.

        It is the index of its word; for the words not here -1 less the ending, and AWAY for an end not here.
        """
        words = words_of(text)
        words.append(END)
        get = self.index.get
        codes = np.fromiter((get(w, AWAY) for w in words), np.int32, len(words))
        away = np.flatnonzero(codes < 0)
        others = [words[i] for i in away.tolist()]
        if others:
            codes[away] = [-1 - ending(w) if w else AWAY for w in others]
        return codes, others

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each token's word (-1: not here) and its unit."""
        at = np.maximum(codes, -1).astype(np.int64)
        unit = np.where(codes >= 0, self.unit[at], np.where(codes == AWAY, 0, self.first_ending - 1 - codes.astype(np.int64)))
        return at, unit


def encode(docs: DataFrame, shipped) -> DataFrame:
    """``(key, held_out, codes, rare, rid)`` of ``(key, held_out, text)``: every text's tokens as numbers and its words not in the lexicon.

    Stored, so that texts are cut into words and looked up once for all passes that follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shipped.value)
        for batch in batches:
            codes, ends, away, times, places = [], [0], [], [], [0]

            def out(first: int) -> pa.RecordBatch:
                pairs = pa.StructArray.from_arrays([pa.array(away, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(codes), pa.int32()))
                own = batch.slice(first, len(codes))
                return pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), lists, pa.ListArray.from_arrays(pa.array(places, pa.int32()), pairs)],
                    names=["key", "held_out", "codes", "rare"],
                )

            for i, text in enumerate(batch.column(2)):
                numbers, others = lexicon.encode(text.as_py())
                codes.append(numbers)
                ends.append(ends[-1] + len(numbers))
                rare = Counter(others)
                away += rare.keys()
                times += rare.values()
                places.append(len(away))
                if ends[-1] > FOLD:
                    yield out(i + 1 - len(codes))
                    codes, ends, away, times, places = [], [0], [], [], [0]
            if codes:
                yield out(batch.num_rows - len(codes))

    kind = docs.schema["key"].dataType.simpleString()
    schema = f"key {kind}, held_out boolean, codes array<int>, rare array<struct<word:binary,n:long>>"
    coded = docs.select("key", "held_out", "text").mapInArrow(run, schema)
    return stored(coded.withColumn("rid", F.monotonically_increasing_id()), "lm-encoded")


def whole_texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch as ``(bounds, codes)``, cut between texts after about FOLD tokens."""
    ends = batch.column(column).offsets.to_numpy()
    values = batch.column(column).values.to_numpy(zero_copy_only=False)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + FOLD, "right")) - 1)
        yield ends[first : last + 1] - ends[first], values[ends[first] : ends[last]]
        first = last


def count_codes(encoded: DataFrame, encoder) -> DataFrame:
    """``(code, n)`` over the whole numbers that ``encoder()`` finds in encoded texts, one after another. Tasks send sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, n_held = encoder(), [], 0
        code, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def fold() -> None:
            nonlocal code, n, held, n_held
            new, counts = np.unique(np.concatenate(held), return_counts=True) if held else (code[:0], n[:0])
            both, at = np.unique(np.concatenate((code, new)), return_inverse=True)
            n = np.bincount(at, np.concatenate((n, counts)), len(both)).astype(np.int64)
            code, held, n_held = both, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for _, codes in whole_texts(batch, 0):
                held.append(encode(codes))
                n_held += len(held[-1])
                if n_held > FOLD:
                    fold()
                    if len(code) > SUMS:
                        yield out()
                        code, n = code[:0], n[:0]
        fold()
        yield out()

    return encoded.select("codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def after_end(values: np.ndarray) -> np.ndarray:
    """What stands before each token; a text starts after an end, which is 0, as does the one after it."""
    return np.concatenate(([0], values[:-1]))


def count_bigrams(encoded: DataFrame, shipped, units: int) -> DataFrame:
    """``(a, b, n)`` of neighbouring units."""

    def encoder():
        lexicon = Lexicon(*shipped.value)

        def encode(codes: np.ndarray) -> np.ndarray:
            _, unit = lexicon.places(codes)
            return after_end(unit) * units + unit

        return encode

    return count_codes(encoded, encoder).select(F.expr(f"code div {units}").alias("a"), (F.col("code") % units).alias("b"), "n")


def assign_words(encoded: DataFrame, shipped, model: dict, n_words: int) -> np.ndarray:
    """Class of every travelling word without a unit of its own (else -1), the likeliest one given the classes beside it.

    The gain of class C is the sum over left classes of log P(C | left) less log mass of C, plus that over right
    classes of log P(right | C); ties take the smaller class. What is collected is one number for each such word.
    """
    cls, step, mass = (np.array(model[k]) for k in ("cls", "step", "mass"))
    size = len(mass)

    def encoder():
        lexicon = Lexicon(*shipped.value)

        def encode(codes: np.ndarray) -> np.ndarray:
            at, unit = lexicon.places(codes)
            c = cls[unit]
            free = np.flatnonzero((at >= 0) & lexicon.follows[at])
            first = at[free] * (2 * size)
            # a free word is never the last token, which is the end
            return np.concatenate((first + after_end(c)[free], first + size + c[np.minimum(free + 1, len(c) - 1)]))

        return encode

    gain = np.concatenate((step - np.log10(mass + 0.5), step.T))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beside = batch.column(1).flatten()
            seen = np.zeros((len(batch), 2 * size))
            row = np.repeat(np.arange(len(batch)), np.diff(batch.column(1).offsets.to_numpy()))
            seen[row, beside.field(0).to_numpy()] = beside.field(1).to_numpy()
            total = seen @ gain
            total[:, 0] = -np.inf
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.argmax(total, axis=1), pa.int64())], names=["w", "c"])

    beside = count_codes(encoded, encoder).groupBy(F.expr(f"code div {2 * size}").alias("w")).agg(
        F.collect_list(F.struct((F.col("code") % (2 * size)).alias("slot"), "n")).alias("z")
    )
    chosen = beside.mapInArrow(choose, "w long, c long").toArrow()
    own = np.full(max(n_words, 1), -1, np.int16)
    own[chosen["w"].to_numpy()] = chosen["c"].to_numpy()
    return own


def count_steps(encoded: DataFrame, shipped, classes) -> np.ndarray:
    """Class bigrams of all training texts, at most CLASSES squared of them."""
    size = int(classes.value[0].max()) + 1

    def encoder():
        lexicon = Lexicon(*shipped.value)

        def encode(codes: np.ndarray) -> np.ndarray:
            at, unit = lexicon.places(codes)
            c, _ = lexicon.classes(at, unit, *classes.value)
            return after_end(c) * size + c

        return encode

    table = np.zeros(size * size)
    for r in count_codes(encoded, encoder).collect():
        table[r["code"]] = r["n"]
    return table.reshape(size, size)


def transitions(table: np.ndarray) -> np.ndarray:
    """Smoothed log10 P(class | class before) from class bigrams."""
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * len(table))
    return np.log10((table + share) / (table.sum(1, keepdims=True) + 1))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, units: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every unit. Class 0 is the end's alone; a unit moves to the class that raises the likelihood most."""
    n = n.astype(float)
    count = np.bincount(b, n, units)
    rank = np.argsort(-count[1:], kind="stable") + 1
    others = min(classes - 1, max(1, units - 1))
    cls = np.zeros(units, np.int64)
    cls[rank] = np.arange(len(rank)) % others + 1
    size = others + 1
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    from_a, from_b = np.searchsorted(a[by_a], np.arange(units + 1)), np.searchsorted(b[by_b], np.arange(units + 1))
    right, left = np.zeros((units, size)), np.zeros((units, size))
    np.add.at(right, (a, cls[b]), n)
    np.add.at(left, (b, cls[a]), n)
    own = np.zeros(units)
    own[a[a == b]] = n[a == b]
    table = np.zeros((size, size))
    np.add.at(table, (cls[a], cls[b]), n)
    diag = np.arange(size)
    for _ in range(sweeps):
        moved = 0
        for w in rank.tolist():
            if not count[w]:
                break
            old, s = cls[w], own[w]
            r, l = right[w].copy(), left[w].copy()
            table[old] -= r
            table[:, old] -= l
            table[old, old] += s
            r[old] -= s
            l[old] -= s
            rows, cols = table.sum(1), table.sum(0)
            base = _xlogx(table)
            gain_r = _xlogx(table + r) - base
            gain_l = _xlogx(table + l[:, None]) - base
            gain = gain_r.sum(1) - gain_r[diag, diag] + gain_l.sum(0) - gain_l[diag, diag]
            d = table[diag, diag]
            gain += _xlogx(d + r + l + s) - _xlogx(d)
            n_r, n_l = r.sum() + s, l.sum() + s
            gain -= _xlogx(rows + n_r) - _xlogx(rows) + _xlogx(cols + n_l) - _xlogx(cols)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += r
            table[:, new] += l
            table[new, new] += s
            if new != old:
                moved += 1
                cls[w] = new
                i = by_b[from_b[w]:from_b[w + 1]]
                np.add.at(right, (a[i], old), -n[i])
                np.add.at(right, (a[i], new), n[i])
                i = by_a[from_a[w]:from_a[w + 1]]
                np.add.at(left, (b[i], old), -n[i])
                np.add.at(left, (b[i], new), n[i])
        if moved * 1000 <= len(rank):
            break
    return cls


def learn_classes(bigrams: DataFrame, units: int) -> dict:
    """Classes of units, their transitions in log10 and tokens, from the bounded table of unit bigrams, in one task."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(batch.column(i).to_numpy() for i in range(3)) for batch in batches]
        a, b, n = (np.concatenate(z) for z in zip(*parts))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        cls = exchange(a, b, n, units)
        size = int(cls.max()) + 1
        table = np.zeros((size, size))
        np.add.at(table, (cls[a], cls[b]), n)
        model = {"cls": cls.tolist(), "step": transitions(table).tolist(), "mass": table.sum(0).tolist()}
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model)])], names=["model"])

    return json.loads(bigrams.select("a", "b", "n").coalesce(1).mapInArrow(learn, "model string").first()["model"])


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row; ``train`` marks the rows to learn from."""
    sc = docs.sparkSession.sparkContext
    texts = docs.filter(train).select(F.col(text).alias("text"))
    counts = stored(count_words(texts), "lm-counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # by the pigeonhole principle no more than KNOWN_SHARE words can have that share of all tokens
    travels = (F.col("c") * KNOWN_SHARE >= tokens) | (F.length("word") == 0)
    common = counts.filter(travels)
    known = sorted((bytes(r["word"]), r["c"]) for r in common.toLocalIterator()) if tokens else []
    shipped = sc.broadcast(([w for w, _ in known], [c for _, c in known], tokens))
    lexicon = Lexicon(*shipped.value)
    stays = (F.length("word") > 0) & (F.col("c") * UNIT_SHARE < tokens) & (~travels | (F.col("c") < FEW))
    encoded = encode(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (~train).alias("held_out")), shipped)
    rules = sc.broadcast(learn_encoded(encoded.filter(~F.col("held_out")), counts.filter(stays), shipped, lexicon) if tokens else None)
    floor = float(np.log10(tokens + 0.5 * (kinds + 1)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shipped.value)
        model = rules.value
        for batch in batches:
            n, seen, base, full = [], [], [], []
            for ends, codes in whole_texts(batch, 2):
                at, unit = lexicon.places(codes)
                here = at >= 0
                log_count = lexicon.log_count[at] * here
                if model:
                    c, ending = lexicon.classes(at, unit, model["cls"], model["own"])
                    step, emit = model["step"][after_end(c), c], model["emit"][c]
                for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    size, logs = j - i, float(log_count[i:j].sum())
                    n.append(size)
                    seen.append(int(here[i:j].sum()) if tokens else 0)
                    base.append(logs - size * floor)
                    if model:
                        total = step[i:j].sum() - emit[i:j].sum() + logs
                        own = ending[i:j]
                        full.append(float(total + model["left"][own[own >= 0]].sum()))
                    else:
                        full.append(base[-1])
                    if not tokens:
                        base[-1] = full[-1] = float(size * (np.log10(0.5) - floor))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], batch.column(3), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(full, pa.float64())],
                names=["key", "held_out", "rid", "n_tokens", "n_known", "base", "full"],
            )

    kind = encoded.schema["key"].dataType.simpleString()
    schema = f"key {kind}, held_out boolean, rid long, n_tokens long, n_known long, base double, full double"
    rated = encoded.select("key", "held_out", "codes", "rid").mapInArrow(rate, schema)
    rare = encoded.select("rid", F.inline("rare")).join(counts.filter(~travels), "word", "left")
    c = F.coalesce("c", F.lit(0))
    # exact in any order: counts of tokens by count of the word are whole numbers, only few terms are floats
    late = rare.groupBy("rid").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"))
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return rated.join(late, "rid", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("full") + logs).alias("score"),
    )


def learn(texts: DataFrame, others: DataFrame, shipped, lexicon: Lexicon) -> dict:
    """``learn_encoded`` from plain texts."""
    text = F.col(texts.columns[0])
    return learn_encoded(encode(texts.select(F.lit(0).alias("key"), F.lit(False).alias("held_out"), text.alias("text")), shipped), others, shipped, lexicon)


def learn_encoded(encoded: DataFrame, others: DataFrame, shipped, lexicon: Lexicon) -> dict:
    """The model: classes of units and words, log10 of transitions, of class totals and of each ending's share by place."""
    sc = encoded.sparkSession.sparkContext
    bigrams = stored(count_bigrams(encoded, shipped, lexicon.units), "lm-bigrams")
    first = learn_classes(bigrams, lexicon.units)
    own = assign_words(encoded, shipped, first, len(lexicon.index))
    cls = np.array(first["cls"], np.int64)
    table = count_steps(encoded, shipped, sc.broadcast((cls, own)))
    # members of a class: the end and words with a unit, words assigned, endings
    members = np.bincount(cls, minlength=len(table)) + np.bincount(own[own >= 0], minlength=len(table))
    mass, kinds = ending_mass(others)
    left = np.log10(mass + 0.5) - np.log10(mass + 0.5 * (kinds + 1))
    return {"cls": cls, "own": own, "step": transitions(table), "emit": np.log10(table.sum(0) + 0.5 * members), "left": left}


def ending_mass(others: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and number of the words that do not travel, for each ending."""
    tail = F.substring(F.col("word"), -3, 3)
    last = F.when(F.length("word") < 3, F.col("word")).otherwise(tail)
    mass, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in others.groupBy((F.crc32(last) % ENDINGS).alias("e")).agg(F.sum("c").alias("t"), F.count("*").alias("v")).collect():
        mass[r["e"]], kinds[r["e"]] = r["t"], r["v"]
    return mass, kinds
