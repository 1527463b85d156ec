"""Toxicity by compression distance: two zstandard dictionaries and calibrated window lengths.

A bounded sample of labelled texts gives two raw-content dictionaries that share a background of ordinary text. The rest
of each is cut from the texts of its class: stretches whose byte runs occur in more documents of the class than chance
and the other class explain. Every window of a text is compressed with both; the ordinary length minus the toxic length
is the window's excess. The share of windows at each excess, with the largest one, is calibrated by logistic regression
on the half of the sample that gave no dictionary, corrected to the class sizes of all training labels.

Definitions:
* every window of every text is scored; a null or empty text is one empty window and gets a score like any other;
* labels of one document that contradict each other count as toxic; null labels, and labels of null ids, count for nothing;
* without training labels of both classes nothing is known and every score is 0;
* every row gives one row, repeated rows included; other columns travel in a struct and cannot clash;
* an empty table of documents gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from base64 import b64decode, b64encode
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewell.llm.base import LOWER_BYTES, held_out, stored

#: Bounds of the training sample: texts of each class, and characters of a text in it.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 2500, 3500, 20_000
WINDOW, LEVEL = 8, 3
BACKGROUND, CLASS_BYTES, RUN = 24_000, 4096, 5
EXCESS = 10
SEED = 11


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def windows_of(text: str | None) -> list[bytes]:
    words = words_of(text)
    return [b" ".join(words[i:i + WINDOW]) for i in range(0, max(1, len(words)), WINDOW)]


def runs_of(body: bytes) -> np.ndarray:
    """Every run of RUN bytes as a number."""
    a = np.frombuffer(body, np.uint8).astype(np.uint64)
    n = max(0, len(a) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for i in range(RUN):
        out = (out << np.uint64(8)) | a[i:i + n]
    return out


def document_counts(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs and the number of documents that have them."""
    runs, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for at in range(0, len(bodies), 250):  # folded in steps, so that memory follows the distinct runs
        new, n = np.unique(np.concatenate([np.unique(runs_of(b)) for b in bodies[at:at + 250]]), return_counts=True)
        both, place = np.unique(np.concatenate((runs, new)), return_inverse=True)
        runs, counts = both, np.bincount(place, np.concatenate((counts, n)), len(both)).astype(np.int64)
    return runs, counts


def contrast(own: tuple, n_own: int, other: tuple, n_other: int) -> dict[int, float]:
    """Weight of the runs that a class has more often than chance and at least three times as often as the other."""
    runs, counts = own
    at = np.minimum(np.searchsorted(other[0], runs), len(other[0]) - 1)
    theirs = np.where(other[0][at] == runs, other[1][at], 0)
    f_own, f_other, f = counts / n_own, theirs / n_other, (counts + theirs) / (n_own + n_other)
    z = (f_own - f_other) / np.sqrt(f * (1 - f) * (1 / n_own + 1 / n_other) + 1e-12)
    good = (z > 5) & (f_own > 3 * f_other)
    return dict(zip(runs[good].tolist(), (f_own - f_other)[good].tolist()))


def stretches(bodies: list[bytes], weight: dict[int, float], size: int, least: float = 0.02) -> list[bytes]:
    """Stretches of weighted runs, best per byte first; a run counts only in the first stretch that has it."""
    known = np.array(sorted(weight), np.uint64)
    if not len(known):
        return []
    seen: Counter = Counter()
    for body in bodies:
        runs = runs_of(body)
        if len(runs):
            at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
            edge = np.flatnonzero(np.diff(np.concatenate(([False], known[at] == runs, [False])).astype(np.int8)))
            seen.update(body[a:b + RUN - 1] for a, b in edge.reshape(-1, 2).tolist())
    left, best, out, used = dict(weight), 0.0, [], 0

    def value(s: bytes) -> float:
        return sum(left.get(r, 0.0) for r in set(runs_of(s).tolist())) / len(s)

    heap = [(-value(s), s) for s in seen]
    heapq.heapify(heap)
    while heap and used < size:
        _, s = heapq.heappop(heap)
        now = value(s)
        if heap and now < -heap[0][0] - 1e-12:
            if now > 0:
                heapq.heappush(heap, (-now, s))
            continue
        best = best or now
        if now < least * best:
            break
        out.append(s)
        used += len(s)
        for r in runs_of(s).tolist():
            left[r] = 0.0
    return out


class Distance:
    """Window lengths under both dictionaries, turned into features of a text."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.by = [
            zstandard.ZstdCompressor(
                level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False,
                dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            ).compress
            for d in (toxic, ordinary)
        ]

    def features(self, text: str | None) -> np.ndarray:
        toxic, ordinary = self.by
        excess = np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in windows_of(text)), np.int64)
        n = len(excess)
        counts = np.bincount(np.clip(excess, 0, EXCESS), minlength=EXCESS + 1)[1:]
        tail = counts[::-1].cumsum()[::-1]
        return np.concatenate((
            np.log1p(tail), np.minimum(1.0, 20 * tail / n), [min(excess.max(), EXCESS) / EXCESS, np.log(n) / 5, *np.clip([10 * excess.mean(), excess.sum() / np.sqrt(n)], -10, 10)],
        ))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + keep * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], toxic: list[int], n_toxic: int, n_ordinary: int) -> dict | None:
    """The model of a sample: both dictionaries, feature scale and weights. ``n_*``: class sizes of all training labels."""
    rng = np.random.default_rng(SEED)
    unique = sorted(set(zip(texts, toxic)))
    order = rng.permutation(len(unique))
    halves: dict[tuple[int, int], list[str]] = {(h, c): [] for h in (0, 1) for c in (0, 1)}
    for turn, i in enumerate(order.tolist()):
        text, label = unique[i]
        halves[(0 if turn % 5 < 3 else 1, label)].append(text)
    if not all(halves.values()):
        return None
    body = {c: [b" " + b" ".join(words_of(t)) + b" " for t in halves[(0, c)]] for c in (0, 1)}
    counts = {c: document_counts(body[c]) for c in (0, 1)}
    if not all(len(counts[c][0]) for c in (0, 1)):
        return None
    part = {c: stretches(body[c], contrast(counts[c], len(body[c]), counts[1 - c], len(body[1 - c])), CLASS_BYTES) for c in (0, 1)}
    lines = [w for t in halves[(0, 0)] for w in windows_of(t)]
    lines = [lines[i] for i in rng.permutation(len(lines))[:60_000]]
    try:
        shared = zstandard.train_dictionary(BACKGROUND, lines, k=32, d=6).as_bytes()[512:]
    except zstandard.ZstdError:  # too little text to train on: the lines themselves
        shared = b" ".join(lines)[:BACKGROUND]
    own = {c: b"".join(reversed(part[c])) for c in (0, 1)}
    long = max(8, *map(len, own.values()))
    toxic_dict, ordinary_dict = (bytes(long - len(own[c])) + own[c] + shared for c in (1, 0))
    distance = Distance(toxic_dict, ordinary_dict)
    x = np.array([distance.features(t) for c in (0, 1) for t in halves[(1, c)]])
    y = np.array([c for c in (0, 1) for _ in halves[(1, c)]])
    w = logistic(x, y)
    w[-1] += np.log((n_toxic / n_ordinary) / (y.sum() / (len(y) - y.sum())))
    return {"toxic": b64encode(toxic_dict).decode(), "ordinary": b64encode(ordinary_dict).decode(), "weights": w.tolist()}


def labelled(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """One row per labelled id of the training folds."""
    named = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(5, 0, key))
    return named.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> dict | None:
    """Train on the bounded sample in one task; the model is two small dictionaries and some weights.

    The sample has the ids of each class that come first by a hash, among texts of at most SAMPLE_CHARS characters; ids
    are chosen without their texts.
    """
    short = docs.filter(F.length(text) <= SAMPLE_CHARS).select(F.col(key).alias("key"), F.col(text).alias("text"))
    chosen = labelled(labels, key)
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    there = stored(chosen.join(short.select("key"), "key", "left_semi").withColumn("turn", F.xxhash64("key", F.lit(SEED))), "toxicity-ids")
    ids = there.filter("toxic = 1").orderBy("turn", "key").limit(SAMPLE_TOXIC)
    ids = ids.unionByName(there.filter("toxic = 0").orderBy("turn", "key").limit(SAMPLE_ORDINARY))
    sample = short.join(F.broadcast(ids.select("key", "toxic")), "key").groupBy("key", "toxic").agg(F.min("text").alias("text"))
    n_toxic, n_ordinary = sizes[1], sizes[0]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        marks: list[int] = []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(train(texts, marks, n_toxic, n_ordinary))])], names=["model"])

    row = sample.select("text", "toxic").coalesce(1).mapInArrow(learn, "model string").first()
    return json.loads(row["model"]) if row else None


def score(docs: DataFrame, model: dict | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``(row, score)`` for every row of ``docs``; one pass, no shuffle. Labels and ids play no part."""
    source = docs.select(F.struct(*(docs.columns if carry is None else carry)).alias("row"), F.col(text).alias("text"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(b64decode(model["toxic"]), b64decode(model["ordinary"])) if model else None
        w = np.array(model["weights"]) if model else None
        for batch in batches:
            if model:
                x = [distance.features(t.as_py()) @ w[:-1] + w[-1] for t in batch.column(1)]
                p = 1 / (1 + np.exp(-np.clip(np.array(x), -30, 30)))
            else:
                p = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["row", "score"])

    schema = source.select("row", F.lit(0.0).alias("score")).schema
    return source.mapInArrow(rate, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score stays under ``limit``; same columns."""
    return score(docs, fit(docs, labels, key, text), text).filter(F.col("score") < limit).select("row.*")
