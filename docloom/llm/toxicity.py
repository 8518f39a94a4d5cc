"""Toxicity by class-conditional Kneser-Ney models.

A model spells words byte by byte; a byte's context is all of its word before it. The shared model, of
all learned text, is interpolated Kneser-Ney: contexts' counts less an absolute discount, then
continuation counts after the last two bytes, then all bytes alike. A class's model gives what was never seen
in a context the shared probability; for what was, it discounts the class's counts and backs off to the shared
model, with CONCENTRATION occurrences more for it. So a context too rare in a class is left to the shared counts, and
rare and unknown forms of a telling word share what their first bytes tell. Each model sums to one over the bytes and a word's end. As toxic text is mostly ordinary text, a word's
likelihood in a class is SHARED parts that of the shared model and the rest that of the class's. A document's
ratio is the mean of its words' log-likelihood ratios less their median: the median holds what its language
or subject adds to every word. Where the curve's fold sets the threshold, the score is 0.5.

Counts are stored tables of all learned words and their beginnings, and grow with them. A byte's part in a
ratio is a whole multiple of STEP; those of 0 aren't stored. Workers get the others while these fit
BROADCAST_BYTES, else words are joined to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import clear_stored, fits, maybe_broadcast, small_batches, stored, stored_so_far, table, unwrapped, wrapped
from docloom.llm.tokens import BASE, CHUNK, chunks, lowered, mix, text_bytes

#: Bytes of a unit: a longer word is several, each spelled as a word.
UNIT = 24
#: Symbols are the bytes and this, a unit's end.
END = 256
#: A class's model holds the shared one at so many occurrences of a context, besides its discounts.
CONCENTRATION = 50.0
#: Part of the shared model in a word's likelihood.
SHARED = 0.99
#: Logarithms that are stored are whole multiples of this.
STEP = 1 / 16
#: Of the five folds by crc32(doc_id): one is never learned from, one sets the threshold, three are counted.
FOLDS, CURVE_FOLD = 5, 4
#: The threshold minimises the share of toxic rows missed and so many times the share of ordinary rows rejected.
CLEAN_COST = 4
#: Ratios are counted for the curve in bins of this width, so many on each side of 0.
BIN, BINS = 2.0**-17, 1 << 14
#: Distinct units held by a worker before it hands them on.
HELD = 1 << 20
#: Bytes of the model that a worker may get; an entry has ENTRY bytes.
BROADCAST_BYTES, ENTRY = 64 * 1024 * 1024, 16
#: The hash of a unit's beginning times this plus a symbol, mixed, is the key of both.
PAIR = np.uint64(0xD6E8FEB86659FD93)
ROOT = np.uint64(BASE)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(-1)).cast("int")


class Model(NamedTuple):
    signals: DataFrame  # stored (key, k0, k1): hash of a context and symbol; logs of the classes' to the shared probability, in STEPs


class Curve(NamedTuple):
    threshold: float | None  # None where nothing was learned: then no text is rejected
    slope: float


def units(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows, or parts of one long row: first row, end row, the units as rows of UNIT bytes, and n + 1 offsets of the rows' units."""
    data, offsets = text_bytes(column)
    for i, j in chunks(offsets):
        a, end = offsets[i], offsets[j]
        while True:
            b = a + CHUNK if end - a > 2 * CHUNK else end
            while b < end and lowered(data[b : b + 1])[0]:  # a part ends between words
                gaps = np.flatnonzero(lowered(data[b : min(b + CHUNK, end)]) == 0)
                b = b + int(gaps[0]) if len(gaps) else min(b + CHUNK, end)
            at = np.clip(offsets[i : j + 1], a, b) - a
            yield i, j, *_units(lowered(data[a:b]), at)
            a = b
            if a >= end:
                break


def _units(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    if not n:
        return np.zeros((0, UNIT), np.uint8), np.zeros(len(at), np.int64)
    word, edge = x != 0, np.zeros(n + 1, bool)
    edge[at] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    pieces = -(-(ends - starts) // UNIT)
    before = np.cumsum(pieces) - pieces
    starts = np.repeat(starts, pieces) + UNIT * (np.arange(pieces.sum()) - np.repeat(before, pieces))
    length = np.minimum(np.repeat(ends, pieces) - starts, UNIT)
    place = np.arange(UNIT)
    found = x[np.minimum(starts[:, None] + place, n - 1)]
    found[place >= length[:, None]] = 0
    return found, np.searchsorted(starts, at)


def distinct(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct units, where each is first, and each unit's place among them."""
    h = np.full(len(found), ROOT)
    for part in found.view(np.uint64).T:
        h = mix(h * np.uint64(BASE) + part)
    return np.unique(h, return_index=True, return_inverse=True)


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    key, found, n0, n1 = (np.concatenate(x) for x in zip(*parts, strict=True))
    key, first, at = np.unique(key, return_index=True, return_inverse=True)
    return key, found[first], *(np.bincount(at, n, len(key)).astype(np.int64) for n in (n0, n1))


def three(found: np.ndarray) -> list[pa.Array]:
    return [pa.array(x) for x in np.ascontiguousarray(found).view(np.int64).T]


def matrix(batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
    """The units whose bytes three long columns hold, from the given one on."""
    return np.stack([batch.column(first + k).to_numpy() for k in range(3)], 1).view(np.uint8).reshape(-1, UNIT)


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, toxic) to (a, b, c, n0, n1): the units' bytes and their counts by class."""

    def out(held):
        _, found, n0, n1 = held
        return pa.record_batch([*three(found), pa.array(n0), pa.array(n1)], names=["a", "b", "c", "n0", "n1"])

    parts: list = []
    for batch in batches:
        toxic = np.asarray(batch.column(1).to_pylist(), bool)
        for i, j, found, at in units(batch.column(0)):
            label = np.repeat(toxic[i:j], np.diff(at))
            key, first, place = distinct(found)
            parts.append((key, found[first], *(np.bincount(place, x, len(key)).astype(np.int64) for x in (~label, label))))
        if sum(len(p[0]) for p in parts) > HELD:
            parts = [merged(parts)]
            if len(parts[0][0]) > HELD // 2:
                yield out(parts[0])
                parts = []
    if parts:
        yield out(merged(parts))


def spelled(found: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each place in a unit: the place, the units that reach it, hashes of what stands before it, and its symbols."""
    length = (found != 0).sum(1)
    at, before = np.arange(len(found)), np.full(len(found), ROOT)
    for k in range(UNIT + 1):
        symbol = np.where(length[at] > k, found[at, min(k, UNIT - 1)].astype(np.int64), END)
        yield k, at, before, symbol
        on = symbol != END
        at, before = at[on], mix(before[on] * np.uint64(BASE) + symbol[on].astype(np.uint64) + np.uint64(1))


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (a, b, c, n0, n1) to (context, tail, symbol, n0, n1): tail has the context's last two bytes."""
    for batch in batches:
        found, n = matrix(batch), [batch.column(k).to_numpy() for k in (3, 4)]
        for k, at, before, symbol in spelled(found):
            if not len(at):
                break
            key, first, place = np.unique(pair(before, symbol), return_index=True, return_inverse=True)
            tail = sum(found[at[first], k - 1 - b].astype(np.int32) << 8 * b for b in range(min(k, 2))) + np.zeros(len(first), np.int32)
            yield pa.record_batch(
                [pa.array(before[first].view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(symbol[first].astype(np.int32)), *(pa.array(np.bincount(place, x[at], len(key)).astype(np.int64)) for x in n)],
                names=["context", "tail", "symbol", "n0", "n1"],
            )


def pair(before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix(before * PAIR + symbol.astype(np.uint64))


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (context, symbol, k0, k1) to (key, k0, k1)."""
    for batch in batches:
        key = pair(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy())
        yield pa.record_batch([pa.array(key.view(np.int64)), batch.column(2), batch.column(3)], names=["key", "k0", "k1"])


def discount(counts: DataFrame, column: Column) -> float:
    """The absolute discount by counts of counts: n1 / (n1 + 2 n2); 0.5 where no count is 1."""
    once, twice = counts.agg(F.count_if(column == 1), F.count_if(column == 2)).first()
    return once / (once + 2 * twice) if once else 0.5


def fit(rows: DataFrame) -> Model:
    """The model of rows(text, toxic); without rows of both classes it tells no text from another."""
    mark, n = stored_so_far(), F.col("n0") + F.col("n1")
    sums = [F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)]
    words = rows.mapInArrow(counter, "a long, b long, c long, n0 long, n1 long").groupBy("a", "b", "c").agg(*sums)
    counts = words.mapInArrow(grams, "context long, tail int, symbol int, n0 long, n1 long").groupBy("context", "symbol").agg(F.max("tail").alias("tail"), *sums)
    counts = stored(counts, "grams")
    both, cuts = discount(counts, n), [discount(counts, F.col(f"n{c}")) for c in (0, 1)]
    follow = stored(counts.groupBy("tail", "symbol").agg(F.count("*").alias("types")), "continuations")
    cut, after = discount(follow, F.col("types")), Window.partitionBy("tail")
    left = F.sum(F.least("types", F.lit(cut))).over(after)
    follow = follow.select("tail", "symbol", ((F.col("types") - F.least("types", F.lit(cut)) + left / (END + 1)) / F.sum("types").over(after)).alias("next"))
    at = Window.partitionBy("context")
    rows = counts.join(maybe_broadcast(follow, 24), ["tail", "symbol"])
    rows = rows.withColumn("shared", (n - F.least(n, F.lit(both)) + F.sum(F.least(n, F.lit(both))).over(at) * F.col("next")) / F.sum(n).over(at))
    rows = rows.withColumns({f"{x}{c}": F.sum(y).over(at) for c in (0, 1) for x, y in (("all", F.col(f"n{c}")), ("cut", F.least(f"n{c}", F.lit(cuts[c]))))})
    rows = rows.withColumn("seen", F.col("shared") / F.sum("shared").over(at))  # among the symbols seen in the context
    total = [F.col(f"all{c}") + CONCENTRATION for c in (0, 1)]
    likelihood = [(F.col(f"n{c}") - F.least(f"n{c}", F.lit(cuts[c])) + (F.col(f"cut{c}") + CONCENTRATION) * F.col("seen")) / total[c] for c in (0, 1)]
    rows = rows.select("context", "symbol", *(F.round(F.log(likelihood[c] / F.col("seen")) / STEP).cast("short").alias(f"k{c}") for c in (0, 1))).where("k0 <> 0 OR k1 <> 0")
    signals = stored(rows.mapInArrow(keyed, "key long, k0 short, k1 short"), "signals")
    clear_stored(signals.sparkSession, mark, keep_last=True)  # the counts have served
    return Model(signals)


class Lookup:
    """Sorted keys and their values; what is not there has 0."""

    def __init__(self, signals: pa.Table):
        keys = signals["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.stack([signals[k].to_numpy()[order] for k in ("k0", "k1")]).astype(np.int16)
        self.maybe = np.zeros(1 << 22, bool)  # by the first bits of a key: most keys are not there
        self.maybe[keys >> np.uint64(42)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are there, and where these are."""
        at = np.flatnonzero(self.maybe[keys >> np.uint64(42)])
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[place] == keys[at] if len(at) else np.zeros(0, bool)
        return at[hit], place[hit]

    def __call__(self, found: np.ndarray) -> np.ndarray:
        """Log-likelihood ratios of units."""
        told = np.zeros((2, len(found)), np.int32)
        if len(self.keys):
            for _, at, before, symbol in spelled(found):
                if not len(at):
                    break
                there, place = self.find(pair(before, symbol))
                told[:, at[there]] += self.values[:, place]
        less, more = np.log(SHARED + (1 - SHARED) * np.exp(told * STEP))
        return more - less


def ratios(lookup: Lookup, column: pa.Array) -> np.ndarray:
    """For each text the mean of its units' log-likelihood ratios less their median; 0 without words."""
    parts: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for i, j, found, at in units(column):
        _, first, place = distinct(found)
        told = lookup(found[first])[place]
        for r in range(i, j):
            if at[r - i + 1] > at[r - i]:
                parts[r].append(told[at[r - i] : at[r - i + 1]])
    whole = (np.concatenate(p) if len(p) > 1 else p[0] if p else np.zeros(1) for p in parts)
    return np.array([x.mean() - np.median(x) for x in whole], float)


def scorer(lookup, names: list[str]):
    """Batches of columns with text first to those named and ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(ratios(lookup.value, batch.column(0)))], names=[*names, "ratio"])

    return run


def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, row) to (row, a, b, c, times): the units of each row; those of one row's parts come part by part."""
    for batch in batches:
        rows = batch.column(1).to_numpy()
        for i, j, found, at in units(batch.column(0)):
            key, first, place = distinct(found)
            row = np.repeat(np.arange(i, j), np.diff(at))
            both, times = np.unique(row * len(key) + place, return_counts=True)
            for a in range(0, len(both), HELD):
                part = both[a : a + HELD]
                yield pa.record_batch([pa.array(rows[part // len(key)]), *three(found[first[part % len(key)]]), pa.array(times[a : a + HELD])], names=["row", "a", "b", "c", "times"])


def steps_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (a, b, c) to (a, b, c, key): the keys of each unit's symbols in their contexts."""
    for batch in batches:
        for _, at, before, symbol in spelled(matrix(batch)):
            if not len(at):
                break
            yield pa.record_batch([*(batch.column(k).take(pa.array(at)) for k in range(3)), pa.array(pair(before, symbol).view(np.int64))], names=["a", "b", "c", "key"])


def with_ratio(rows: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """The named columns of rows(text, ...), of which text comes first, with ratio."""
    if fits(model.signals, ENTRY, BROADCAST_BYTES):
        lookup = rows.sparkSession.sparkContext.broadcast(Lookup(model.signals.toArrow()))
        return rows.mapInArrow(scorer(lookup, names), T.StructType([*(rows.schema[n] for n in names), T.StructField("ratio", T.DoubleType())]))
    rows = stored(rows.select("text", *(n for n in names if n != "text"), F.monotonically_increasing_id().alias("scored_row")), "texts")
    words = stored(rows.select("text", "scored_row").mapInArrow(asked, "row long, a long, b long, c long, times long"), "asked")
    keys = words.select("a", "b", "c").distinct().mapInArrow(steps_of, "a long, b long, c long, key long")
    told = keys.join(model.signals.hint("merge"), "key", "left").groupBy("a", "b", "c")
    told = told.agg(*(F.log(SHARED + (1 - SHARED) * F.exp(STEP * F.sum(F.coalesce(f"k{c}", F.lit(0))))).alias(f"l{c}") for c in (0, 1)))
    told = words.join(told.select("a", "b", "c", (F.col("l1") - F.col("l0")).alias("told")).hint("merge"), ["a", "b", "c"]).groupBy("row")
    told = told.agg((F.sum(F.col("told") * F.col("times")) / F.sum("times") - F.percentile("told", 0.5, F.col("times"))).alias("ratio"))
    return rows.join(told.hint("merge"), F.col("scored_row") == F.col("row"), "left").select(*names, F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def curve(bins: list[tuple[int, float, int]]) -> Curve:
    """The threshold that costs least, and one over the spread of the ordinary rows, from (toxic, bin, count)."""
    toxic, x, n = (np.asarray(c, float) for c in zip(*bins, strict=True)) if bins else np.zeros((3, 0))
    if len(set(toxic)) < 2:
        return Curve(None, 1.0)
    values = np.unique(x)
    share = [np.bincount(np.searchsorted(values, x[toxic == k]), n[toxic == k], len(values)) / n[toxic == k].sum() for k in (0, 1)]
    cost = np.r_[0, np.cumsum(share[1])] + CLEAN_COST * (1 - np.r_[0, np.cumsum(share[0])])
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    low, high = values[max(best[0] - 1, 0)], values[min(best[-1], len(values) - 1)] + (best[-1] == len(values))
    threshold = low + (high - low) / 4  # of a gap: forms not learned from lie low in it
    spread = np.sqrt((share[0] * (values - (share[0] * values).sum()) ** 2).sum())
    return Curve(float(threshold) * BIN, 1 / max(float(spread) * BIN, BIN))


def learn(documents: DataFrame, labels: DataFrame, folds: tuple[int, ...] = tuple(range(1, FOLDS))) -> tuple[Model, Curve]:
    """The model and its curve, from documents(doc_id, text) with labels(doc_id, toxic) in some folds.

    A null doc_id is in no fold; of several labels of a doc_id the largest holds, null labels don't
    count. Without labels of both classes every score is 0.5 and no document is rejected.
    """
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id"), fold(F.col("doc_id")).alias("fold"), (F.col("toxic") > 0).alias("toxic"))
    known = known.where(F.col("fold").isin(*folds)).groupBy("doc_id", "fold").agg(F.max("toxic").alias("toxic"))
    learned = rows.join(maybe_broadcast(known, 16), "doc_id").select("text", "toxic", "fold")
    model = fit(learned.where(F.col("fold") != CURVE_FOLD).select("text", "toxic"))
    ratio = with_ratio(learned.where(F.col("fold") == CURVE_FOLD).select("text", F.col("toxic").cast("int").alias("toxic")), model, ["toxic"])
    place = F.least(F.greatest(F.round(F.col("ratio") / BIN), F.lit(-BINS)), F.lit(BINS))
    return model, curve(ratio.groupBy("toxic", place.alias("bin")).count().collect())  # 2 * (2 * BINS + 1) rows at most


def scored(rows: DataFrame, learned: tuple[Model, Curve], names: list[str]) -> DataFrame:
    """The named columns of rows(text, ...), of which text comes first, with ratio and score."""
    model, (threshold, slope) = learned
    rows = with_ratio(rows, model, names)
    if threshold is None:
        return rows.withColumn("score", F.lit(0.5))
    return rows.withColumn("score", 1 / (1 + F.exp(-slope * (F.col("ratio") - threshold))))


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, ratio) for every row of documents(doc_id, text); labels(doc_id, toxic).

    A null text is empty; a text without words has ratio 0; a very long text is read in parts; a null doc_id is not
    held out; repeated rows are scored each; other columns are ignored; an empty table gives no rows. For labels see
    learn.
    """
    rows = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "doc_id")
    rows = scored(rows, learn(documents, labels), ["doc_id"])
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "ratio")


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents, with all their columns, that are not predicted to be toxic; all, where nothing was learned."""
    learned = learn(documents, labels)
    if learned[1].threshold is None:
        return documents
    rows = scored(wrapped(documents), learned, ["text", "document"])
    return unwrapped(rows.where("score < 0.5"), documents.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
