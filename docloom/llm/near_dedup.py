"""Near-duplicate documents by BagMinHash.

Signatures estimate the weighted Jaccard similarity of the multisets of five-word shingles. Each
shingle owns a Poisson process over time and weight; the weight axis is cut at powers of two, and a
document sees the points below the shingle's count. A register keeps the first point it gets, so
two documents agree on a register with a probability equal to their similarity. Registers are
banded, and every candidate pair is verified by its exact multiset overlap.

Texts with one sequence of words are united first, by hash, whatever their number. In a bucket all
members are compared to its hub, the member that meets most others over all bands. Only where that
leaves several components are further pairs asked, of members of different ones: those that share
rare shingles, found by these, and those whose many rare shingles don't rule out that they are
similar without. So copies of one text that differ by edits of their own never make all their pairs,
and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import maybe_broadcast, small_batches, stored, table, unwrapped, wrapped
from docloom.llm.graph import components
from docloom.llm.tokens import hash_words, mix

SHINGLE = 5
#: Least similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: At similarity 0.8 one of the bands agrees with probability 1 - (1 - 0.8**6)**32 = 0.99994.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Pivots of a bucket in the first round after its hub, about; doubled each round.
PIVOTS = 1024
#: A shingle of the undecided texts is rare if so many of them have it at most.
FEW = 8
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of rows of words: row, 52-bit hash and count, sorted by row and hash; fewer words than size are one shingle."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(at[1:], n) - np.arange(len(hashes))  # words from here to the row's end
    total = np.zeros(len(hashes), np.uint64)
    for k in range(min(size, len(total))):
        end = len(total) - k
        total[:end] += np.where(left[:end] > k, hashes[k:] * _ODD[k % len(_ODD)], np.uint64(0))
    begins = (left >= size) | ((left == n[row]) & (n[row] < size))
    key = row[begins].astype(np.uint64) << np.uint64(52) | mix(total[begins]) >> np.uint64(12)
    if len(n) > 4096:
        raise ValueError("more than 4096 rows in a chunk")
    key, count = np.unique(key, return_counts=True)
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), count


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """The registers' winning points, a row for each of rows; rows without shingles are 0."""
    unit, low, of, weight = [mix(shingle)], [np.zeros(len(row))], [row], [count]
    level = 0
    while True:  # the part of the weight axis from 2**level, where a count reaches beyond it
        more = count > 1 << level
        if not more.any():
            break
        unit.append(mix(shingle[more] + np.uint64((level + 1) * int(_ODD[1]) % (1 << 64))))
        low.append(np.full(int(more.sum()), float(1 << level)))
        of.append(row[more])
        weight.append(count[more])
        level += 1
    unit, low, of, weight = map(np.concatenate, (unit, low, of, weight))
    rate = np.maximum(low, 1.0)
    time = np.zeros(len(unit))
    drawn = np.zeros(len(unit), np.uint64)
    best = np.full(rows * registers, np.inf)
    winner = np.zeros(rows * registers, np.uint64)
    alive = np.arange(len(unit))
    while len(alive):
        k = int(np.clip((1 << 14) // len(alive), 1, 64))
        turn = drawn[alive][:, None] + np.arange(1, k + 1, dtype=np.uint64)
        point = mix(unit[alive][:, None] + turn * _ODD[2])
        gap = -np.log1p(-(point >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate[alive][:, None]
        when = time[alive][:, None] + np.cumsum(gap, axis=1)
        second = mix(point ^ _ODD[3])
        place = of[alive][:, None] * registers + ((second >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        height = low[alive][:, None] + rate[alive][:, None] * ((second & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        seen = height < weight[alive][:, None]
        at, t, p = place[seen], when[seen], point[seen]
        np.minimum.at(best, at, t)
        won = best[at] == t
        winner[at[won]] = p[won]
        time[alive], drawn[alive] = when[:, -1], turn[:, -1]
        latest = best.reshape(rows, registers).max(axis=1)
        alive = alive[time[alive] < latest[of[alive]]]
    return winner.reshape(rows, registers)


def banded(winners: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band."""
    rows = winners.reshape(len(winners), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[4]
    for i in range(ROWS):
        key = mix(key ^ rows[:, :, i])
    return key


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """hash_words in ranges of 4096 rows at most."""
    for i, j, hashes, at in hash_words(column):
        for a in range(0, j - i, 4096):
            b = min(a + 4096, j - i)
            yield i + a, i + b, hashes[at[a] : at[b]], at[a : b + 1] - at[a]


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text, document) to the same with same1, same2, n, bands: the hash of all words in two halves, their number of shingles, band keys."""
    for batch in batches:
        for i, j, hashes, at in pieces(batch.column(2)):
            own = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)]
            same = np.frombuffer(b"".join(own), np.int64).reshape(-1, 2)
            row, shingle, count = shingles(hashes, at)
            keys = banded(signatures(row, shingle, count, j - i)).view(np.int64)
            n = np.bincount(row, count, j - i).astype(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.ravel()))
            yield pa.record_batch([*(c.slice(i, j - i) for c in batch.columns), pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array(n), bands], names=["row", "doc_id", "text", "document", "same1", "same2", "n", "bands"])


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    for _, _, hashes, at in pieces(pa.array([text], pa.large_string())):
        return shingles(hashes, at)[1:]
    return np.zeros(0, np.uint64), np.zeros(0, np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sizes of intersection and union of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, a_text, b_text), in order of b, to the pairs (a, b) that are similar."""
    last, held = None, None
    for batch in batches:
        found = []
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != last:
                last, held = b, bag(y)
            both, union = overlap(bag(x), held)
            if union and both * SIMILAR[1] >= SIMILAR[0] * union:
                found.append((a, b))
        yield pa.record_batch([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts(rep, text) are near copies."""
    of = lambda k: texts.select(F.col("rep").alias(k), F.col("text").alias(f"{k}_text"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_text", "b_text")
    return both.sortWithinPartitions("b").mapInArrow(verify, "a long, b long")


def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text) to (rep, shingle, count) for each distinct shingle of a text."""
    for batch in batches:
        reps = batch.column(0).to_numpy()
        for i, _, hashes, at in pieces(batch.column(1)):
            row, shingle, count = shingles(hashes, at)
            yield pa.record_batch([pa.array(reps[i + row]), pa.array(shingle.view(np.int64)), pa.array(count)], names=["rep", "shingle", "count"])


def rarities(texts: DataFrame) -> DataFrame:
    """(rep, shingle, count, texts): the shingles of texts(rep, text) that FEW of them have at most."""
    spelled = stored(texts.select("rep", "text").mapInArrow(spell, "rep long, shingle long, count long"), "spelled")
    few = spelled.groupBy("shingle").agg(F.count("*").alias("texts")).where(F.col("texts") <= FEW)
    return spelled.join(few, "shingle")


def fits(a: Column, b: Column) -> Column:
    """Whether multisets of these sizes can be similar."""
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def may(both: Column, a: Column, b: Column) -> Column:
    """Whether multisets of sizes a and b that have both in common at most can be similar."""
    return both * (SIMILAR[0] + SIMILAR[1]) >= (a + b) * SIMILAR[0]


def rare_pairs(rare: DataFrame, people: DataFrame) -> DataFrame:
    """(a, b): pairs of people(rep, n, component, common) of different components that share rare shingles and may be similar.

    Two texts have at most the smaller of their common counts and what they share of the rare in
    common; a rare shingle has FEW texts, so it makes a bounded number of pairs.
    """
    known = rare.where("texts > 1").join(maybe_broadcast(people, 48), "rep")
    a = known.select("shingle", *(F.col(c).alias(f"a_{c}") for c in ("rep", "count", "n", "common", "component")))
    b = known.select("shingle", *(F.col(c).alias(f"b_{c}") for c in ("rep", "count", "n", "common", "component")))
    both = a.join(b, "shingle").where((F.col("a_rep") < F.col("b_rep")) & (F.col("a_component") != F.col("b_component")) & fits(F.col("a_n"), F.col("b_n")))
    both = both.groupBy("a_rep", "b_rep", "a_n", "b_n", "a_common", "b_common").agg(F.sum(F.least("a_count", "b_count")).alias("shared"))
    both = both.where(may(F.least("a_common", "b_common") + F.col("shared"), F.col("a_n"), F.col("b_n")))
    return both.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))


def classified(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, document) and (row, doc_id, class_id, kept) for every row of documents(doc_id, text, ...): class_id is the least doc_id of the class, kept marks one row of it.

    A class is a connected component of near copies. Words are lower-cased runs of 0-9, a-z and
    characters beyond ASCII; a text of one to four words is one shingle; null, empty and wordless
    texts have no shingles and are copies of each other. Repeated rows are copies, and one is kept;
    a null doc_id is a row like others (and the class_id only of a class without another id);
    other columns are kept in document; an empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    rows = wrapped(documents).select(F.monotonically_increasing_id().alias("row"), F.col("document.rest.doc_id").cast("long").alias("doc_id"), "text", "document")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ("same1", "same2", "n")), T.StructField("bands", T.ArrayType(T.LongType()))])
    signed = stored(rows.mapInArrow(sign, schema), "signed")
    first = stored(signed.groupBy("same1", "same2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")), "copies")

    reps = signed.join(first.select("rep"), F.col("row") == F.col("rep"), "left_semi")
    bands = reps.where("n > 0").select(F.col("row").alias("rep"), "n", F.explode("bands").alias("key"))
    bands = stored(bands, "bands")
    sizes = stored(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    buckets = stored(bands.join(maybe_broadcast(sizes, 32), "key"), "buckets")
    met = stored(buckets.groupBy("rep").agg(F.sum("size").alias("met")), "met")
    hubs = buckets.join(maybe_broadcast(met, 32), "rep").groupBy("key").agg(F.max(F.struct("met", "rep", "n")).alias("hub"))
    hubs = maybe_broadcast(stored(hubs.select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs"), 48)
    buckets = stored(buckets.join(hubs, "key").where("rep <> hub"), "buckets")

    asked = buckets.where(fits(F.col("n"), F.col("hub_n")))
    asked = stored(asked.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "asked")
    wanted = maybe_broadcast(met.select("rep"), 16)
    texts = stored(signed.select(F.col("row").alias("rep"), "text").join(wanted, "rep"), "texts")
    edges = stored(similar(asked, texts), "edges")
    labels = components(edges)

    def divided(rows: DataFrame) -> DataFrame:
        """The rows of buckets that hold several components, with the component."""
        marked = rows.join(maybe_broadcast(labels, 32).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        many = marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        return stored(marked.join(maybe_broadcast(stored(many, "many"), 16), "key"), "left")

    def joined(pairs: DataFrame) -> None:
        """Verifies pairs that were not asked before, and joins the components of those that are similar."""
        nonlocal asked, edges, labels
        pairs = stored(pairs.distinct().join(asked.union(asked.select("b", "a")), ["a", "b"], "left_anti"), "asked")
        found = stored(similar(pairs, texts), "edges")
        asked = asked.union(pairs)
        if not found.isEmpty():
            edges = edges.union(found)
            labels = components(edges)

    of = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / (1 << 30)
    left, turn = divided(buckets.select("key", "rep", "n", "size", of.alias("at"))), 0
    if not left.isEmpty():
        people = stored(left.select("rep", "n", "component").distinct(), "people")
        rare = stored(rarities(texts.join(maybe_broadcast(people.select("rep"), 16), "rep")), "rare")
        people = people.join(rare.groupBy("rep").agg(F.sum("count").alias("rare")), "rep", "left")
        people = stored(people.withColumn("common", F.col("n") - F.coalesce("rare", F.lit(0))).drop("rare"), "people")
        joined(rare_pairs(rare, people))
        left = left.drop("component").join(maybe_broadcast(people.select("rep", "common"), 32), "rep")
        left = divided(left.where(F.col("common") * SIMILAR[1] >= F.col("n") * SIMILAR[0]))
    while not left.isEmpty():
        upto = F.least(F.lit(1.0), F.lit(float(PIVOTS << turn)) / F.col("size"))
        pivots = left.where(F.col("at") < upto).select("key", *(F.col(c).alias(f"b_{c}") for c in ("rep", "n", "common", "component")))
        pairs = left.join(pivots, "key").where((F.col("component") != F.col("b_component")) & ((F.col("at") >= upto) | (F.col("rep") < F.col("b_rep"))) & may(F.least("common", "b_common"), F.col("n"), F.col("b_n")))
        joined(pairs.select(F.col("rep").alias("a"), F.col("b_rep").alias("b")))
        left, turn = divided(left.where(F.col("at") >= upto).drop("component")), turn + 1

    named = first.join(labels, first.rep == labels.node, "left").select("same1", "same2", "least", F.coalesce("component", "rep").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("class_id"))
    named = stored(named.join(least, "component").select("same1", "same2", "class_id", "component"), "classes")
    members = stored(signed.select("row", "doc_id", "same1", "same2").join(named, ["same1", "same2"]), "members")
    kept = members.where("doc_id <=> class_id").groupBy("component").agg(F.min("row").alias("kept_row"))
    members = members.join(kept.select(F.col("kept_row").alias("row"), F.lit(True).alias("kept")), "row", "left").select("row", "doc_id", "class_id", F.coalesce("kept", F.lit(False)).alias("kept"))
    return signed.select("row", "text", "document"), members


def near_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) for every row of documents(doc_id, text); see classified."""
    return classified(documents.select("doc_id", "text"))[1].drop("row")


def without_copies(documents: DataFrame) -> DataFrame:
    """One row of documents, with all its columns, of each class of near copies."""
    rows, members = classified(documents)
    gone = stored(members.where("NOT kept").select("row"), "gone")
    rows = rows.join(maybe_broadcast(gone, 16), "row", "left_anti")
    return unwrapped(rows, documents.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: Exact classes, where the operator's candidates come from signatures; doc_ids are taken as unique.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))) AS shingle FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, shingle, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY ALL),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS n FROM c a JOIN c b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN t a ON a.doc_id = x JOIN t b ON b.doc_id = y WHERE shared.n * {SIMILAR[1]} >= (a.n + b.n - shared.n) * {SIMILAR[0]}
  UNION ALL SELECT min(doc_id) OVER (), doc_id FROM d WHERE len(w) = 0),
edges AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
reach(node, met) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.met)
SELECT node AS doc_id, min(met) AS class_id, node = min(met) AS kept FROM reach GROUP BY node
"""
