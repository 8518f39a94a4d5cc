"""Benchmark decontamination by a positional inverted index.

Corpus counts of the test terms tell which are rarest. The index holds the postings (document,
position) of the two rarest terms of every window, stored as a table. A posting less the term's
offset in a window is where the window would start; starts at which both terms' postings meet are
candidates, and the words from there are looked up among the windows. Equal windows are one, so a phrase
that an item or a document repeats costs no more than its distinct windows at each of its places. Everything runs as
DataFrame operations; no text crosses an exchange while the candidates are few enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import broadcast_by_bytes, code_words, fits, joined_sha, maybe_broadcast, stored, table

WINDOW = 10
#: Terms of a proximity match, and the words within which they must occur.
NEAR_TERMS, NEAR_WORDS = 3, 20


def entries_of(benchmark: DataFrame, window: int) -> DataFrame:
    """(entry, words, m, k, items) for each distinct sequence of words: its length, window length and item_ids as strings."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), code_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.groupBy("words").agg(F.collect_set("item").alias("items"))
    return stored(rows.select(F.monotonically_increasing_id().alias("entry"), "words", F.size("words").alias("m"), F.least(F.size("words"), F.lit(window)).alias("k"), "items"), "entries")


def token_stream(documents: DataFrame) -> DataFrame:
    """(d1, d2, pos, h) for each word of each document; d1 and d2 tell documents apart."""
    rows = documents.select(*document_key(), code_words(F.col("text")).alias("words"))
    return rows.select("d1", "d2", F.posexplode("words").alias("pos", "word")).select("d1", "d2", "pos", F.xxhash64("word").alias("h"))


def document_key() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d1"), F.xxhash64("text").alias("d2")


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(h, n) for the terms(h) that occur; where they are too many to broadcast, tokens are summed before the join."""
    words = documents.select(F.explode(code_words(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("h"))
    if fits(terms, 16):
        return words.join(F.broadcast(terms), "h").groupBy("h").agg(F.count("*").alias("n"))
    return words.groupBy("h").agg(F.count("*").alias("n")).join(terms, "h")


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """(window, words, items) for each distinct window: its words and the item_ids, as strings, of the items that hold it."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), code_words(F.col("text")).alias("all")).where(F.size("all") > 0)
    k = F.least(F.size("all"), F.lit(window))
    rows = rows.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("all") - k + 1), lambda s: F.slice("all", s, k))).alias("words"))
    rows = rows.distinct().groupBy("words").agg(F.collect_set("item").alias("items"))
    return stored(rows.select(F.monotonically_increasing_id().alias("window"), "words", "items"), "windows")


def rarest(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(k, a1, h1, a2, h2): the distinct pairs of offsets and terms that are the two rarest of some window of k words; a window of one word has it twice."""
    terms = windows.select("window", F.size("words").alias("k"), F.posexplode("words").alias("a", "word")).select("window", "k", "a", F.xxhash64("word").alias("h"))
    terms = terms.join(maybe_broadcast(counts, 16), "h", "left").groupBy("window", "k")
    best = terms.agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "a", "h"))), 1, 2).alias("best"))  # of WINDOW terms at most
    one, two = F.get("best", F.lit(0)), F.coalesce(F.get("best", F.lit(1)), F.get("best", F.lit(0)))
    best = best.where((one["n"] > 0) & (two["n"] > 0))
    return best.select("k", one["a"].alias("a1"), one["h"].alias("h1"), two["a"].alias("a2"), two["h"].alias("h2")).distinct()


def candidates(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """(d1, d2, starts): for each document with some the sorted (start, k) at which the two rarest terms of a window of k words meet."""
    terms = windows.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("h")).distinct()
    counts = stored(term_counts(documents, terms), "counts")
    pairs = stored(rarest(windows, counts).withColumn("pair", F.monotonically_increasing_id()), "pairs")
    offsets = pairs.select("pair", "k", F.explode(F.array(*(F.struct(F.col(f"a{i}").alias("a"), F.col(f"h{i}").alias("h"), F.lit(i).alias("of")) for i in (1, 2)))).alias("o"))
    offsets = stored(offsets.select("pair", "k", "o.*"), "offsets")
    index = stored(token_stream(documents).join(maybe_broadcast(offsets.select("h").distinct(), 16), "h"), "index")
    aligned = index.join(maybe_broadcast(offsets, 32), "h").select("d1", "d2", "pair", "k", (F.col("pos") - F.col("a")).alias("start"), "of").where("start >= 0")
    met = aligned.groupBy("d1", "d2", "pair", "k", "start").agg(F.min("of").alias("first"), F.max("of").alias("last")).where("first <> last")
    return stored(met.groupBy("d1", "d2").agg(F.array_sort(F.collect_set(F.struct("start", "k"))).alias("starts")), "candidates")


def compared(documents: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """find's rows with the documents' keys."""
    documents = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    windows = windows_of(benchmark, window)
    asked = candidates(documents, windows)
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", *document_key(), code_words(F.col("text")).alias("words"))
    rows = rows.join(broadcast_by_bytes(asked, 64 + 32 * F.size("starts")), ["d1", "d2"], "left")
    there = F.transform("starts", lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["k"]).alias("end"), F.array_join(F.slice("words", s["start"] + 1, s["k"]), " ").alias("found")))
    rows = stored(rows.select("row", "doc_id", "d1", "d2", F.size("words").cast("long").alias("n_words"), there.alias("there")), "met")
    known = windows.select(F.array_join("words", " ").alias("found"), "items")  # words have no spaces
    known = broadcast_by_bytes(known, 128 + F.octet_length("found") + 32 * F.size("items") + F.octet_length(F.array_join("items", "")))
    hit = rows.where("there IS NOT NULL").select("row", F.explode("there").alias("s")).select("row", "s.*").join(known, "found")
    named = hit.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = hit.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hits"))
    spans = stored(spans.join(named, "row", "left"), "hit")
    rows = rows.drop("there").join(broadcast_by_bytes(spans, 64 + 32 * F.size("hits") + 32 * F.coalesce(F.size("items"), F.lit(0)) + F.coalesce(F.octet_length(F.array_join("items", "")), F.lit(0))), "row", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    rows = rows.select("doc_id", "d1", "d2", "n_words", none("hits", "struct<start:int,end:int>"), none("items", "string"))
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["upto"], x["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["upto"], x["start"]))).alias("n"))
    return rows.select("doc_id", "d1", "d2", "n_words", F.aggregate("hits", zero, step, lambda a: a["n"]).cast("long").alias("n_hit"), "hits", "items")


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, hits, items) for every row of documents(doc_id, text), against benchmark(item_id, text).

    A window is that many consecutive words of an item, or all words of a shorter item. hits are
    the occurrences of windows, as sorted (start, end) in words of the document; n_hit is how many
    words they cover; items are the item_ids, as strings, with a window that occurs. Null and empty
    texts have no words; items without words or windows match nothing, an item without an id is
    hit but not named; a very long text is one row of words and takes time in proportion to them; a doc_id that is no whole
    number fails, or counts as null where spark.sql.ansi.enabled is false; repeated rows are answered each; other
    columns are ignored; an empty benchmark hits nothing, no documents give no rows.
    """
    return compared(documents, benchmark, window).drop("d1", "d2")


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of documents, with all their columns, in which no window of the benchmark occurs."""
    hit = stored(compared(documents, benchmark, window).where("n_hit > 0").select("d1", "d2").distinct(), "hit")
    rows = documents.select(F.struct("*").alias("document"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("document", *document_key()).join(maybe_broadcast(hit, 16), ["d1", "d2"], "left_anti")
    return rows.select("document.*")


def near(documents: DataFrame, benchmark: DataFrame, terms: int = NEAR_TERMS, words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, item): proximity matches: documents in which the item's rarest terms, so many distinct ones, occur within so many words of an occurrence of the rarest.

    Items of fewer distinct terms use those they have; items with a term that the corpus lacks match
    nothing. Nulls, repeats and empty tables as in find; a repeated row is answered once.
    """
    documents = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    entries = entries_of(benchmark, WINDOW)
    each = entries.select("entry", F.explode(F.array_distinct("words")).alias("word")).select("entry", F.xxhash64("word").alias("h"))
    counts = stored(term_counts(documents, each.select("h").distinct()), "counts")
    rare = each.join(counts, "h", "left").groupBy("entry").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h"))), 1, terms).alias("rare"))
    rare = rare.where(~F.exists("rare", lambda t: t["n"] == 0)).select("entry", F.size("rare").alias("needed"), F.posexplode("rare").alias("rank", "t"))
    rare = stored(rare.select("entry", "needed", "rank", F.col("t.h").alias("h")), "rare")
    index = token_stream(documents).join(maybe_broadcast(rare.select("h").distinct(), 16), "h").join(maybe_broadcast(rare, 32), "h")
    lists = index.groupBy("d1", "d2", "entry", "needed").agg(F.collect_list(F.when(F.col("rank") == 0, F.col("pos"))).alias("first"), F.collect_list(F.when(F.col("rank") > 0, F.struct("rank", "pos"))).alias("rest"))
    close = lambda p: F.size(F.array_distinct(F.transform(F.filter("rest", lambda t: F.abs(t["pos"] - p) <= words), lambda t: t["rank"]))) + 1 == F.col("needed")
    met = lists.where(F.exists("first", close)).join(maybe_broadcast(entries.select("entry", "items"), 256), "entry")
    return met.select(F.nullif(F.col("d1"), F.lit(-(1 << 63))).alias("doc_id"), F.explode("items").alias("item")).distinct()


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined_sha(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS k, array_to_string(w[s : s + least({WINDOW}, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least({WINDOW}, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.s, dw.k, bw.item_id FROM dw JOIN bw USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
