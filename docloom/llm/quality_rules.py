"""Quality rules: length and repetition rules, then divergence from language references.

Each document's histogram of character classes and its histogram of common words are compared to
the references of its language by Jensen-Shannon distance (base 2, so 0 to 1). The references are
sums over all documents of a language, learned in one aggregation that combines before its shuffle.
A histogram is only judged when the document is long enough for it to mean something.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import stored, table

WORD_SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = r"[^#*$%&|<>]+"

# Common words by language.
COMMON_WORDS = {
    "de": "der die und das von zu mit den ist nicht des im für auf ein eine sich dem als auch".split(),
    "en": "the of and to in a is that for it as was with be by on not he his at this are or from".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se".split(),
}

# Character classes, as what is removed from a text to leave the class; the rest are other characters.
CLASSES = {
    "lower": r"[^a-z]+",
    "upper": r"[^A-Z]+",
    "digit": r"[^0-9]+",
    "space": r"[^ \t\r\n]+",
    "point": r"""[^.,;:!?'"()-]+""",
    "symbol": r"""[^#*$%&|<>@+=/~^_{}\[\]\\`]+""",
}

#: A document with fewer characters or words than these is not judged by that histogram.
MIN_CHARS, MIN_WORDS = 200, 50
#: Largest Jensen-Shannon distance of a kept document from its language's reference.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.22, 0.36


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SPACE), "")


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """rows(words) with n_repeat_words: words in a 3-word window that the text has at least twice; windows compare by 64-bit hash.

    Most texts repeat no window, which a hash set of longs shows. The others sort (hash, start)
    within the row and keep the starts whose neighbour in that order has the same hash; each
    array is a column of its own, so that no step runs again for each element of another.
    """
    starts = F.when(F.size("words") >= 4, F.sequence(F.lit(1), F.size("words") - 2)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.xxhash64(F.get("words", i - 1), F.get("words", i), F.get("words", i + 1))
    rows = rows.withColumn("hashes", F.transform(starts, window))
    ranked = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("ranked", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), ranked).otherwise(none)).drop("hashes")
    rows = rows.withColumn("same", F.zip_with("ranked", F.slice("ranked", 2, 1 << 30), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))))
    either = F.zip_with("same", F.concat(F.array(F.lit(False)), "same"), lambda x, y: F.coalesce(x, F.lit(False)) | y)
    at = F.filter(F.zip_with("ranked", either, lambda x, hit: F.when(hit, x["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("at", F.array_sort(at)).drop("ranked", "same")
    before = F.slice(F.concat(F.array(F.lit(-3)), "at"), 1, F.size("at"))
    gaps = F.zip_with("at", before, lambda x, last: F.least(F.lit(3), x - last))
    return rows.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda s, x: s + x).cast("long")).drop("at")


def jensen_shannon(p: str, q: str) -> Column:
    """Distance of two arrays of shares, base 2; null where one of them is."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    halves = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(halves, F.lit(0.0), lambda s, x: s + x) / 2))


def shares(counts: str) -> Column:
    """Counts as shares of their sum; null where they are null or the sum is 0."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.zip_with(counts, F.array_repeat(F.nullif(total, F.lit(0)), F.size(counts)), lambda x, n: x / n)


def features(documents: DataFrame) -> DataFrame:
    """One row per document: the base counts, and the histograms cls (per class) and com (per common word of its language)."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", "lang", text.alias("text"))
    rows = with_repeated_words(rows.withColumn("words", words_of(F.col("text"))))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    kinds = [F.length(F.regexp_replace("text", gone, "")) for gone in CLASSES.values()]
    rest = F.length("text") - reduce(lambda a, b: a + b, kinds)
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    bare = F.transform("words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    rows = rows.withColumn("common", F.filter(bare, lambda w: w.isin(every)))
    count = lambda known: F.size(F.filter("common", lambda w: w == known))
    widest = max(map(len, COMMON_WORDS.values()))
    counts = None
    for lang, known in COMMON_WORDS.items():
        own = F.array(*map(count, known), *[F.lit(0)] * (widest - len(known)), F.size("words") - F.size(F.filter("common", lambda w: w.isin(known))))
        counts = F.when(F.col("lang") == lang, own) if counts is None else counts.when(F.col("lang") == lang, own)
    return rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.length("text").alias("n_chars"),
        F.array(*kinds, rest).cast("array<bigint>").alias("cls"),
        counts.cast("array<bigint>").alias("com"),
    )


def judge(documents: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed, kept) for every row of documents(doc_id, text, lang).

    reference: documents to learn the references from; by default the judged ones. A null text is
    empty and fails the base rules; a null lang is a language of its own, without common words;
    repeated rows are judged each; other columns are ignored; an empty table gives no rows.
    A distance that can't be told (short text, unknown language) is null and fails nothing.
    """
    own = stored(features(documents), "features")
    size = len(CLASSES) + 1
    widest = max(map(len, COMMON_WORDS.values())) + 1
    learned = own if reference is None else features(reference)
    sums = learned.groupBy(F.coalesce("lang", F.lit("")).alias("of")).agg(
        F.array(*(F.sum(F.get("cls", F.lit(i))) for i in range(size))).alias("ref_cls"),
        F.array(*(F.sum(F.get("com", F.lit(i))) for i in range(widest))).alias("ref_com"),
    )
    joined = own.join(sums, F.coalesce(own["lang"], F.lit("")) == sums["of"], "left")
    joined = joined.withColumns({c: shares(c) for c in ("cls", "com", "ref_cls", "ref_com")})
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = F.coalesce((F.col("n_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE), F.lit(False)) | F.coalesce(
        (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE), F.lit(False)
    )
    out = joined.withColumns({"class_distance": jensen_shannon("cls", "ref_cls"), "word_distance": jensen_shannon("com", "ref_com")})
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", base_failed.alias("base_failed"), (~base_failed & ~far).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_CLASSES = ", ".join("length(regexp_replace(text, '{}', '', 'g'))".format(gone.replace("'", "''")) for gone in CLASSES.values())
_WIDEST = max(map(len, COMMON_WORDS.values()))
_COUNTS = "\n    ".join(
    f"WHEN '{lang}' THEN list_concat(list_transform({_list(known)}, lambda k: len(list_filter(bare, lambda w: w = k))), [{', '.join(['0'] * (_WIDEST - len(known)) + [f'len(words) - len(list_filter(bare, lambda w: list_contains({_list(known)}, w)))'])}])"
    for lang, known in COMMON_WORDS.items()
)
_SHARES = "CASE WHEN list_sum({0}) > 0 THEN list_transform({0}, lambda x: x / list_sum({0})::DOUBLE) END"
_PART = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
_DISTANCE = "sqrt(greatest(0, list_sum(list_transform(list_zip({0}, {1}), lambda z: " + _PART.format("z[1]", "z[2]") + " + " + _PART.format("z[2]", "z[1]") + ")) / 2))"

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{WORD_SPACE}'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS lines FROM d),
threes AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM threes, range(3) t(k) WHERE threes.n > 1 GROUP BY r),
f AS (
  SELECT w.r, doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '{SYMBOLS}', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, length(text) AS n_chars, words, list_transform(words, lambda x: lower(rtrim(x, '.,;:!?'))) AS bare, [{_CLASSES}] AS kinds
  FROM w LEFT JOIN repeated p USING (r)),
h AS (SELECT *, list_append(kinds, n_chars - list_sum(kinds)) AS cls, CASE lang {_COUNTS} END AS com FROM f),
cls_sums AS (SELECT lang, list(n ORDER BY k) AS ref_cls FROM (SELECT lang, k, sum(cls[k]) AS n FROM h, range(1, {len(CLASSES) + 2}) t(k) GROUP BY ALL) GROUP BY lang),
com_sums AS (SELECT lang, list(n ORDER BY k) AS ref_com FROM (SELECT lang, k, sum(com[k]) AS n FROM h, range(1, {_WIDEST + 2}) t(k) WHERE com IS NOT NULL GROUP BY ALL) GROUP BY lang),
shares AS (
  SELECT h.*, {_SHARES.format("cls")} AS p1, {_SHARES.format("ref_cls")} AS q1, {_SHARES.format("com")} AS p2, {_SHARES.format("ref_com")} AS q2
  FROM h JOIN cls_sums USING (lang) LEFT JOIN com_sums USING (lang)),
told AS (
  SELECT *, CASE WHEN p1 IS NOT NULL AND q1 IS NOT NULL THEN {_DISTANCE.format("p1", "q1")} END AS cd, CASE WHEN p2 IS NOT NULL AND q2 IS NOT NULL THEN {_DISTANCE.format("p2", "q2")} END AS wd,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM shares)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= {MIN_CHARS} AND coalesce(cd > {MAX_CLASS_DISTANCE}, false)) AND NOT (n_words >= {MIN_WORDS} AND coalesce(wd > {MAX_WORD_DISTANCE}, false)) AS kept
FROM told
"""
