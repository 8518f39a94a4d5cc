"""Secret scan: fixed patterns, and a battery of randomness tests over all other long tokens.

The battery infers a token's encoding (its alphabet) and asks whether it looks drawn at random from
it: chi-squared for even use of the alphabet, a runs test about the median symbol and lag-1 serial
correlation, the three together by Bonferroni. A token that passes is set against ordinary text,
in which neighbouring characters seldom change class (lower, upper, digit, other): the fewer
such changes text would show over its length, the smaller its p-value, so long tokens are told
from words sooner than short ones. Within each class of lengths the share of false discoveries is
held by Benjamini and Hochberg's procedure over the p-values of the whole corpus, counted in bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table

# Fixed values of the query's contract.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
KINDS = ("assign", "access", "hex", "random")

#: Tokens of the battery: whole runs of these characters, of this length or more.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Encodings in order of inference: name, pattern of all its characters, number of symbols.
ENCODINGS = (
    ("hex", r"[0-9a-f]+|[0-9A-F]+", 16),
    ("base32", r"[A-Z2-7]+", 32),
    ("base36", r"[a-z0-9]+|[A-Z0-9]+", 36),
    ("base62", r"[A-Za-z0-9]+", 62),
    ("base64", r"[A-Za-z0-9+/]+", 64),
    ("base64url", r"[A-Za-z0-9_-]+", 64),
)
#: Elements of a block of an array that is built element by element; code points of a piece of a text that is cut.
BLOCK, PIECE = 256, 1024
#: Level at which the battery rejects randomness; share of class changes between neighbours in ordinary text.
REJECT, TEXT_CHANGE = 0.001, 0.08
#: Tolerated share of false discoveries, lengths at which a new class begins, and bins a decade of p.
FALSE_SHARE, LENGTH_CLASSES, BINS = 0.01, (20, 24, 32, 48, 64), 8


def let(value: Column, body) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(xs: Column, carry: Column, item: str, step) -> Column:
    """The items that step(carry, x), a struct of carry and item, makes of each element in turn.

    An array can only grow by being copied, so items grow in blocks and the blocks in an outer array: the time is in
    proportion to the elements, and not to their square.
    """
    blocks = F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda i: F.slice(xs, i * BLOCK + 1, F.lit(BLOCK))))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    add = lambda a, made: F.struct(made["carry"].alias("carry"), F.array_append(a["items"], made["item"]).alias("items"))
    own = lambda a, block: F.aggregate(block, F.struct(a["carry"].alias("carry"), empty(item).alias("items")), lambda b, x: let(step(b["carry"], x), lambda made: add(b, made)))
    grow = lambda a, block: let(own(a, block), lambda made: F.struct(made["carry"].alias("carry"), F.array_append(a["items"], made["items"]).alias("items")))
    return F.coalesce(F.flatten(F.aggregate(blocks, F.struct(carry.alias("carry"), empty(f"array<{item}>").alias("items")), grow, lambda a: a["items"])), empty(item))


SPAN = "struct<start:int,end:int,found:string>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, found), in code points, end exclusive.

    What lies between the matches comes from a split at the same pattern, so the positions are the
    running lengths of both; the arrays are only as long as there are matches.
    """

    def step(upto: Column, x: Column) -> Column:
        start = upto + F.length(x["gap"])
        span = lambda at: F.struct(at["end"].alias("carry"), F.struct(at["start"].alias("start"), at["end"].alias("end"), x["found"].alias("found")).alias("item"))
        return let(F.struct(start.alias("start"), (start + F.length(x["found"])).alias("end")), span)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    some = lambda found: F.when(F.size(found) > 0, let(F.zip_with(found, F.slice(F.split(text, pattern), 1, F.size(found)), lambda f, g: F.struct(g.alias("gap"), f.alias("found"))), lambda pairs: folded(pairs, F.lit(0), SPAN, step)))
    return F.coalesce(let(found, some), F.array().cast(f"array<{SPAN}>"))


def apart(tokens: Column, assigned: Column) -> Column:
    """The tokens that overlap no base span: those that hold an access key or hex run hold it whole, and the assignments are met in one pass over both by place."""
    plain = F.filter(tokens, lambda t: ~t["found"].rlike(f"{BASE['access']}|{BASE['hex']}"))
    # an assignment is placed at its start, before tokens that end there or later; ends rise with starts
    place = lambda x, at, kind: F.struct(at.alias("at"), kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"))
    both = F.concat(F.transform(plain, lambda t: place(t, t["end"] - 1, F.lit(1))), F.transform(assigned, lambda b: place(b, b["start"], F.lit(0))))
    own = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"))
    step = lambda last, x: F.struct(F.when(x["kind"] == 0, x["end"]).otherwise(last).alias("carry"), F.when((x["kind"] == 1) & (x["start"] >= last), own(x)).alias("item"))
    met = lambda both: F.filter(folded(F.array_sort(both), F.lit(0), SPAN, step), lambda t: t.isNotNull())
    return F.when(F.size(tokens) > 0, let(both, met)).otherwise(F.array().cast(f"array<{SPAN}>"))


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution, by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def neighbours(xs: Column, f) -> Column:
    """Sum of f over the pairs of neighbouring elements."""
    return total(F.zip_with(F.slice(xs, 2, 1 << 30), F.slice(xs, 1, F.size(xs) - 1), f))


def character_kind(c: Column) -> Column:
    return F.when((c >= 97) & (c <= 122), 0).when((c >= 65) & (c <= 90), 1).when((c >= 48) & (c <= 57), 2).otherwise(3)


def rank(c: Column, symbols: Column) -> Column:
    """Place of a character code in its alphabet: digits, letters (as one case where the alphabet has one), the rest."""
    upper = c - F.when(symbols < 62, 55).otherwise(29)
    return F.when((c >= 48) & (c <= 57), c - 48).when((c >= 97) & (c <= 122), c - 87).when((c >= 65) & (c <= 90), upper).otherwise(62 + c % 2).cast("double")


def alphabet(token: Column) -> Column:
    symbols = None
    for _, pattern, size in ENCODINGS:
        fit = token.rlike(f"^(?:{pattern})$")
        symbols = F.when(fit, float(size)) if symbols is None else symbols.when(fit, float(size))
    return symbols.otherwise(66.0)


def changed(codes: Column) -> Column:
    """p-value of a token's changes of character class in ordinary text, by Chernoff's bound on the binomial tail."""

    def tail(x: Column) -> Column:
        share, of, q = x["changes"] / x["of"], x["of"], F.lit(TEXT_CHANGE)
        rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - q))).otherwise(0.0)
        return F.when(share > q, F.exp(-of * (share * F.log(share / q) + rest))).otherwise(1.0)

    kinds = F.transform(codes, character_kind)
    changes = let(kinds, lambda k: neighbours(k, lambda a, b: (a != b).cast("double")))
    return let(F.struct(changes.alias("changes"), (F.size(codes) - 1).cast("double").alias("of")), tail)


def random_p(ranks: Column, symbols: Column) -> Column:
    """Bonferroni's p-value of the three tests of randomness."""
    n = F.size(ranks).cast("double")
    counts = F.transform(F.array_distinct(ranks), lambda r: F.size(F.filter(ranks, lambda x: x == r)).cast("double"))
    free = symbols - 1
    chi2 = total(F.transform(counts, lambda c: c * c)) * symbols / n - n
    z_chi = (chi2 - free) / F.sqrt(2 * free * (n - 1) / n)  # its mean and, of a short token too, its variance under evenness

    def z_runs(high: Column) -> Column:
        highs = total(F.transform(high, lambda h: h.cast("double")))
        runs = 1 + neighbours(high, lambda a, b: (a != b).cast("double"))
        seen = F.struct(highs.alias("highs"), runs.alias("runs"), (1 + 2 * highs * (n - highs) / n).alias("mean"))
        return let(seen, lambda x: F.when(x["mean"] > 2, (x["runs"] - x["mean"]) / F.sqrt((x["mean"] - 1) * (x["mean"] - 2) / (n - 1))).otherwise(99.0))

    def z_serial(centred: Column) -> Column:
        seen = F.struct(total(F.transform(centred, lambda x: x * x)).alias("all"), neighbours(centred, lambda a, b: a * b).alias("lagged"))
        return let(seen, lambda x: F.when(x["all"] > 0, (x["lagged"] / x["all"] + 1 / n) * F.sqrt(n)).otherwise(99.0))

    middle = (symbols - 1) / 2
    mean = let(total(ranks) / n, lambda m: let(F.transform(ranks, lambda r: r - m), z_serial))
    zs = F.struct(z_chi.alias("chi"), let(F.transform(ranks, lambda r: r >= middle), z_runs).alias("runs"), mean.alias("serial"))
    return let(zs, lambda z: F.least(F.lit(1.0), 3 * F.least(normal_tail(z["chi"]), 2 * normal_tail(F.abs(z["runs"])), 2 * normal_tail(F.abs(z["serial"])))))


def battery(found: Column) -> Column:
    """Of a token, a struct of p_random (small: not random) and p_text (small: not ordinary text)."""

    def tests(x: Column) -> Column:
        ranks = F.transform(x["codes"], lambda c: rank(c, x["symbols"]))
        return F.struct(let(ranks, lambda r: random_p(r, x["symbols"])).alias("p_random"), changed(x["codes"]).alias("p_text"))

    codes = lambda token: F.transform(F.slice(F.split(token, "(?!^)"), 1, F.length(token)), lambda c: F.ascii(c))  # noqa: E731  the split has an empty part at the end
    return let(F.regexp_replace(found, "=+$", ""), lambda token: let(F.struct(codes(token).alias("codes"), alphabet(token).alias("symbols")), tests))


def length_class(size: Column) -> Column:
    out = F.lit(0)
    for i, at in enumerate(LENGTH_CLASSES):
        out = F.when(size >= at, i).otherwise(out)
    return out


def p_bin(p: Column) -> Column:
    """Bin of a p-value, from 0 for p of 1 upwards; a bin's largest p is 10 ** (-bin / BINS)."""
    return F.least(F.lit(300 * BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS)).cast("int")


def thresholds(tested: DataFrame) -> dict[int, int]:
    """For each class of lengths the least bin whose tokens are discoveries; tested(length_class, bin, passed).

    Each p counts as its bin's largest, so the procedure errs towards fewer discoveries.
    """
    counts = tested.groupBy("length_class", "bin").agg(F.count("*").alias("n")).collect()  # len(LENGTH_CLASSES) * (300 * BINS + 1) rows at most
    least = {}
    for of in {r["length_class"] for r in counts}:
        own = sorted(((r["bin"], r["n"]) for r in counts if r["length_class"] == of), reverse=True)
        total, ranked = sum(n for _, n in own), 0
        for at, n in own:
            ranked += n
            if at and 10 ** (-at / BINS) <= FALSE_SHARE * ranked / total:
                least[of] = at
    return least


def scan(documents: DataFrame) -> DataFrame:
    """(document, text, spans) for every row of documents(text, ...), all columns of which are in document: spans of (start, kind, end, found), by start and then in the order of KINDS.

    Positions are code points, ends exclusive. Base spans come from the patterns; a random span is a
    token of the battery that overlaps none of them. A null text is empty; the time of a very long text is in
    proportion to its length and matches; repeated rows are scanned each (each token counts in the discovery
    control); an empty table gives no rows.
    """
    rows = documents.select(F.struct("*").alias("document"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kept = {
        "assign": lambda x: F.length(F.regexp_extract(x["found"], ASSIGNED, 1)) >= 6,
        "access": lambda x: F.lit(True),
        "hex": lambda x: F.lit(True),
    }
    tagged = lambda spans, i: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"), x["found"].alias("found")))
    base = {kind: F.filter(matches(F.col("text"), pattern), kept[kind]) for kind, pattern in BASE.items()}
    tokens = let(matches(F.col("text"), TOKEN), lambda t: apart(t, F.col("assign")))
    rows = rows.withColumns(base).withColumn("tokens", tokens)
    rows = rows.select("document", "text", "tokens", F.concat(*(tagged(F.col(kind), i) for i, kind in enumerate(BASE))).alias("base"))
    rows = rows.withColumn("tokens", F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["found"].alias("found"), battery(t["found"]).alias("p"))))
    verdict = lambda t: F.struct(length_class(F.length(t["found"])).alias("length_class"), F.when(t["p"]["p_random"] >= REJECT, p_bin(t["p"]["p_text"])).otherwise(0).alias("bin"))
    least = thresholds(rows.select(F.explode(F.transform("tokens", verdict)).alias("v")).select("v.*"))

    def discovered(t: Column) -> Column:
        bar = F.lit(None).cast("int")
        for of, at in sorted(least.items()):
            bar = F.when(length_class(F.length(t["found"])) == of, at).otherwise(bar)
        return (t["p"]["p_random"] >= REJECT) & (p_bin(t["p"]["p_text"]) >= bar)

    random = tagged(F.filter("tokens", discovered), KINDS.index("random"))
    return rows.select("document", "text", F.array_sort(F.concat("base", random)).alias("spans"))


def masked(found: DataFrame) -> DataFrame:
    """scan's documents with all columns and their spans blotted out of text: each maximal run of covered characters becomes [SECRET]; n_chars, where there is one, follows."""
    whole = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def part(pieces: Column, a: Column, b: Column) -> Column:
        """The code points from a to b, by the pieces that hold them, as finding a place in a string is as long as what lies before it."""
        first = F.floor(a / PIECE).cast("int")
        own = F.slice(pieces, first + 1, F.greatest(F.ceil(b / PIECE).cast("int") - first, F.lit(0)))
        cut = lambda p, i: let((first + i) * PIECE, lambda at: F.substring(p, F.greatest(a - at, F.lit(0)) + 1, F.least(b - at, F.lit(PIECE)) - F.greatest(a - at, F.lit(0))))
        return F.when(b > a, F.array_join(F.transform(own, cut), "")).otherwise("")

    def blot(pieces: Column) -> Column:
        step = lambda upto, x: F.struct(
            F.greatest(upto, x["end"]).alias("carry"),
            F.when((x["start"] > upto) | (upto == 0), F.concat(part(pieces, upto, x["start"]), F.lit("[SECRET]"))).otherwise("").alias("item"),
        )
        end = F.array_max(F.transform("spans", lambda x: x["end"]))
        return F.concat(F.array_join(folded(F.col("spans"), F.lit(0), "string", step), ""), part(pieces, end, F.length("text")))

    blotted = let(whole, blot)
    columns = found.schema["document"].dataType.fieldNames()
    text = F.when(F.size("spans") > 0, blotted).otherwise(F.col("document.text"))
    new = {"text": text} | ({"n_chars": F.when(F.size("spans") > 0, F.length(blotted).cast("long")).otherwise(F.col("document.n_chars"))} if "n_chars" in columns else {})
    return found.select(*(new.get(c, F.col(f"document.`{c}`")).alias(c) for c in columns))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < KINDS.index("random"))
    return found.select("document.doc_id", *(of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), of("random").alias("n_random"))


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_PATTERNS = {
    "assign": rf"""(?:{_KEYWORDS})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""",
    "access": BASE["access"],
    "hex": BASE["hex"],
    "random": r"[A-Za-z0-9+/_=-]{20,}",
}
_FOUND = "\nUNION ALL ".join(
    f"SELECT r, {KINDS.index(kind)} AS kind, unnest(range(1, len(m) + 1)) AS i, m, g FROM (SELECT r, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d)" for kind, p in _PATTERNS.items()
)
_SYMBOLS = "CASE " + " ".join(f"WHEN regexp_full_match(t, '{pattern}') THEN {size}" for _, pattern, size in ENCODINGS) + " ELSE 66 END::DOUBLE"
_RANK = "CASE WHEN c BETWEEN 48 AND 57 THEN c - 48 WHEN c BETWEEN 97 AND 122 THEN c - 87 WHEN c BETWEEN 65 AND 90 THEN c - CASE WHEN symbols < 62 THEN 55 ELSE 29 END ELSE 62 + c % 2 END::DOUBLE"
_TAIL = "(CASE WHEN {z} >= 0 THEN {u} ELSE 1 - {u} END)"


def _normal_tail(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    u = f"(exp(-{z} * {z} / 2) / 2.5066282746310002 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return _TAIL.format(z=f"({z})", u=u)


_LENGTH_CLASS = "CASE " + " ".join(f"WHEN size >= {at} THEN {i}" for i, at in reversed(list(enumerate(LENGTH_CLASSES)))) + " ELSE 0 END"
_NAMES = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
_WRITTEN = f"string_agg({_NAMES} || ':' || a || ':' || b, ',' ORDER BY a, kind)"

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({_FOUND}),
placed AS (
  SELECT r, kind, m[i] AS t, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM matches),
spans AS (
  SELECT r, kind, t, a, a + length(t) AS b FROM placed
  WHERE kind <> 0 OR length(regexp_extract(t, '^(?:{_KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6),
base AS (SELECT * FROM spans WHERE kind < 3),
tokens AS (SELECT r, a, b, length(t) AS size, regexp_replace(t, '=+$', '') AS t FROM spans s WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base o WHERE o.r = s.r AND s.a < o.b AND o.a < s.b)),
coded AS (SELECT *, {_SYMBOLS} AS symbols, list_transform(string_split(t, ''), lambda c: ascii(c)) AS codes FROM tokens),
ranked AS (
  SELECT *, len(codes)::DOUBLE AS n, list_transform(codes, lambda c: {_RANK}) AS ranks,
    list_transform(codes, lambda c: CASE WHEN c BETWEEN 97 AND 122 THEN 0 WHEN c BETWEEN 65 AND 90 THEN 1 WHEN c BETWEEN 48 AND 57 THEN 2 ELSE 3 END) AS kinds FROM coded),
sums AS (
  SELECT *, list_sum(list_transform(list_distinct(ranks), lambda v: len(list_filter(ranks, lambda x: x = v)) ** 2)) * symbols / n - n AS chi2,
    list_transform(ranks, lambda v: v >= (symbols - 1) / 2) AS high, list_transform(ranks, lambda v: v - list_sum(ranks) / n) AS centred,
    list_sum(list_transform(range(2, len(codes) + 1), lambda i: (kinds[i] <> kinds[i - 1])::INT)) AS changes FROM ranked),
more AS (
  SELECT *, list_sum(list_transform(high, lambda h: h::INT)) AS highs, 1 + list_sum(list_transform(range(2, len(codes) + 1), lambda i: (high[i] <> high[i - 1])::INT)) AS runs,
    list_sum(list_transform(centred, lambda x: x * x)) AS squares, list_sum(list_transform(range(2, len(codes) + 1), lambda i: centred[i] * centred[i - 1])) AS lagged FROM sums),
scored AS (
  SELECT *, (chi2 - (symbols - 1)) / sqrt(2 * (symbols - 1) * (n - 1) / n) AS z1, 1 + 2 * highs * (n - highs) / n AS mean_runs,
    CASE WHEN squares > 0 THEN (lagged / squares + 1 / n) * sqrt(n) ELSE 99.0 END AS z3, changes / (n - 1) AS share FROM more),
told AS (SELECT *, CASE WHEN mean_runs > 2 THEN (runs - mean_runs) / sqrt((mean_runs - 1) * (mean_runs - 2) / (n - 1)) ELSE 99.0 END AS z2 FROM scored),
p AS (
  SELECT r, a, b, {_LENGTH_CLASS} AS class, least(1.0, 3 * least({_normal_tail("z1")}, 2 * {_normal_tail("abs(z2)")}, 2 * {_normal_tail("abs(z3)")})) AS p_random,
    CASE WHEN share > {TEXT_CHANGE} THEN exp(-(n - 1) * (share * ln(share / {TEXT_CHANGE}) + CASE WHEN share < 1 THEN (1 - share) * ln((1 - share) / (1 - {TEXT_CHANGE})) ELSE 0 END)) ELSE 1.0 END AS p_text FROM told),
binned AS (SELECT *, CASE WHEN p_random >= {REJECT} THEN least({300 * BINS}, floor(-log10(greatest(p_text, 1e-300)) * {BINS}))::INT ELSE 0 END AS bin FROM p),
counts AS (SELECT class, bin, count(*) AS n FROM binned GROUP BY ALL),
cumulated AS (SELECT *, sum(n) OVER (PARTITION BY class ORDER BY bin DESC) AS above, sum(n) OVER (PARTITION BY class) AS total FROM counts),
bars AS (SELECT class, min(bin) AS bar FROM cumulated WHERE bin > 0 AND 10 ** (-bin / {BINS}.0) <= {FALSE_SHARE} * above / total GROUP BY class),
every AS (SELECT r, kind, a, b FROM base UNION ALL SELECT r, 3, a, b FROM binned JOIN bars USING (class) WHERE p_random >= {REJECT} AND bin >= bar),
lists AS (
  SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3,
    {_WRITTEN} FILTER (kind < 3) AS written_base, {_WRITTEN} AS written FROM every GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(written_base, '')) AS base_sha256, coalesce(written, '') AS spans, coalesce(n3, 0) AS n_random
FROM d LEFT JOIN lists USING (r)
"""
