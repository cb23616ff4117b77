"""Secrets in texts: fixed patterns, and a battery of randomness tests on other long tokens.

All of it is DataFrame expressions, so it runs inside Spark's own operators.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core.durable import cut
from millrace.llm.arrays import ends, given

#: Kind, pattern, group whose length counts, its least length.
PATTERNS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more is a whole run, as with one or more and a later look at its length
]
#: Alphabets of encodings, most special first; a token is of the first that holds all its characters.
ALPHABETS = [
    ("hex", "0123456789abcdef", r"^[0-9a-f]+$"),
    ("HEX", "0123456789ABCDEF", r"^[0-9A-F]+$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+$"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", r"^[0-9a-z]+$"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", r"^[0-9A-Za-z]+$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[0-9A-Za-z+/]+$"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^[0-9A-Za-z_-]+$"),
]
_TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: A token that could be shorter than so many bits has too little to test.
LEAST_BITS = 96
#: Upper ends of the length classes within which false discoveries are controlled.
LENGTHS = [24, 32, 48, 96]
#: p values are held as tenths of -log10 p, up to 1e-6, which the approximation of the normal tail still gives.
_STEP, _MOST = 0.05, 120


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans (start, rank, end, kind, found) of leftmost, non-overlapping matches whose group is long enough.

    A match begins where the lengths of all gaps and matches before it end.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("array()").cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,found:string>>")

    def parts(m: Column) -> Column:
        values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m, lambda v: F.length(v))
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        return F.struct(m.alias("found"), values.alias("n"), gaps.alias("gaps"))

    def placed(p: Column) -> Column:
        lengths = F.transform(p["found"], lambda f, i: (F.get(p["gaps"], i) + F.length(f)).cast("long"))
        return F.struct(p["found"].alias("found"), p["n"].alias("n"), ends(lengths).alias("ends"))

    def spans(p: Column) -> Column:
        one = lambda f, i: F.struct((F.get(p["ends"], i) - F.length(f)).alias("start"), F.lit(rank).alias("rank"), F.get(p["ends"], i).alias("end"), F.lit(kind).alias("kind"), f.alias("found"))
        whole = F.transform(p["found"], one)
        return F.filter(whole, lambda s, i: F.get(p["n"], i) >= least)

    return given(matches, lambda m: F.when(F.size(m) > 0, given(given(parts(m), placed), spans)).otherwise(none))


def _tail(z: Column) -> Column:
    """Two-sided normal tail (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _with_code(token: Column) -> Column:
    """The token with the size of its inferred alphabet and each character's place in it; null if none fits."""
    text = token["found"]

    def coded(name: str, alphabet: str) -> Column:
        places = F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(alphabet)) - 1)  # one step a character, however long the token
        return F.struct(token.alias("token"), F.lit(name).alias("code"), F.lit(len(alphabet)).alias("k"), F.lit(alphabet).alias("alphabet"), places.alias("x"))

    out = F.lit(None)
    mixed = text.rlike("[0-9]") & text.rlike("[A-Za-z]")
    for name, alphabet, shape in reversed(ALPHABETS):
        enough = F.length(text) * math.log2(len(alphabet)) >= LEAST_BITS
        out = F.when(text.rlike(shape), F.when(mixed & enough, coded(name, alphabet))).otherwise(out)
    return out


def _with_sums(c: Column) -> Column:
    text, x, k = c["token"]["found"], c["x"], c["k"]
    n = F.length(text).cast("double")
    count = lambda i: (F.length(text) - F.length(F.replace(text, F.substr(c["alphabet"], i + 1, F.lit(1)), F.lit("")))).cast("double")
    squares = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda a, i: a + F.pow(count(i), F.lit(2.0)))
    upper = F.size(F.filter(x, lambda v: v * 2 >= k)).cast("double")
    turns = F.size(F.filter(F.sequence(F.lit(1), F.size(x) - 1), lambda i: (F.get(x, i) * 2 >= k) != (F.get(x, i - 1) * 2 >= k)))
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    return F.struct(*(c[f].alias(f) for f in ("token", "code", "k", "x")), n.alias("n"), squares.alias("squares"), upper.alias("upper"), (turns + 1).cast("double").alias("runs"), mean.alias("mean"))


def _with_scores(c: Column) -> Column:
    n, k, x, mean = c["n"], c["k"].cast("double"), c["x"], c["mean"]
    chi = k / n * c["squares"] - n
    df = k - 1
    uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # Wilson and Hilferty
    n1, n0 = c["upper"], n - c["upper"]
    expected = 2 * n1 * n0 / n + 1
    spread = 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
    runs = F.when(spread > 0, (c["runs"] - expected) / F.sqrt(spread)).otherwise(F.lit(9.0))
    around = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    along = F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0), lambda a, i: a + (F.get(x, i) - mean) * (F.get(x, i - 1) - mean))
    serial = F.when(around > 0, (along / around + 1 / (n - 1)) * F.sqrt(n)).otherwise(F.lit(9.0))
    least = F.least(_tail(uniform), _tail(runs), _tail(serial)) * 3  # Bonferroni holds whatever the tests have in common
    level = F.least(F.lit(_MOST), F.floor(-F.log10(F.greatest(F.least(least, F.lit(1.0)), F.lit(1e-7))) / _STEP).cast("int"))
    length = sum(((n > most).cast("int") for most in LENGTHS), F.lit(0))
    return F.struct(c["token"].alias("token"), F.concat_ws(":", c["code"], length).alias("stratum"), level.alias("level"))


def _tested(text: Column) -> Column:
    tokens = _spans(text, "random", len(PATTERNS), _TOKEN, 0, 20)
    coded = F.filter(F.transform(tokens, _with_code), lambda c: c.isNotNull())
    return F.transform(F.transform(coded, _with_sums), _with_scores)


def _cutoffs(tested: DataFrame, rate: float) -> DataFrame:
    """One row with a map from stratum to the level from which tokens are taken as not random.

    Benjamini and Hochberg's step-up rule within each stratum, over counts for each
    level: there are at most 7 * 5 strata and 121 levels, however many tokens.
    """
    counts = tested.select(F.explode_outer("tested").alias("t")).where("t is not null").groupBy(F.col("t.stratum").alias("stratum"), F.col("t.level").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy("stratum").agg(F.collect_list(F.struct("level", "n")).alias("levels"), F.sum("n").alias("m"))
    upto = lambda v: F.aggregate("levels", F.lit(0).cast("long"), lambda a, o: a + F.when(o["level"] >= v["level"], o["n"]).otherwise(F.lit(0)))
    passed = F.filter("levels", lambda v: F.pow(F.lit(10.0), -_STEP * v["level"]) * F.col("m") <= rate * upto(v))
    lowest = F.array_min(F.transform(passed, lambda v: v["level"]))
    return lists.select("stratum", lowest.alias("cut")).where("cut is not null").agg(F.map_from_entries(F.collect_list(F.struct("stratum", "cut"))).alias("cuts"))


def looked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, base, tested): the input row as a struct, its text (empty for null), fixed spans by start, and tested tokens (token, stratum, level)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"))
    base = F.concat(*(_spans(F.col("text"), kind, rank, pattern, group, least) for rank, (kind, pattern, group, least) in enumerate(PATTERNS)))
    return rows.select("row", "text", F.sort_array(base).alias("base"), _tested(F.col("text")).alias("tested"))


def _random(cuts: Column) -> Column:
    """The tokens of tested below their class's level in cuts; all where the class has none."""
    kept = F.filter("tested", lambda t: t["level"] < F.coalesce(F.element_at(cuts, t["stratum"]), F.lit(_MOST + 1)))
    return F.transform(kept, lambda t: t["token"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """Find secrets in every whole text.

    Returns one row for each input row: id_col, base and random, both arrays of spans
    (start, rank, end, kind, found) sorted by start; positions count code points, end
    exclusive. base has the leftmost, non-overlapping matches of each kind in PATTERNS.
    random has the other runs of 20 or more characters of [A-Za-z0-9+/_-] with letters
    and digits, of some encoding and at least 96 bits long by it, that pass as random:
    under the hypothesis of uniform characters, chi-squared uniformity, the runs test
    about the middle of the alphabet and the lag-one serial correlation each give a
    p value. Their least, times three, is the token's; in each class of encoding and
    length, Benjamini-Hochberg at rate tells which tokens are structured.

    What is controlled are false discoveries of structure: of the tokens dismissed, at
    most a share of rate is expected to be random after all. The share of structured
    tokens among those reported isn't controlled: a short token that the tests have no
    power against is reported.

    The texts are read once: spans and test results, without texts, go to a checkpoint
    from which the classes' levels and then the result are taken. A null text counts as
    empty and gives empty arrays. Null or repeated ids pass through, equal rows each
    give a row; other columns aren't read. An empty table gives an empty result. Time
    is linear in the length of a token and n^1.5 in the number of matches in one text.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = cut(looked(plain).select(F.col("row.id").alias("id"), "base", "tested"))
    with_cuts = found.withColumn("cuts", _cutoffs(found, rate).scalar())
    return with_cuts.select(F.col("id").alias(id_col), "base", _random(F.col("cuts")).alias("random"))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with one mark for each run of overlapping spans; they are sorted by start."""
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(gap).alias("out"))

    return F.aggregate(spans, none, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", rate: float = 0.05) -> DataFrame:
    """The same rows and columns, with every span that scan() finds in a text replaced by mark.

    Overlapping spans are one. Strings of spans that occur elsewhere in the same text are replaced too, longest first.
    Null and empty texts stay as they are, equal rows stay equal, other columns aren't looked at, and an empty table stays empty.
    Texts aren't stored in between, so tokens are tested twice: once for the levels, once where they are replaced.
    """
    found = looked(docs, text_col)
    found = found.withColumn("cuts", _cutoffs(found, rate).scalar()).select("row", "base", _random(F.col("cuts")).alias("random"))
    text, spans = F.col("row")[text_col], F.sort_array(F.concat("base", "random"))
    strings = F.array_distinct(F.transform(spans, lambda s: s["found"]))
    ordered = F.array_sort(strings, lambda a, b: F.length(b) - F.length(a))
    cleaned = F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, _without(text, spans, mark), lambda t, s: F.replace(t, s, F.lit(mark))))
    return found.select(*((cleaned if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
