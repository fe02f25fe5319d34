"""Secret scans in DataFrame operations only.

Three pattern kinds (``assign``, ``access``, ``hex``) give base spans. A
battery of randomness tests adds ``random`` spans: runs of token characters
that no base span touches and that are too even to be words.

For a run of n characters, the smallest encoding that holds it (hexadecimal,
base 32, letters, letters and digits, base 64) gives an alphabet of k codes,
and three statistics:

* chi-squared for uniformity. Against the null hypothesis "written text", whose
  coincidence index makes the statistic noncentral, a small value counts as
  evidence; its p-value falls with n, so short runs never pass by chance.
* the runs test on codes below and above the alphabet's middle, and
* serial correlation of neighbouring codes; both against "random". A run that
  fails either, or that is too even even for chance, is no secret (counting
  sequences, alphabets, repeated patterns).

The text p-values go through Benjamini-Hochberg control at ``FDR`` within
classes of length, over the candidates of the whole table, on a fixed grid of
-log10 p: each class sends the counts of its grid cells, never its candidates.

Positions are code points, ends exclusive. Null and empty texts have no
spans; repeated rows count on their own (also among the candidates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns; the keyword's letters in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same matches where at least so many characters are asked for: a shorter run can't hold a longer match.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

FDR = 0.01
#: Smallest |z| at which the runs or serial test, or evenness, speaks against chance (about 1 in 1000).
REJECT_Z = 3.29
#: Lower ends of the classes of length.
LENGTHS = (20, 32, 48, 80)
#: Cells of the grid and their width in -log10 p.
CELLS, CELL = 400, 0.05

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, narrowest first: pattern, alphabet, coincidence index of text written in it.
ENCODINGS = (
    (r"^[0-9a-f]+$", "0123456789abcdef", 0.17),
    (r"^[0-9A-F]+$", "0123456789ABCDEF", 0.17),
    (r"^[a-z]+$", _LOWER, 0.065),
    (r"^[A-Z]+$", _UPPER, 0.065),
    (r"^[A-Z2-7]+$", _UPPER + "234567", 0.065),
    (r"^[a-z0-9]+$", _LOWER + _DIGITS, 0.065),
    (r"^[A-Z0-9]+$", _UPPER + _DIGITS, 0.065),
    (r"^[A-Za-z]+$", _UPPER + _LOWER, 0.06),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, 0.06),
    (r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/", 0.06),
    (r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_", 0.06),
    (r"", _UPPER + _LOWER + _DIGITS + "+/-_", 0.06),
)

_SPAN = "array<struct<begin: int, kind: int, end: int>>"


def found(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the leftmost non-overlapping matches that ``keep`` holds for.

    The text is split at its matches: lengths of what stands between and of the
    matches add up to the positions.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(matches, F.slice(between, F.lit(1), F.size(matches)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["b"])
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("begin"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(keep(x["m"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(steps, zero, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All base spans, by begin, then kind."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    always = lambda m: F.lit(True)
    return F.array_sort(F.concat(found(text, ASSIGN, 0, value), found(text, ACCESS_LONG, 1, always), found(text, HEX_LONG, 2, always)))


def _normal_tail(z: Column) -> Column:
    """-log10 of the chance of a standard normal below z, by a logistic curve."""
    return F.log10(1 + F.exp(F.least(-1.5976 * z - 0.07056 * z * z * z, F.lit(600.0))))


def battery(word: Column) -> Column:
    """Evidence that a run of token characters is no text, as -log10 p; null where it isn't random either.

    All statistics come from the run's codes: their squared counts, their sides
    of the middle, and the products of neighbours.
    """
    which = F.lit(len(ENCODINGS) - 1)
    for i in reversed(range(len(ENCODINGS) - 1)):
        which = F.when(word.rlike(ENCODINGS[i][0]), F.lit(i)).otherwise(which)
    alphabets = F.array(*[F.lit(a) for _, a, _ in ENCODINGS])
    indexes = F.array(*[F.lit(c) for _, _, c in ENCODINGS])

    def measured(at: Column) -> Column:
        alphabet = F.element_at(alphabets, at + 1)
        k = F.length(alphabet).cast("double")
        n = F.length(word).cast("double")
        squares = F.aggregate(
            F.filter(F.split(alphabet, ""), lambda c: c != ""),
            F.lit(0.0),
            lambda acc, c: acc + F.pow(n - F.length(F.replace(word, c, F.lit(""))), F.lit(2)),
        )
        chi = squares * k / n - n
        far = n * (k * F.element_at(indexes, at + 1) - 1)
        z_text = (chi - (k - 1) - far) / F.sqrt(2 * (k - 1) + 4 * far)
        z_even = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
        start = F.struct(
            F.lit(-1.0).alias("before"), F.lit(0.0).alias("high"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("squares"), F.lit(0.0).alias("products")
        )
        middle = (k - 1) / 2

        def walk(acc: Column, c: Column) -> Column:
            code = _code(alphabet, c) - middle
            side = F.when(code > 0, 1.0).otherwise(0.0)
            first = acc["before"] == -1.0
            last = acc["before"] - 1000
            return F.struct(
                (code + 1000).alias("before"),
                (acc["high"] + side).alias("high"),
                (acc["turns"] + F.when(~first & ((last > 0) != (code > 0)), 1.0).otherwise(0.0)).alias("turns"),
                (acc["sum"] + code).alias("sum"),
                (acc["squares"] + code * code).alias("squares"),
                (acc["products"] + F.when(first, 0.0).otherwise(last * code)).alias("products"),
            )

        def judged(s: Column) -> Column:
            high, low = s["high"], n - s["high"]
            expected = 2 * high * low / n + 1
            spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
            z_runs = (s["turns"] + 1 - expected) / spread
            mean = s["sum"] / n
            variance = F.greatest(s["squares"] - n * mean * mean, F.lit(1e-9))
            z_serial = (s["products"] - n * mean * mean) / variance * F.sqrt(n)
            random = (F.abs(z_runs) < REJECT_Z) & (F.abs(z_serial) < REJECT_Z) & (F.abs(z_even) < REJECT_Z)
            return F.when(random, _normal_tail(z_text))

        return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), start, walk, judged)

    return F.element_at(F.transform(F.array(which), measured), 1)


def _code(alphabet: Column, c: Column) -> Column:
    return F.call_function("instr", alphabet, c).cast("double") - 1


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, base spans, candidates (begin, end, length class, grid cell)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    runs = F.when(F.col("text").rlike(CANDIDATE), found(F.col("text"), CANDIDATE, 3, lambda m: F.lit(True))).otherwise(F.array().cast(_SPAN))
    rows = rows.withColumn("runs", runs)
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["begin"] < r["end"]) & (r["begin"] < b["end"])))

    def candidate(r: Column) -> Column:
        n = r["end"] - r["begin"]
        level = F.lit(0)
        for i, least in enumerate(LENGTHS):
            level = F.when(n >= least, F.lit(i)).otherwise(level)
        evidence = battery(F.substring(F.col("text"), r["begin"] + 1, n))
        cell = F.when(evidence.isNotNull(), F.least(F.floor(evidence / CELL), F.lit(CELLS - 1)).cast("int"))
        return F.struct(r["begin"].alias("begin"), r["end"].alias("end"), level.alias("length"), cell.alias("cell"))

    return rows.select("id", "base", F.transform(free, candidate).alias("candidates"))


def thresholds(rows: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each class of length, the lowest grid cell that is a discovery (classes without one are left out).

    A cell's p-value is that of its lower edge, the largest in it; so the rate
    is kept. Candidates that failed the randomness tests count in no cell but
    in the number of tests.
    """
    cells = rows.select(F.explode("candidates").alias("c")).groupBy("c.length", "c.cell").agg(F.count("*").alias("n"))
    above = Window.partitionBy("length").orderBy(F.col("cell").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("length")
    p = F.pow(F.lit(10.0), -F.col("cell") * CELL)
    ranked = cells.withColumn("rank", F.sum("n").over(above)).withColumn("tests", F.sum("n").over(every))
    passed = ranked.filter(F.col("cell").isNotNull() & (p <= F.lit(fdr) * F.col("rank") / F.col("tests")))
    return {r["length"]: r["cell"] for r in passed.groupBy("length").agg(F.min("cell").alias("cell")).collect()}  # a row for each class


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row for each document: id, base (spans), spans (base and random ones, by begin, then kind)."""
    rows = staged(scanned(docs, id_col, text_col), "secret-candidates")
    lowest = thresholds(rows, fdr)

    def secret(c: Column) -> Column:
        hit = F.lit(False)
        for length, cell in sorted(lowest.items()):
            hit = hit | ((c["length"] == length) & (c["cell"] >= cell))
        return F.coalesce(hit, F.lit(False))

    random = F.transform(F.filter("candidates", secret), lambda c: F.struct(c["begin"].alias("begin"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return rows.select("id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def rendered(spans: Column) -> Column:
    """``kind:begin:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
