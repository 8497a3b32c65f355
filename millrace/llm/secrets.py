"""Secret scanning (DataFrame functions only).

Base rules: three patterns, leftmost and non-overlapping per kind, with code
point offsets.  Offsets come from the lengths of what lies between matches
(``split``) and of the matches themselves, so no text is walked per match.

Method: every run of 20 or more token characters is a candidate.  Its encoding
is inferred (``ENCODINGS``: the smallest alphabet that has all its symbols) and a
battery of tests is run on its symbol values: chi-squared uniformity over the
alphabet, runs, and lag-1 serial correlation.  Each is judged under two
hypotheses:

* random under the encoding: Fisher's method combines the two-sided p-values of
  chi-squared, of runs about the middle of the alphabet and of the serial
  correlation.  Candidates below ``NOT_RANDOM`` are told from random and are
  never reported;
* ordinary writing under the encoding: a symbol meets itself as often as
  ``repeat`` says, which makes chi-squared a non-central one with its length's
  non-centrality, and runs are those of character classes (which change on at
  most ``CHANGES`` of the steps) or, in strings of letters of one case, of vowels
  and consonants (which change on at least ``SWITCHES`` of them).  Fisher's method
  combines the two p-values; digits alone have only the first.

The p-value of ordinary writing is what the false-discovery rule runs on:
Benjamini-Hochberg at ``FDR`` per length class, over all candidates of all
documents, those that the battery told from random counting with a p-value of 1.
Short strings, whose tests have little power, are thus judged among themselves.

Scale: one pass over the texts, no Python, no exchange of texts; the false
discovery rule needs a histogram of at most 3 * 401 cells.

Defined cases: null text counts as empty (no spans, SHA-256 of nothing);
repeated rows give repeated results; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import keep, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Pattern, alphabet, how often a symbol of ordinary writing meets itself, and what changes are counted; the first that fits holds.
ENCODINGS = (
    ("^[0-9]+$", DIGIT, 0.16, ""), ("^[0-9a-f]+$", DIGIT + "abcdef", 0.1, "class"), ("^[0-9A-F]+$", DIGIT + "ABCDEF", 0.1, "class"),
    ("^[a-z]+$", LOWER, 0.062, "vowel"), ("^[A-Z]+$", UPPER, 0.062, "vowel"),
    ("^[A-Z2-7]+$", UPPER + "234567", 0.055, "class"), ("^[a-z2-7]+$", LOWER + "234567", 0.055, "class"),
    ("^[a-z0-9]+$", DIGIT + LOWER, 0.055, "class"), ("^[A-Z0-9]+$", DIGIT + UPPER, 0.055, "class"),
    ("^[A-Za-z]+$", UPPER + LOWER, 0.045, "class"), ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGIT, 0.045, "class"), ("", UPPER + LOWER + DIGIT + "+/", 0.045, "class"),
)
KINDS = ("assign", "access", "hex", "random")
CHANGES = 0.1  # class changes per step that ordinary writing shows at most
SWITCHES = 0.6  # changes between vowel and consonant per step that ordinary writing shows at least
FDR = 0.05
NOT_RANDOM = 1e-3
SPAN = "array<struct<start:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, value: int | None = None, least: int = 0) -> Column:
    """All matches as (start, end, value) in code points; ``value`` names a group to judge by length."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = whole if value is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("m"), judged.alias("v"))
    parts = F.filter(parts, lambda p: p["m"].isNotNull())
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("found"))

    def step(acc, p):
        start = acc["pos"] + p["gap"]
        end = start + F.length(p["m"])
        return F.struct(end.alias("pos"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), p["v"].alias("value")))).alias("found"))

    found = F.aggregate(parts, zero, step, lambda acc: acc["found"])
    found = F.filter(found, lambda s: F.length(s["value"]) >= least) if least else found
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by the rational approximation of the error function."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.greatest(F.lit(1e-300), F.when(z >= 0, tail).otherwise(1 - tail))


def _at_least(k: Column, n: Column, p: Column) -> Column:
    """P(at least k of n), each with probability p: the binomial term by Stirling's formula times its geometric tail; 1 up to the mean."""
    share = k / n
    rest = 1 - share
    divergence = share * F.log(share / p) + F.when(rest > 0, rest * F.log(rest / (1 - p))).otherwise(0.0)
    width = F.when(rest > 0, F.greatest(F.lit(1.0), F.sqrt(2 * math.pi * n * share * rest))).otherwise(1.0)
    tail = F.exp(-n * divergence) / width * (k + 1) * (1 - p) / (k + 1 - (n + 1) * p)
    return F.when(share <= p, 1.0).otherwise(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), tail)))


def _tested(spans: Column) -> Column:
    """Candidates with their symbol values, changes and test results.

    Built in steps of nested ``transform`` so that each value is computed once.
    """
    bare = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_replace(s["value"], "[_=-]", "").alias("s")))
    bare = F.filter(bare, lambda c: F.length(c["s"]) >= 16)

    def named(c):
        which = F.lit(len(ENCODINGS) - 1)
        for i, (pattern, *_) in reversed(list(enumerate(ENCODINGS[:-1]))):
            which = F.when(c["s"].rlike(pattern), i).otherwise(which)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["s"].alias("s"), which.alias("which"))

    def of(c, at):
        return F.get(F.array(*[F.lit(e[at]) for e in ENCODINGS]), c["which"])

    def symbols(c):
        alphabet = of(c, 1)
        chars = F.split(c["s"], "")
        kind = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(c["s"], "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "+/", "ll")
        # a run is a maximal block of one letter of ``kind``, or of vowels or consonants
        classes = F.regexp_count(kind, F.lit("l+|u+|d+"))
        vowels = F.regexp_count(F.translate(F.lower(c["s"]), "vaeiouy", "cvvvvvv"), F.lit("v+|[^v]+"))
        runs = F.when(of(c, 3) == "vowel", vowels).otherwise(classes)
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), F.length(c["s"]).cast("double").alias("n"), F.length(alphabet).cast("double").alias("a"),
            of(c, 2).alias("repeat"), of(c, 3).alias("counted"),
            F.transform(F.filter(chars, lambda x: x != ""), lambda x: (F.instr(alphabet, x) - 1).cast("double")).alias("v"), (runs - 1).cast("double").alias("changes"),
        )

    def means(c):  # a step of its own: what a lambda refers to is computed anew for every symbol
        mean = F.aggregate(c["v"], F.lit(0.0), lambda acc, x: acc + x) / c["n"]
        pairs = F.arrays_zip(F.slice(c["v"], 1, F.size(c["v"]) - 1), F.slice(c["v"], 2, F.size(c["v"]) - 1))
        return F.struct(*[c[k].alias(k) for k in ("start", "end", "n", "a", "repeat", "counted", "v", "changes")], mean.alias("mean"), pairs.alias("pairs"))

    def sums(c):
        v, n, a, mean, pairs = c["v"], c["n"], c["a"], c["mean"], c["pairs"]
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda acc, x: acc + F.pow(F.size(F.filter(v, lambda y: y == x)), F.lit(2.0)))
        high = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.when(x >= a / 2, 1.0).otherwise(0.0))
        switches = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.when((p["0"] >= a / 2) != (p["1"] >= a / 2), 1.0).otherwise(0.0))
        var = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        cov = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["0"] - mean) * (p["1"] - mean))
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), n.alias("n"), a.alias("a"), c["repeat"].alias("repeat"), c["counted"].alias("counted"), c["changes"].alias("changes"),
            (a / n * squares - n).alias("chi"), high.alias("high"), switches.alias("switches"), (cov / F.greatest(var, F.lit(1e-9)) * F.sqrt(n)).alias("serial"),
        )

    def scored(c):
        """Normal forms: of the three tests if random, of chi-squared if ordinary; and the changes that speak for random."""
        df, n, chi = c["a"] - 1, c["n"], F.greatest(c["chi"], F.lit(0.0))
        both = 2 * c["high"] * (n - c["high"])
        runs_var = F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9))
        off = F.greatest(F.lit(0.0), n * (c["a"] * c["repeat"] - 1))
        spread = 2 / 9 * (df + 2 * off) / ((df + off) * (df + off))
        vowel = c["counted"] == "vowel"
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), n.alias("n"), c["counted"].alias("counted"),
            F.abs((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))).alias("chi_z"),
            F.abs((c["switches"] - both / n) / F.sqrt(runs_var)).alias("runs_z"), F.abs(c["serial"]).alias("serial_z"),
            ((1 - spread - F.pow(chi / (df + off), F.lit(1 / 3))) / F.sqrt(spread)).alias("plain_z"),
            F.when(vowel, n - 1 - c["changes"]).otherwise(c["changes"]).alias("k"), F.when(vowel, 1 - SWITCHES).otherwise(CHANGES).alias("p"),
        )

    def tails(c):
        log_p = lambda p: -F.log(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), p)))
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["n"].alias("n"), c["counted"].alias("counted"),
            *[log_p(2 * _upper_tail(c[f"{k}_z"])).alias(k) for k in ("chi", "runs", "serial")],
            log_p(_upper_tail(c["plain_z"])).alias("plain"), log_p(_at_least(c["k"], c["n"] - 1, c["p"])).alias("changing"),
        )

    def combined(c):
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["n"].alias("n"), c["counted"].alias("counted"), (c["chi"] + c["runs"] + c["serial"]).alias("f"), c["plain"].alias("plain"), (c["plain"] + c["changing"]).alias("w"))

    def fisher(c):
        random_p = F.exp(-c["f"]) * (1 + c["f"] + c["f"] * c["f"] / 2)
        ordinary_p = F.when(c["counted"] == "", F.exp(-c["plain"])).otherwise(F.exp(-c["w"]) * (1 + c["w"]))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["n"].alias("n"), random_p.alias("random_p"), ordinary_p.alias("ordinary_p"))

    def judged(c):
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["n"].alias("n"), c["random_p"].alias("random_p"), F.when(c["random_p"] >= NOT_RANDOM, F.least(F.lit(1.0), c["ordinary_p"])).otherwise(1.0).alias("ordinary_p"))

    def binned(c):
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["random_p"].alias("random_p"), c["ordinary_p"].alias("ordinary_p"),
            F.least(F.lit(400), F.floor(-F.log10(F.greatest(c["ordinary_p"], F.lit(1e-300))) * 4).cast("int")).alias("bin"),
            F.when(c["n"] < 32, 0).when(c["n"] < 64, 1).otherwise(2).alias("band"),
        )

    out = bare
    for step in (named, symbols, means, sums, scored, tails, combined, fisher, judged, binned):
        out = F.transform(out, step)
    return out


def _cutoffs(candidates: DataFrame) -> dict[int, int]:
    """Benjamini-Hochberg cut-off (a bin of -4 log10 p) per length band, over all candidates."""
    cells = candidates.groupBy("band", "bin").count()
    ranked = cells.withColumns(
        {"above": F.sum("count").over(Window.partitionBy("band").orderBy(F.desc("bin"))), "all": F.sum("count").over(Window.partitionBy("band"))}
    )
    passing = ranked.where(F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / 4) <= FDR * F.col("above"))
    return {r["band"]: r["cut"] for r in passing.groupBy("band").agg(F.min("bin").alias("cut")).collect()}  # three rows at most


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, and all spans as array of (start, kind order, end), base and found by the battery."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    seen = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t")).select(
        "doc_id",
        _spans(F.col("t"), ASSIGN, 2, 12).alias("assign"),
        F.when(F.col("t").contains("AKIA"), _spans(F.col("t"), ACCESS)).otherwise(F.array().cast(SPAN)).alias("access"),
        _spans(F.col("t"), HEX).alias("hex"),
        _spans(F.col("t"), CANDIDATE).alias("candidates"),
    )
    tested = keep(
        seen.select(
            "doc_id", *[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS[:3]],
            _tested(F.col("candidates")).alias("candidates"),
        ),
        "secrets",
    )
    cut = _cutoffs(tested.select(F.explode("candidates").alias("c")).select("c.band", "c.bin"))
    limit = lambda c: F.coalesce(*[F.when(c["band"] == b, F.lit(cut.get(b, 401))) for b in range(3)])

    def listed(kind, at):
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("kind"), s["end"].alias("end")))

    base = F.concat(*[listed(k, i) for i, k in enumerate(KINDS[:3])])
    fresh = F.filter("candidates", lambda c: c["bin"] >= limit(c))
    rows = tested.select("doc_id", base.alias("base"), F.transform(fresh, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"))).alias("fresh"))
    extra = F.filter("fresh", lambda c: ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    return rows.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", extra)).alias("spans"))


def _said(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_said("base").cast("binary"), 256).alias("base_sha256"), _said("spans").alias("spans"),
    )
