"""Secrets in texts: known forms, and tokens too random for prose. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from margrave.llm.common import materialize

#: Fixed forms, in the order of their kinds: pattern, least length, group whose length counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs of the characters of one encoding that the randomness tests judge; '=' ends a run, as padding or after a name.
CANDIDATE = r"(?:[A-Za-z0-9+/]{20,}|[A-Za-z0-9_-]{20,})=*"
LEAST = 20
#: Encodings by name: pattern of whole tokens (padding aside) and alphabet; the first that fits is inferred.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Relative frequencies of the letters a to z in English, German, French and Spanish prose, in per cent.
LETTERS = (
    (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074),
    (6.5, 1.9, 2.7, 5.1, 16.4, 1.7, 3.0, 4.6, 6.6, 0.27, 1.4, 3.4, 2.5, 9.8, 2.6, 0.67, 0.018, 7.0, 7.3, 6.2, 4.2, 0.85, 1.9, 0.034, 0.039, 1.1),
    (7.6, 0.9, 3.3, 3.7, 14.7, 1.1, 0.87, 0.74, 7.5, 0.61, 0.074, 5.5, 3.0, 7.1, 5.8, 2.5, 1.4, 6.7, 7.9, 7.2, 6.3, 1.8, 0.049, 0.43, 0.13, 0.33),
    (11.5, 2.2, 4.0, 5.0, 12.2, 0.69, 1.8, 0.7, 6.2, 0.49, 0.011, 5.0, 3.2, 6.7, 8.7, 2.5, 0.88, 6.9, 8.0, 4.6, 2.9, 1.1, 0.017, 0.22, 1.0, 0.47),
)
#: Shares of lower-case letters, capitals, digits and other characters in the words of prose.
SHARES = (0.95, 0.03, 0.01, 0.01)
#: Share of false discoveries, of either kind, lower bounds of the strata of length, and steps of p-values to a power of ten.
FALSE_DISCOVERIES, STRATA, STEPS = 0.01, (20, 32, 64), 10
#: Steps of the smallest p-values told apart: 10^-300.
MOST = 300 * STEPS


def _bind(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def _running(steps: Column) -> Column:
    """Running sums of an array: sums of blocks of about sqrt(n) items, then inside each block."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    b = F.greatest(F.ceil(F.sqrt(F.size(steps))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / b).cast("int")), lambda j: add(F.slice(steps, j * b + 1, b)))
    whole = lambda sums: F.transform(sums, lambda _, j: add(F.slice(sums, F.lit(1), j)))
    return _bind(_bind(blocks, whole), lambda before: F.transform(steps, lambda _, i: before[F.floor(i / b).cast("int")] + add(F.slice(steps, F.floor(i / b).cast("int") * b + 1, i % b + 1))))


def _matches(text: Column, pattern: str, possible: Column, group: int = 0) -> Column:
    """The pattern's leftmost non-overlapping matches: start, end (code points) and the text of a group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = _bind(
        F.struct(F.transform(found, lambda x: F.length(x)).alias("n"), gaps.alias("gap"), kept.alias("kept")),
        lambda r: _bind(
            _running(F.transform(r["n"], lambda n, i: n + r["gap"][i])),
            lambda ends: F.transform(r["n"], lambda n, i: F.struct((ends[i] - n).alias("start"), ends[i].alias("end"), r["kept"][i].alias("text"))),
        ),
    )
    return F.when(possible & text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the rational approximation of Abramowitz and Stegun 26.2.17, within 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _prose_cost(profile: tuple[float, ...]) -> Column:
    """Of each ASCII character, minus the logarithm of its share in the prose of a language."""
    letters = [x / sum(profile) for x in profile]
    share = {chr(97 + i): SHARES[0] * p for i, p in enumerate(letters)} | {chr(65 + i): SHARES[1] * p for i, p in enumerate(letters)}
    share |= {c: SHARES[2] / 10 for c in "0123456789"} | {c: SHARES[3] / 5 for c in "+/_=-"}
    return F.array(*[F.lit(-math.log(share[chr(i)]) if chr(i) in share else 0.0) for i in range(128)])


def _battery(n: Column, a: Column, at: Column) -> Column:
    """The p-value under which n characters are independent uniform draws from an alphabet of a; at: their places in it, from 1.

    Uniformity: the chi-squared statistic grows with the number of pairs of equal characters, whose mean, variance and
    third moment are known exactly, also where n is far under a and tables of chi-squared don't hold. Its upper tail, half
    a pair lower, is that of the gamma distribution of these three moments, by Wilson and Hilferty's cube root. The number of runs
    above or below the alphabet's middle, half a run nearer to its mean, and the correlation of neighbours are
    compared with their moments under independence, on both sides. The least of the three p-values is multiplied by 3."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    counts = F.transform(F.array_distinct(at), lambda c: F.size(F.filter(at, lambda x: x == c)).cast("double"))
    equal, q = total(F.transform(counts, lambda c: c * (c - 1) / 2)), 1 / a
    var_equal = n * (n - 1) / 2 * q * (1 - q)
    third = var_equal * (1 - 2 * q) + n * (n - 1) * (n - 2) * q * q * (1 - q)
    freedom = 8 * F.pow(var_equal, F.lit(3)) / (third * third)
    chi = freedom + F.sqrt(2 * freedom / var_equal) * (equal - 0.5 - n * (n - 1) / 2 * q)
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    high = F.transform(at, lambda x: x > a / 2)
    n1 = F.size(F.filter(high, lambda x: x)).cast("double")
    pairs = F.sequence(F.lit(1), F.size(at) - 1)
    runs = 1 + total(F.transform(pairs, lambda i: F.when(high[i] != high[i - 1], 1.0).otherwise(0.0)))
    mean_runs = 2 * n1 * (n - n1) / n + 1
    off = F.greatest(F.abs(runs - mean_runs) - 0.5, F.lit(0.0))
    z_runs = F.coalesce(off / F.sqrt(F.nullif(F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(0.0)), F.lit(0.0))), F.lit(9.0))
    mean = total(at) / n
    var = total(F.transform(at, lambda x: (x - mean) * (x - mean)))
    cov = total(F.transform(pairs, lambda i: (at[i] - mean) * (at[i - 1] - mean)))
    z_serial = F.coalesce((cov / F.nullif(var, F.lit(0.0)) + 1 / n) * F.sqrt(n), F.lit(9.0))
    return F.least(F.lit(1.0), 3 * F.least(_upper_tail(z_chi), 2 * _upper_tail(z_runs), 2 * _upper_tail(F.abs(z_serial))))


def _tests(token: Column) -> Column:
    """Inferred encoding, p-value of randomness and ln of the p-value of prose of a candidate.

    Randomness: the battery's, by the encoding's alphabet. Prose: the likelihood ratio of uniform draws from the
    alphabet to independent characters of a language's prose has mean 1 for such prose of any length, so by Markov's inequality its
    inverse is a p-value, which shrinks with every character; the largest over the languages counts."""
    body = F.regexp_replace(token, "=+$", "")
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, letters in reversed(ENCODINGS):
        encoding, alphabet = F.when(body.rlike(pattern), name).otherwise(encoding), F.when(body.rlike(pattern), letters).otherwise(alphabet)
    encoding = F.when(body.rlike("^[0-9]+$"), None).otherwise(encoding)
    known = F.struct(F.split(body, "").alias("chars"), encoding.alias("encoding"), alphabet.alias("alphabet"))

    def measured(k: Column) -> Column:
        chars = F.filter(k["chars"], lambda c: c != "")
        at = F.transform(chars, lambda c: F.instr(k["alphabet"], c).cast("double"))
        return F.struct(F.size(chars).cast("double").alias("n"), F.length(k["alphabet"]).cast("double").alias("a"), k["encoding"].alias("encoding"), at.alias("at"), chars.alias("chars"))

    def judged(m: Column) -> Column:
        n, a = m["n"], m["a"]
        cost = lambda own: F.aggregate(m["chars"], F.lit(0.0), lambda s, c: s + own[F.ascii(c)])
        ratio = F.least(*[cost(_prose_cost(profile)) for profile in LETTERS]) - n * F.ln(a)
        return F.struct(m["encoding"].alias("encoding"), _battery(n, a, m["at"]).alias("p_random"), (-F.greatest(ratio, F.lit(0.0))).alias("ln_p_prose"))

    return _bind(_bind(known, measured), judged)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind number, end), end exclusive, in code points, sorted.

    base holds the fixed forms: `assign` (the whole match of keyword, separator and value, where the value is long
    enough), `access` and `hex`. spans adds `random`: runs of 20 or more credential characters, not inside a base
    span. Each of these is tested twice (see _tests), and both families of p-values are held against Benjamini-Hochberg lines over all
    candidates of the corpus of like length: a candidate whose randomness the battery rejects there isn't a key, so that of
    the candidates thrown out FALSE_DISCOVERIES at most are random; of the others those whose being prose is rejected are
    reported, so that of these FALSE_DISCOVERIES at most are prose. The lines come from histograms of p-values in steps of 1 / STEPS of a power of
    ten: a few hundred numbers per stratum.

    Null and empty texts have no spans; ids may be null or repeat; extra columns are ignored. All work on a text is
    done in its own row, so no shuffle carries texts or depends on how many matches a text or source has."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    found = start.select(
        "doc_id",
        F.filter(_matches(F.col("text"), ASSIGN, F.contains("text", F.lit("=")) | F.contains("text", F.lit(":")), 2), lambda m: F.length(m["text"]) >= ASSIGN_LEAST).alias("assign"),
        _matches(F.col("text"), ACCESS, F.contains("text", F.lit("AKIA"))).alias("access"),
        _matches(F.col("text"), HEX, F.lit(True)).alias("hex"),
        _matches(F.col("text"), CANDIDATE, F.lit(True)).alias("cand"),
    )
    as_kind = lambda name, i: F.transform(name, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end")))
    base = F.array_sort(F.concat(*[as_kind(name, i) for i, name in enumerate(KINDS[:3])]))
    found = found.select("doc_id", base.alias("base"), "cand")
    outside = lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"]))
    tested = F.transform(F.filter("cand", outside), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _tests(m["text"]).alias("t")))
    found = materialize(found.select("doc_id", "base", F.when(F.size("cand") > 0, tested).otherwise(F.array()).cast("array<struct<start:int,end:int,t:struct<encoding:string,p_random:double,ln_p_prose:double>>>").alias("cand")), "secret-spans")

    def stratum(m: Column) -> Column:
        out = F.lit(0)
        for i, least in enumerate(STRATA):
            out = F.when(m["end"] - m["start"] >= least, i).otherwise(out)
        return out

    step = lambda ln_p: F.greatest(F.lit(0), F.least(F.floor(-ln_p * STEPS / math.log(10)), F.lit(MOST))).cast("int")
    noise = lambda m: step(F.ln(F.greatest(m["t"]["p_random"], F.lit(1e-300))))
    prose = lambda m: step(m["t"]["ln_p_prose"])
    each = found.where(F.size("cand") > 0).select(F.explode(F.filter("cand", lambda m: m["t"]["encoding"].isNotNull())).alias("m"))
    each = each.select(F.explode(F.array(*[F.struct(F.lit(k).alias("test"), stratum(F.col("m")).alias("stratum"), f(F.col("m")).alias("step")) for k, f in enumerate((noise, prose))])).alias("c"))
    histogram: dict[tuple[int, int], dict[int, int]] = {}
    for r in each.groupBy("c.test", "c.stratum", "c.step").count().collect():  # 2 * len(STRATA) * (MOST + 1) rows at most
        histogram.setdefault((r[0], r[1]), {})[r[2]] = r[3]
    line = lambda k, m: F.array(*[F.lit(discovery_line(histogram.get((k, i), {}), STEPS)) for i in range(len(STRATA))])[stratum(m)]
    random = F.filter("cand", lambda m: m["t"]["encoding"].isNotNull() & (noise(m) < line(0, m)) & (prose(m) >= line(1, m)))
    added = F.transform(random, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def discovery_line(counts: dict[int, int], steps: int = 1) -> int:
    """Least b such that rejecting all p-values of 10^(-b / steps) and less keeps to the Benjamini-Hochberg line; one more than the greatest of them if none does."""
    most = max([300 * steps, *counts])
    m, best, above = sum(counts.values()), most + 1, 0
    for b in range(most, 0, -1):
        above += counts.get(b, 0)
        if above and 10.0 ** (-b / steps) <= FALSE_DISCOVERIES * above / m:
            best = b
    return best


def written(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
