"""Frequency tables and information measures on small literals."""

import math

import pytest
from pyspark.sql import functions as F

from margrave.functions.info import chi2_cdf, logarithm
from margrave.operators import counts as ct
from margrave.operators import information as inf


@pytest.fixture(scope="module")
def pets(spark):
    rows = [("cat", "s"), ("cat", "s"), ("cat", "l"), ("cat", "s"), ("dog", "l"), ("dog", "l"), ("dog", "s"), ("mouse", None)]
    return spark.createDataFrame(rows, "animal string, size string").cache()


def as_map(df, *keys, value="n"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_counts_and_probabilities(pets):
    pmf = ct.pmf(pets, "animal")
    assert as_map(pmf, "animal") == {("cat",): 4, ("dog",): 3, ("mouse",): 1}
    assert as_map(pmf, "animal", value="p")[("dog",)] == 3 / 8
    assert ct.probability(pmf, animal="dog") == 3 / 8 and ct.probability(pmf, animal="emu") == 0
    assert as_map(ct.pmf(pets, "size"), "size")[(None,)] == 1


def test_marginals_and_conditions(pets):
    joint = ct.pmf(pets, "animal", "size")
    assert ct.pmf_equal(ct.marginalize(joint, "size"), ct.pmf(pets, "animal"))
    cond = ct.condition_on(joint, "animal")
    assert ct.probability(ct.given(cond, animal="cat"), size="s") == 0.75
    assert ct.given(cond, animal="emu").count() == 0
    assert ct.pmf_equal(cond.select("animal", "size", "p_cond"), ct.conditional_pmf(pets, ["size"], ["animal"]).select("animal", "size", "p_cond"))
    with pytest.raises(ValueError):
        ct.condition_on(joint)
    with pytest.raises(ValueError):
        ct.marginalize(joint, "colour")


def test_entropy_golden(pets):
    assert ct.entropy(pets, "animal").first().h == pytest.approx(0.97431475, abs=1e-8)
    assert ct.entropy(pets, "animal", base=2).first().h == pytest.approx(1.40563906, abs=1e-8)
    many = {tuple(r.vars): r.h for r in ct.entropies(pets, [["animal"], ["size", "animal"], ["size"]]).collect()}
    for s, h in many.items():
        assert h == pytest.approx(ct.entropy(pets, *s).first().h)


def test_queries_and_tables(pets):
    assert ct.query_count(pets, {"animal": "cat", "size": "s"}) == 3
    assert ct.query_count(ct.value_counts(pets, "animal", "size"), {"size": None}) == 1
    assert ct.query(pets, {"size": "l"}, {"animal": "dog"}) == 2 / 3
    with pytest.raises(ZeroDivisionError):
        ct.query(pets, {"size": "l"}, {"animal": "emu"})
    zeros = as_map(ct.contingency(pets, ["animal", "size"], zeros=True), "animal", "size")
    assert len(zeros) == 9 and zeros["mouse", "l"] == 0 and zeros["mouse", None] == 1 and sum(zeros.values()) == 8
    assert as_map(ct.contingency(pets, ["animal"], zeros={"animal": ["cat", "emu"]}), "animal") == {("cat",): 4, ("emu",): 0}
    assert {(r.col, r.value, r.n) for r in ct.most_common_value(pets, "animal", "size").collect()} == {("animal", "cat", 4), ("size", "s", 4)}


def test_tied_most_common_value_is_the_smallest(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,), (2,)], "v int")
    assert ct.most_common_value(df, "v").first().value == "1"


def test_algebra(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 7)], "k int, s string, n long")
    b = spark.createDataFrame([(1, "x", 2), (3, "z", 1)], "k int, s string, n long")
    assert as_map(ct.combine(a, b), "k", "s") == {(1, "x"): 7, (2, "y"): 7}
    assert as_map(ct.combine(a, b, -1), "k", "s") == {(1, "x"): 3, (2, "y"): 7}
    assert as_map(ct.union_tables(a, b), "k", "s") == {(1, "x"): 2, (2, "y"): 7, (3, "z"): 1}
    assert ct.append_constant(a, "c", 0, 1).columns == ["k", "c", "s", "n"]
    assert ct.drop_leftmost(a).columns == ["s", "n"] and ct.reorder(a, "s", "k").columns == ["s", "k", "n"]
    # a category -1 is a category like any other
    c = spark.createDataFrame([(-1, 5)], "k int, n long")
    assert as_map(ct.combine(c, c), "k") == {(-1,): 10}
    with pytest.raises(ValueError):
        ct.reorder(a, "s")


def plain_exact(pmf, n):
    out, left, keys = {}, n, sorted(pmf, key=lambda k: (-pmf[k], k))
    while left > 0:
        share = left
        for k in keys:
            take = min(left, max(1, round(share * pmf[k])))
            out[k] = out.get(k, 0) + take
            left -= take
            if not left:
                break
    return out


@pytest.mark.parametrize("n", [1, 3, 10, 77, 1000])
def test_exact_instances(spark, n):
    pmf = {"a": 0.37, "b": 0.37, "c": 0.25, "d": 0.005, "e": 0.005}
    df = spark.createDataFrame(list(pmf.items()), "k string, p double")
    assert {r.k: r.n for r in ct.exact_instances(df, n).collect()} == plain_exact(pmf, n)


def test_min_sample_size_rounds_half_to_even(spark):
    assert ct.min_sample_size(spark.createDataFrame([(1, 0.4), (2, 0.6)], "k int, p double")) == 2
    assert ct.min_sample_size(spark.createDataFrame([(1, 0.0), (2, 1 / 7)], "k int, p double")) == 7


#: Pairs of vectors of eight with their mutual information in bits.
PAIRS = [("10000000", "10000000", 0.5435644431), ("10101010", "10101010", 1.0), ("11000000", "01000000", 0.2935644431), ("11110000", "11000011", 0.0)]


@pytest.mark.parametrize(("x", "y", "mi"), PAIRS)
def test_mutual_information_golden(spark, x, y, mi):
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)], "x int, y int")
    want = sum(p * math.log2(p / (px * py)) for a in "01" for b in "01" if (p := sum(s == a + b for s in map("".join, zip(x, y, strict=True))) / 8) for px in [x.count(a) / 8] for py in [y.count(b) / 8])
    assert inf.mutual_information(df, "x", "y").first().mi == pytest.approx(want, abs=1e-10)
    if x == y:
        assert want == pytest.approx(mi, abs=1e-9)
    assert inf.mutual_information(df, "y", "x").first().mi == pytest.approx(want, abs=1e-10)
    assert inf.binary_mutual_information(df, ["x"], "y").first().mi == pytest.approx(want, abs=1e-10)
    assert inf.information_gains(df, "y", ["x"]).first().mi == pytest.approx(want, abs=1e-10)
    assert inf.conditional_mutual_information(df, "x", "y", [], base=2).first().cmi == pytest.approx(want, abs=1e-10)


def test_logarithms():
    with pytest.raises(AssertionError):
        logarithm(3)
    assert logarithm(2) is F.log2 and logarithm("e") is F.ln


def test_chi2_cdf(spark):
    df = spark.createDataFrame([(3.841458820694124, 1), (0.0, 3), (-1e-12, 2), (23.68479130484058, 14)], "g double, k long")
    assert [r.p for r in df.select(chi2_cdf(F.col("g"), F.col("k")).alias("p")).collect()] == pytest.approx([0.95, 0, 0, 0.95], abs=1e-9)
