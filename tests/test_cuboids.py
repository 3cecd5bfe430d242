"""Stored counts against plain scans."""

import random

import pytest

from margrave.operators import counts as ct
from margrave.operators.cuboids import CuboidCache


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(rng.randrange(3), rng.choice("xy"), rng.choice([None, 1, 2]), i) for i in range(400)], "a int, b string, c int, i int").cache()


COLS = ["a", "b", "c", "i"]


def test_rolled_up_counts_equal_scans(spark, df):
    cache = CuboidCache(df, COLS)
    cache.build([["a", "b", "c"]])
    assert cache.scans == 1
    for cols in (["a"], ["c", "b"], ["b", "a", "c"], []):
        assert cache.counts(*cols).exceptAll(ct.value_counts(df, *sorted(cols))).isEmpty()
    assert cache.scans == 1 and frozenset(["a"]) in cache.stored
    assert ct.pmf_equal(cache.pmf("a", "c"), ct.pmf(df, "a", "c"))
    assert cache.query_count({"a": 1, "b": "x"}) == df.where("a = 1 and b = 'x'").count() and cache.query_count({}) == 400
    assert cache.query({"c": None}, {"b": "y"}) == df.where("b = 'y' and c is null").count() / df.where("b = 'y'").count()
    with pytest.raises(ZeroDivisionError):
        cache.query({"a": 1}, {"b": "none"})
    with pytest.raises(ValueError):
        cache.counts("zz")


def test_sets_that_compress_nothing_are_not_stored(df):
    cache = CuboidCache(df, COLS)
    assert cache.counts("i").count() == 400 and frozenset(["i"]) not in cache.stored


def test_saved_cuboids_come_back(spark, df, tmp_path):
    cache = CuboidCache(df, COLS, path=f"file://{tmp_path}/c")
    cache.build([["a", "b"], ["c"]])
    cache.save_catalogue()
    again = CuboidCache.load(spark, df, COLS, f"file://{tmp_path}/c")
    assert again.counts("a").exceptAll(ct.value_counts(df, "a")).isEmpty() and again.scans == 0 and set(again.stored) >= set(cache.stored)
