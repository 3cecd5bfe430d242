"""Frequency tables: plain DataFrames of key columns, n (count) and p (probability)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from margrave.functions.info import entropy_term
from margrave.storage import before, ranged

#: Probabilities this close count as equal.
TOLERANCE = 1e-10
#: Values of a column that are broadcast, at most.
BROADCAST_VALUES = 100_000


def keys_of(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in ("n", "p", "p_cond")]


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Each combination of values with its count. Nulls are a value of their own; no columns: the count of rows."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def normalized(counts: DataFrame) -> DataFrame:
    """counts with p = n / sum of n. The total is one row, broadcast: no window gathers the table in a task."""
    return counts.drop("p").crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__total")))).withColumn("p", F.col("n") / F.col("__total")).drop("__total")


def pmf(df: DataFrame, *cols: str) -> DataFrame:
    return normalized(value_counts(df, *cols))


def add_counts(counts: DataFrame, more: DataFrame) -> DataFrame:
    """Two tables of counts over the same keys as one."""
    keys = keys_of(counts)
    return normalized(counts.select(*keys, "n").unionByName(more.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("n")))


def marginalize(table: DataFrame, *drop: str) -> DataFrame:
    """Sum the dropped variables out."""
    unknown = set(drop) - set(table.columns)
    if unknown:
        raise ValueError(f"no such variables: {sorted(unknown)}")
    own = [c for c in ("n", "p") if c in table.columns]
    return table.groupBy(*[k for k in keys_of(table) if k not in drop]).agg(*[F.sum(c).alias(c) for c in own])


def condition_on(table: DataFrame, *given: str) -> DataFrame:
    """p_cond = p / p(given), a ratio inside partitions of the conditioning variables. Those of probability 0 give no rows."""
    if not given:
        raise ValueError("empty conditioning set")
    total = F.sum("p").over(Window.partitionBy(*given))
    return table.withColumn("__total", total).where("__total > 0").withColumn("p_cond", F.col("p") / F.col("__total")).drop("__total")


def conditional_pmf(df: DataFrame, cols: Sequence[str], given: Sequence[str]) -> DataFrame:
    if not given:
        raise ValueError("empty conditioning set")
    counts = value_counts(df, *given, *cols)
    return counts.withColumn("p_cond", F.col("n") / F.sum("n").over(Window.partitionBy(*given)))


def probability(table: DataFrame, **key) -> float:
    """The probability of a whole key, 0 if it doesn't occur."""
    value = "p_cond" if "p_cond" in table.columns else "p"
    return table.where(_matches(key)).agg(F.coalesce(F.sum(value), F.lit(0.0))).first()[0]


def given(table: DataFrame, **key) -> DataFrame:
    """The conditional table at a condition; without rows if the condition doesn't occur."""
    return table.where(_matches(key)).select(*[k for k in keys_of(table) if k not in key], F.col("p_cond").alias("p"))


def remove_zeros(table: DataFrame) -> DataFrame:
    return table.where(F.col("p" if "p" in table.columns else "n") != 0)


def expected_value(table: DataFrame, f: Callable[[Mapping[str, Column], Column], Column]) -> float:
    """Sum of p f(key, p)."""
    keys = {k: F.col(k) for k in keys_of(table)}
    return table.agg(F.coalesce(F.sum(F.col("p") * f(keys, F.col("p"))), F.lit(0.0))).first()[0]


def entropy(df: DataFrame, *cols: str, base: float | str = "e") -> DataFrame:
    """One row: h, the joint entropy of the columns."""
    return pmf(df, *cols).agg(F.coalesce(F.sum(entropy_term(F.col("p"), base)), F.lit(0.0)).alias("h"))


def entropies(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """(vars, h) in nats of many column sets by one aggregation over grouping sets. 64 columns at most take part."""
    cols = sorted({c for s in sets for c in s})
    sets = [sorted(set(s)) for s in sets]
    cells = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
    name = F.lit(None).cast("array<string>")
    for s in sets:
        gid = sum((c not in s) << (len(cols) - 1 - i) for i, c in enumerate(cols))
        name = F.when(F.col("gid") == gid, F.array(*[F.lit(c) for c in s]).cast("array<string>")).otherwise(name)
    sums = cells.groupBy("gid").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return sums.select(name.alias("vars"), (F.ln("t") - F.col("s") / F.col("t")).alias("h"))


def min_sample_size(table: DataFrame) -> int:
    """Samples that represent every cell of non-zero probability: 1 / min p, rounded half to even."""
    return table.where("p > 0").agg(F.bround(1 / F.min("p")).cast("long")).first()[0]


def domains(df: DataFrame, *cols: str) -> DataFrame:
    """(col, value) of every distinct value, as text, with its rank from 0 in the column's own order."""
    parts = None
    for c in cols or df.columns:
        part = df.select(F.col(c).alias("v")).distinct()
        part = part.select(F.lit(c).alias("col"), F.col("v").cast("string").alias("value"), (F.row_number().over(Window.partitionBy(F.lit(c)).orderBy("v")) - 1).alias("rank"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def most_common_value(df: DataFrame, *cols: str) -> DataFrame:
    """(col, value, n) of each column's most frequent value; the smallest of equally frequent ones."""
    parts = None
    for c in cols:
        best = value_counts(df, c).agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias("v"), F.max("n").alias("n"))
        part = best.select(F.lit(c).alias("col"), F.col("v").cast("string").alias("value"), "n")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _matches(values: Mapping) -> Column:
    out = F.lit(True)
    for c, v in values.items():
        out = out & F.col(c).eqNullSafe(F.lit(v))
    return out


def query_count(df: DataFrame, values: Mapping) -> int:
    """Rows that have all these values; of a table of counts, the sum of their n."""
    rows = df.where(_matches(values))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if "n" in df.columns else rows.count()


def query(df: DataFrame, values: Mapping, given: Mapping | None = None) -> float:
    """P(values | given) in one pass. A condition that doesn't occur raises ZeroDivisionError."""
    both, cond = _matches({**(given or {}), **values}), _matches(given or {})
    a, b = df.agg(F.count_if(both), F.count_if(cond)).first()
    return a / b


def contingency(df: DataFrame, cols: Sequence[str], zeros: Mapping[str, Sequence] | bool = False) -> DataFrame:
    """Counts of value combinations. zeros: also the combinations that don't occur, of the observed values or of the given domains."""
    counts = value_counts(df, *cols)
    if zeros is False:
        return counts
    cells = None
    for c in cols:
        own = df.select(c).distinct() if zeros is True or c not in zeros else df.sparkSession.createDataFrame([(v,) for v in zeros[c]], df.select(c).schema)
        cells = own if cells is None else cells.crossJoin(F.broadcast(own) if own.count() <= BROADCAST_VALUES else own)  # the whole grid is the result
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"g.{c}").eqNullSafe(F.col(f"t.{c}"))
    return cells.alias("g").join(counts.alias("t"), same, "left").select(*[F.col(f"g.{c}").alias(c) for c in cols], F.coalesce("t.n", F.lit(0)).alias("n"))


# Algebra of tables of counts.


def append_constant(table: DataFrame, name: str, value, at: int | None = None) -> DataFrame:
    """A constant key column before position `at`; last by default."""
    keys = keys_of(table)
    at = len(keys) if at is None else at
    return table.withColumn(name, F.lit(value)).select(*keys[:at], name, *keys[at:], "n")


def drop_leftmost(table: DataFrame) -> DataFrame:
    """Without the first key column; keys that become equal stay apart, as they are in one stratum already."""
    return table.select(*keys_of(table)[1:], "n")


def reorder(table: DataFrame, *keys: str) -> DataFrame:
    if sorted(keys) != sorted(keys_of(table)):
        raise ValueError(f"{keys} aren't the keys {keys_of(table)}")
    return table.select(*keys, "n")


def union_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """All keys of both; the right table's count wins."""
    keys = keys_of(left)
    return left.join(right.select(*keys), keys, "left_anti").unionByName(right.select(*left.columns))


def combine(left: DataFrame, right: DataFrame, sign: int = 1) -> DataFrame:
    """left plus (or minus) right at the keys of left; keys of right alone don't appear."""
    keys = keys_of(left)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return left.alias("a").join(right.alias("b"), same, "left").select(*[F.col(f"a.{k}").alias(k) for k in keys], (F.col("a.n") + sign * F.coalesce("b.n", F.lit(0))).alias("n"))


def regroup(table: DataFrame, *by: str) -> DataFrame:
    """A row for each `by`, with the other keys and counts as a sorted array."""
    rest = [k for k in keys_of(table) if k not in by]
    return table.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest, "n"))).alias("cells"))


def exact_instances(table: DataFrame, n: int) -> DataFrame:
    """Keys with how often each stands in a list of n instances in proportion to p.

    Keys come by falling p, ties by key. Each takes max(1, round half to even of n p) of what is left; what then
    remains is dealt out again in the same way. Sums run over the table's keys, not over instances."""
    keys = keys_of(table)
    spark, left, parts = table.sparkSession, n, None
    rows = ranged(table.where("p > 0").select(*keys, "p"), F.desc("p"), *keys)
    while left > 0:
        wish = F.greatest(F.lit(1), F.bround(F.lit(left) * F.col("p"))).cast("long")
        part = before(rows.withColumn("w", wish), F.col("w"), "b").select(*keys, F.greatest(F.least(F.col("w"), F.lit(left) - F.col("b")), F.lit(0)).cast("long").alias("n"))
        taken = part.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not taken:
            break
        parts, left = part if parts is None else parts.unionByName(part), left - taken
    if parts is None:
        return spark.createDataFrame([], table.select(*keys).schema.add("n", "long"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def pmf_diff(left: DataFrame, right: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Keys whose probabilities differ by more than tolerance, or that only one table has: p_left, p_right."""
    keys = [k for k in keys_of(left)]
    value = "p_cond" if "p_cond" in left.columns else "p"
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = left.alias("a").join(right.alias("b"), same, "full_outer")
    a, b = F.col(f"a.{value}"), F.col(f"b.{value}")
    return both.where(a.isNull() | b.isNull() | (F.abs(a - b) > tolerance)).select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], a.alias("p_left"), b.alias("p_right"))


def pmf_equal(left: DataFrame, right: DataFrame, tolerance: float = TOLERANCE) -> bool:
    return pmf_diff(left, right, tolerance).isEmpty()
