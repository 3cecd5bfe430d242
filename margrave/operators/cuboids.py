"""Stored counts of column sets, from which counts of their subsets are rolled up."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margrave.operators.counts import normalized, query_count


class CuboidCache:
    """Counts by column set over one dataset.

    A set asked for is rolled up from the smallest stored set that contains it, or counted from the rows; it is then
    stored itself if its cells are fewer than `admit` times what it was counted from. `build` stores sets ahead of time
    (a static index); without it the cache grows with what is asked (a dynamic one). Stored tables are cached, or written
    under `path`, from where `load` takes them up again."""

    def __init__(self, df: DataFrame, columns: Sequence[str], admit: float = 0.5, path: str | None = None):
        self.df, self.columns, self.admit, self.path = df, list(columns), admit, path
        self.stored: dict[frozenset[str], tuple[DataFrame, int]] = {}
        self.rows = df.count()
        self.hits = self.scans = 0

    def _source(self, cols: frozenset[str]) -> tuple[DataFrame | None, int]:
        fits = [(n, sorted(s), t) for s, (t, n) in self.stored.items() if cols <= s]
        return (min(fits, key=lambda x: x[:2])[2], min(fits, key=lambda x: x[:2])[0]) if fits else (None, self.rows)

    def counts(self, *cols: str) -> DataFrame:
        """(cols in sorted order, n)."""
        key = frozenset(cols)
        unknown = key - set(self.columns)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        if key in self.stored:
            self.hits += 1
            return self.stored[key][0]
        source, size = self._source(key)
        if source is None:
            self.scans += 1
            table = self.df.groupBy(*sorted(key)).agg(F.count("*").alias("n"))
        else:
            self.hits += 1
            table = source.groupBy(*sorted(key)).agg(F.sum("n").alias("n"))
        return self._admitted(key, table, size)

    def _admitted(self, key: frozenset[str], table: DataFrame, size: int) -> DataFrame:
        table = table.cache()
        cells = table.count()
        if key and cells >= self.admit * max(size, 1):
            table.unpersist()
            return table
        if self.path:
            name = f"{self.path}/{'+'.join(sorted(key)) or 'all'}"
            table.write.mode("overwrite").parquet(name)
            table.unpersist()
            table = self.df.sparkSession.read.parquet(name)
        self.stored[key] = (table, cells)
        return table

    def build(self, sets: Sequence[Sequence[str]]) -> None:
        """Store counts of these sets, larger ones first, so that smaller ones are rolled up from them."""
        for s in sorted(sets, key=lambda s: (-len(set(s)), sorted(s))):
            self.counts(*s)

    def contingency(self, *cols: str) -> DataFrame:
        return self.counts(*cols)

    def pmf(self, *cols: str) -> DataFrame:
        """Probabilities with keys in sorted column order."""
        return normalized(self.counts(*cols))

    def query_count(self, values: Mapping) -> int:
        """Rows with all these values; of no values, all rows."""
        return query_count(self.counts(*values), values) if values else self.rows

    def query(self, values: Mapping, given: Mapping | None = None) -> float:
        """P(values | given). A condition that doesn't occur raises ZeroDivisionError."""
        given = dict(given or {})
        return self.query_count({**given, **values}) / self.query_count(given)

    def save_catalogue(self) -> None:
        """List the stored sets beside their tables."""
        rows = [(json.dumps(sorted(s)), n) for s, (_, n) in self.stored.items()]
        self.df.sparkSession.createDataFrame(rows, "cols string, cells long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/catalogue")

    @classmethod
    def load(cls, spark: SparkSession, df: DataFrame, columns: Sequence[str], path: str, admit: float = 0.5) -> CuboidCache:
        out = cls(df, columns, admit, path)
        for r in spark.read.parquet(f"{path}/catalogue").collect():
            cols = json.loads(r["cols"])
            out.stored[frozenset(cols)] = (spark.read.parquet(f"{path}/{'+'.join(cols) or 'all'}"), r["cells"])
        return out
