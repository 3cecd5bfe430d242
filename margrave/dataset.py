"""Discrete datasets: a DataFrame with a catalogue of feature and objective columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margrave.errors import DatasetFinalizedError, DatasetNotFinalizedError, UnequalCounts
from margrave.storage import numbered

ROW, LABEL = "row_id", "row_label"


@dataclass
class Dataset:
    """Rows are samples. `features` (X) and `objectives` (Y) name columns of `df`, which also has row_id and may have row_label.

    Edits give new datasets and leave the old ones as they are; a finalized dataset refuses them, and only a finalized
    one is saved. Values are discrete; null counts as a value of its own."""

    df: DataFrame
    features: list[str]
    objectives: list[str] = field(default_factory=list)
    label: str = "dataset"
    final: bool = False
    metadata: dict = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str] | None = None, objectives: Sequence[str] = (), label: str = "dataset") -> Dataset:
        features = [c for c in df.columns if c not in (ROW, LABEL, *objectives)] if features is None else list(features)
        return cls(df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id()), features, list(objectives), label)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def labels(self, role: str) -> list[str]:
        if role not in ("X", "Y"):
            raise ValueError(f"a dataset has columns X and Y, not {role!r}")
        return self.features if role == "X" else self.objectives

    def row_count(self) -> int:
        return self.df.count()

    def column_count(self, role: str) -> int:
        return len(self.labels(role))

    def column(self, role: str, at: int) -> DataFrame:
        return self.df.select(self.labels(role)[at])

    def column_by_label(self, role: str, name: str) -> DataFrame:
        if name not in self.labels(role):
            raise ValueError(f"no column {name!r} in {role}")
        return self.df.select(name)

    def variables(self, role: str, at: int | Sequence[int] | None):
        """One column for a number or a list of one, a struct of several, None for None."""
        if at is None:
            return None
        at = [at] if isinstance(at, int) else list(at)
        cols = [F.col(self.labels(role)[i]) for i in at]
        return cols[0] if len(cols) == 1 else F.struct(*cols)

    def info(self) -> dict:
        return {"label": self.label, "rows": self.row_count(), "X": len(self.features), "Y": len(self.objectives), "final": self.final}

    def values(self, role: str = "X") -> dict[str, list]:
        """The sorted distinct values of each column."""
        cols = self.labels(role)
        row = self.df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols]).first() if cols else {}
        return {c: list(row[c]) for c in cols}

    # Edits.

    def _changed(self, **parts) -> Dataset:
        if self.final:
            raise DatasetFinalizedError(f"{self.label} is finalized")
        return replace(self, **parts)

    def _copied(self, label: str, **parts) -> Dataset:
        return replace(self, label=label or self.label, final=False, **parts)

    def _only(self, features: Sequence[str], objectives: Sequence[str]) -> dict:
        gone = [c for c in (*self.features, *self.objectives) if c not in (*features, *objectives)]
        return {"df": self.df.drop(*gone), "features": list(features), "objectives": list(objectives)}

    def select_columns(self, at: Sequence[int], label: str = "") -> Dataset:
        """Keep these features, in column order, and all objectives."""
        if not isinstance(at, list):
            raise TypeError("columns are given as a list")
        if not at:
            raise ValueError("no columns are left")
        return self._copied(label, **self._only([self.features[i] for i in sorted(set(at))], self.objectives))

    def delete_columns(self, role: str, at: int | Sequence[int]) -> Dataset:
        at = {at} if isinstance(at, int) else set(at)
        kept = [c for i, c in enumerate(self.labels(role)) if i not in at]
        return self._changed(**self._only(*((kept, self.objectives) if role == "X" else (self.features, kept))))

    def _rows(self, rows: Sequence[int], how: str) -> DataFrame:
        wanted = self.spark.createDataFrame([(int(r),) for r in rows], f"{ROW} long")
        return self.df.join(wanted.distinct(), ROW, how)

    def select_rows(self, rows: Sequence[int], label: str = "") -> Dataset:
        return self._copied(label, df=self._rows(rows, "left_semi"))

    def keep_rows(self, rows: Sequence[int]) -> Dataset:
        """Labels stay with their rows, in whatever order rows are given."""
        return self._changed(df=self._rows(rows, "left_semi"))

    def delete_rows(self, rows: Sequence[int]) -> Dataset:
        return self._changed(df=self._rows(rows, "left_anti"))

    def finalized(self) -> Dataset:
        return replace(self, final=True)

    def joined(self, other: Dataset) -> Dataset:
        """Both datasets' columns side by side, by row_id. Unequal rows raise UnequalCounts."""
        if self.row_count() != other.row_count():
            raise UnequalCounts(f"{self.label} and {other.label} have unequal numbers of rows")
        df = self.df.join(other.df.drop(LABEL), ROW)
        return self._copied("", df=df, features=[*self.features, *other.features], objectives=[*self.objectives, *other.objectives])

    # Comparison, storage.

    def equals(self, other: Dataset) -> bool:
        return not self.diff(other)

    def diff(self, other: Dataset) -> list[str]:
        """What differs: names of parts."""
        out = [n for n in ("features", "objectives") if getattr(self, n) != getattr(other, n)]
        if out:
            return out
        cols = [c for c in (ROW, LABEL) if c in self.df.columns and c in other.df.columns] + self.features + self.objectives
        a, b = self.df.select(cols), other.df.select(cols)
        return [] if a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() else ["rows"]

    def save(self, path: str) -> None:
        """Parquet files and a catalogue, which is written last, under path/label."""
        if not self.final:
            raise DatasetNotFinalizedError(f"{self.label} isn't finalized")
        self.df.write.parquet(f"{path}/{self.label}/rows")
        catalogue = json.dumps({"features": self.features, "objectives": self.objectives, "label": self.label})
        self.spark.createDataFrame([(catalogue,)], "value string").coalesce(1).write.text(f"{path}/{self.label}/catalogue")

    @classmethod
    def load(cls, spark: SparkSession, path: str, label: str) -> Dataset:
        parts = json.loads(spark.read.text(f"{path}/{label}/catalogue").first()[0])
        return cls(spark.read.parquet(f"{path}/{label}/rows"), parts["features"], parts["objectives"], parts["label"], True)


# Splitting and pruning.


@dataclass
class SplitOptions:
    """training_subset_size: share of training rows. thresholds: by matrix ('full', 'train', 'test'), bounds (least, most) of a column's mean that keep it."""

    training_subset_size: float = 0.5
    random_seed: int = 0
    prune_features: bool = False
    prune_objectives: bool = False
    feature_thresholds: dict[str, tuple[float, float]] = field(default_factory=dict)
    objective_thresholds: dict[str, tuple[float, float]] = field(default_factory=dict)


def split_rows(df: DataFrame, train: int, key: str = ROW, seed: int = 0, order=None) -> DataFrame:
    """df with `is_train`, true for exactly `train` rows: those first in the order of a seeded hash, whatever the partitions."""
    order = order or [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]
    return numbered(df, *order, name="__place").withColumn("is_train", F.col("__place") <= train).drop("__place")


def columns_to_remove(data: Dataset, role: str, thresholds: tuple[float, float]) -> dict[int, str]:
    """Columns whose mean is under the first or over the second threshold, all of them from one aggregation."""
    cols = data.labels(role)
    if not cols:
        return {}
    means = data.df.agg(*[(F.sum(c) / F.count("*")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {i: c for i, c in enumerate(cols) if means[i] < thresholds[0] or means[i] > thresholds[1]}


@dataclass
class SplitDataset:
    """A full dataset with its training and test rows; columns are pruned by the full rows before, by both parts after the split."""

    full: Dataset
    train: Dataset
    test: Dataset

    @classmethod
    def build(cls, data: Dataset, options: SplitOptions) -> SplitDataset:
        roles = (("X", options.prune_features, options.feature_thresholds), ("Y", options.prune_objectives, options.objective_thresholds))
        for role, on, thresholds in roles:
            if on and "full" in thresholds:
                data = data.delete_columns(role, set(columns_to_remove(data, role, thresholds["full"])))
        flagged = split_rows(data.df, int(data.row_count() * options.training_subset_size), seed=options.random_seed)
        parts = {"train": replace(data, df=flagged.where("is_train").drop("is_train"), label="dataset_train"), "test": replace(data, df=flagged.where("not is_train").drop("is_train"), label="dataset_test")}
        for role, on, thresholds in roles:
            gone = {i for name, part in parts.items() if on and name in thresholds for i in columns_to_remove(part, role, thresholds[name])}
            if gone:
                data, parts = data.delete_columns(role, gone), {n: p.delete_columns(role, gone) for n, p in parts.items()}
        return cls(data, parts["train"], parts["test"])

    def part(self, label: str) -> Dataset:
        if label not in ("full", "train", "test"):
            raise ValueError("a split dataset has the parts full, train and test")
        return getattr(self, label)

    def save(self, path: str) -> None:
        for part in (self.full, self.train, self.test):
            part.finalized().save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, label: str) -> SplitDataset:
        return cls(*(Dataset.load(spark, path, n) for n in (label, "dataset_train", "dataset_test")))


def load_or_build(spark: SparkSession, path: str, label: str, build: Callable[[], Dataset]) -> Dataset:
    """A saved and locked dataset, or else build() saved and locked. path: wherever Spark reads and writes."""
    from margrave.experiment import LockablePath

    place = LockablePath(path, label, spark=spark)
    if place.exists() and place.locked():
        return Dataset.load(spark, path, label)
    data = build().finalized()
    data = replace(data, label=label)
    data.save(path)
    place.lock("dataset")
    return data
