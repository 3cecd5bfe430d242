"""Experiments: lockable folders, runs of algorithms, data points, and summaries of what was run."""

from __future__ import annotations

import json
import logging
import math
import shutil
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from margrave.dataset import Dataset, SplitDataset
from margrave.errors import ExperimentLockedError, LockedPathError


class LockablePath:
    """A folder, wherever Hadoop's file systems reach, that empty files named MARK + kind lock.

    Without a session the path is one of the driver's machine, and Python's own file functions are used."""

    MARK = "locked_"

    def __init__(self, repository: str | Path, folder: str, kind: str = "folder", spark: SparkSession | None = None):
        root = str(repository).rstrip("/") or "/"
        self.url, self.kind = f"{root}/{folder}" if folder else root, kind
        self.files = _HadoopFiles(spark) if spark is not None else _LocalFiles()

    @property
    def path(self) -> Path:
        """The folder on the driver's machine."""
        return Path(self.url.removeprefix("file://"))

    def exists(self) -> bool:
        return self.files.exists(self.url)

    def create(self) -> None:
        self.files.mkdirs(self.url)

    def locks(self) -> list[str]:
        return sorted(n[len(self.MARK) :] for n in self.files.names(self.url) if n.startswith(self.MARK))

    def locked(self, kind: str = "") -> bool:
        """Whether it has a lock of this kind; without a kind, any lock."""
        found = self.locks()
        return kind in found if kind else bool(found)

    def lock(self, kind: str = "") -> None:
        self.create()
        self.files.touch(f"{self.url}/{self.MARK}{kind or self.kind}")

    def unlock(self, kind: str = "") -> None:
        self.files.remove(f"{self.url}/{self.MARK}{kind or self.kind}")

    def delete(self, part: str = "") -> None:
        """Remove the folder, or a part of it, unless it is locked or isn't there."""
        target = f"{self.url}/{part}" if part else self.url
        if self.locked():
            raise LockedPathError(f"{self.url} is locked: {', '.join(self.locks())}")
        if not self.files.exists(target):
            raise LockedPathError(f"{target} doesn't exist")
        self.files.remove(target)

    def delete_subfolder(self, name: str) -> None:
        self.delete(name)


class _HadoopFiles:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, url: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(url)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, url: str) -> bool:
        fs, p = self._at(url)
        return fs.exists(p)

    def mkdirs(self, url: str) -> None:
        fs, p = self._at(url)
        fs.mkdirs(p)

    def names(self, url: str) -> list[str]:
        fs, p = self._at(url)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def touch(self, url: str) -> None:
        fs, p = self._at(url)
        fs.create(p, True).close()

    def remove(self, url: str) -> None:
        fs, p = self._at(url)
        fs.delete(p, True)


class _LocalFiles:
    @staticmethod
    def exists(url: str) -> bool:
        return Path(url).exists()

    @staticmethod
    def mkdirs(url: str) -> None:
        Path(url).mkdir(parents=True, exist_ok=True)

    @staticmethod
    def names(url: str) -> list[str]:
        return [p.name for p in Path(url).iterdir()] if Path(url).is_dir() else []

    @staticmethod
    def touch(url: str) -> None:
        Path(url).touch()

    @staticmethod
    def remove(url: str) -> None:
        if Path(url).is_dir():
            shutil.rmtree(url)
        else:
            Path(url).unlink(missing_ok=True)


@dataclass
class DatasetDefinition:
    """How a dataset is made: a source, and options of its split."""

    name: str
    path: str
    source: Callable[[], object]
    options: object = None
    tags: Sequence[str] = ()
    auto_lock: bool = True


@dataclass
class DataPoint:
    """One run of an algorithm."""

    id: str
    algorithm: str
    params: dict[str, str]
    target: str | None
    boundary: list[str]
    start_s: float
    end_s: float
    evaluation: dict[str, int] = field(default_factory=dict)

    @property
    def duration_s(self) -> float:
        return self.end_s - self.start_s


DATAPOINTS = "id string, algorithm string, params map<string,string>, target string, boundary array<string>, start_s double, end_s double, duration_s double, evaluation map<string,bigint>"


@dataclass
class Experiment:
    """Runs: dictionaries of parameters with 'id', 'algorithm' (a callable of dataset and parameters), and what it takes; 'skip' leaves one out, 'tags' name groups.

    A folder is locked when all runs are done; a locked experiment doesn't run again."""

    name: str
    path: str
    dataset: Callable[[], Dataset | SplitDataset]
    runs: Sequence[Mapping]
    auto_lock: bool = True

    def folder(self) -> LockablePath:
        return LockablePath(self.path, self.name, "experiment")

    def run(self, spark: SparkSession) -> list[DataPoint]:
        folder = self.folder()
        folder.create()
        if folder.locked("experiment"):
            raise ExperimentLockedError(f"{self.name} is locked")
        data, out = self.dataset(), []
        for i, params in enumerate(self.runs):
            if params.get("skip"):
                continue
            own = {"id": f"run_{i}", "index": i, **params}
            with run_log(folder.path / "logs" / f"{own['id']}.log") as log:
                log.info("begin %s", own["id"])
                began = time.time()
                found = own["algorithm"](data, own)
                boundary, evaluation = found if isinstance(found, tuple) else (found, {})
                point = DataPoint(str(own["id"]), getattr(own["algorithm"], "__name__", "algorithm"), plain(own), own.get("target"), list(boundary), began, time.time(), dict(evaluation))
                log.info("end %s: %s", own["id"], point.boundary)
            out.append(point)
        save_datapoints(spark, out, str(folder.path / "datapoints"))
        if self.auto_lock:
            folder.lock("experiment")
        return out


def plain(params: Mapping) -> dict[str, str]:
    """Parameters as text; callables by their names."""
    return {k: getattr(v, "__name__", type(v).__name__) if callable(v) else v if isinstance(v, str) else json.dumps(v, default=str) for k, v in params.items()}


class run_log:
    """A logger that also writes to a file, while the context lasts."""

    def __init__(self, *paths: Path):
        self.paths, self.log = paths, logging.getLogger("margrave.run")

    def __enter__(self) -> logging.Logger:
        self.handlers = []
        for p in self.paths:
            p.parent.mkdir(parents=True, exist_ok=True)
            self.handlers.append(logging.FileHandler(p))
            self.log.addHandler(self.handlers[-1])
        self.log.setLevel(logging.INFO)
        return self.log

    def __exit__(self, *_):
        for h in self.handlers:
            self.log.removeHandler(h)
            h.close()


def save_datapoints(spark: SparkSession, points: Sequence[DataPoint], path: str) -> None:
    rows = [(p.id, p.algorithm, p.params, p.target, p.boundary, p.start_s, p.end_s, p.duration_s, p.evaluation) for p in points]
    spark.createDataFrame(rows, DATAPOINTS).coalesce(1).write.mode("append").parquet(path)


def by_tag(runs: Iterable[Mapping], tag: str) -> list[Mapping]:
    return [r for r in runs if tag in r.get("tags", ())]


def by_range(runs: Sequence[Mapping], which: str) -> list[Mapping]:
    """Runs by place: 'a', or 'a-b' with both ends."""
    first, _, last = which.partition("-")
    return list(runs[int(first) : int(last or first) + 1])


# Summaries.


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: tp, tn, fp, fn of 0/1 columns."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))


def boundary_quality(found: DataFrame, true: DataFrame, key: str = "target") -> DataFrame:
    """Per target: errors (size of the symmetric difference), precision (0 for an empty boundary), recall, and distance from (1, 1)."""
    both = found.select(key, F.col("boundary").alias("m")).join(true.select(key, F.col("boundary").alias("t")), key)
    hits = F.size(F.array_intersect("m", "t"))
    both = both.select(key, (F.size(F.array_except("m", "t")) + F.size(F.array_except("t", "m"))).alias("errors"), F.coalesce(F.try_divide(hits, F.size("m")), F.lit(0.0)).alias("precision"), F.try_divide(hits, F.size("t")).alias("recall"))
    return both.withColumn("distance", F.sqrt((1 - F.col("precision")) ** 2 + (1 - F.col("recall")) ** 2))


def conditioning_sizes(results: DataFrame) -> DataFrame:
    """(size, n): tests by the number of conditioning variables."""
    return results.groupBy(F.size("z").alias("size")).agg(F.count("*").alias("n"))


def test_summary(results: DataFrame) -> DataFrame:
    """One row: number of tests, total, mean, largest and median seconds, tests per second, mean conditioning size, share of decisions that agree with d-separation."""
    d = F.col("duration_s")
    return results.agg(
        F.count("*").alias("tests"), F.sum(d).alias("total_s"), F.avg(d).alias("mean_s"), F.max(d).alias("max_s"), F.median(d).alias("median_s"),
        F.try_divide(F.count("*"), F.sum(d)).alias("tests_per_s"), F.avg(F.size("z")).alias("mean_size"), F.avg(F.when(F.col("dsep").isNotNull(), F.col("independent").eqNullSafe(F.col("dsep")).cast("int"))).alias("accuracy"),
    )


def running_duration(results: DataFrame, by: str = "idx", duration: str = "duration_s", *keys: str) -> DataFrame:
    """results with `elapsed`: the sum of durations up to each test, within keys."""
    return results.withColumn("elapsed", F.sum(duration).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))


def classify(split: SplitDataset, features: Sequence[str], objective: str) -> DataFrame:
    """Confusion counts on the test rows of a Bernoulli naive Bayes classifier fitted to the training rows."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(features), outputCol="__x")
    ready = lambda d: vectors.transform(d.df.withColumn("__y", F.col(objective).cast("double")))
    model = NaiveBayes(featuresCol="__x", labelCol="__y", predictionCol="__p", modelType="bernoulli").fit(ready(split.train))
    return confusion(model.transform(ready(split.test)), "__y", "__p")


def request_counts(m: int) -> dict[str, object]:
    """Closed forms for all tests over m variables: their number, and how often a joint of each size j is read as XYZ, XZ or YZ, and Z."""
    return {"tests": m * (m - 1) // 2 * 2 ** max(0, m - 2), "reads": {j: {"xyz": math.comb(j, 2), "xz_yz": j * (m - j), "z": math.comb(m - j, 2)} for j in range(m + 1)}}


def describe(definition: DatasetDefinition) -> dict:
    return {k: v for k, v in asdict(definition).items() if k != "source"}
