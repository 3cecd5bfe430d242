"""Batches of G-tests of conditional independence.

A request is (x, y, z): names of two columns and a tuple of conditioning columns. However many requests a batch has,
their contingency tables come from one aggregation: every distinct set of columns is a row of a small literal table,
every sample (or cell of a cuboid) is exploded over these rows and counted under a packed key. Cells then become
statistics, degrees of freedom and p-values inside Spark; only a row per request reaches the driver.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from margrave.errors import InsufficientSamples
from margrave.functions.info import chi2_cdf, sufficient
from margrave.operators.cuboids import CuboidCache
from margrave.storage import written

#: Cells of the joint domain of column sets that are counted together, at most.
UNION_CELLS = 1 << 16
#: Samples from which joint entropies are worth stored cuboids; of fewer it is cheaper to look again.
KEEP_ROWS = 100_000

RESULTS = (
    "idx int, x string, y string, z array<string>, statistic string, g double, dof long, n long, p double, significance double, insufficient boolean, independent boolean, dsep boolean, duration_s double"
)


SCORES = "idx int, heuristic string, x string, y string, z array<string>, value double, duration_s double"


@dataclass(frozen=True)
class Request:
    x: str
    y: str
    z: tuple[str, ...] = ()

    @classmethod
    def of(cls, x: str, y: str, z: Iterable[str] = ()) -> Request:
        return cls(x, y, tuple(sorted(set(z))))

    @property
    def all(self) -> frozenset[str]:
        return frozenset((self.x, self.y, *self.z))


@dataclass
class Result:
    """p is the chi-squared distribution function at g, not its upper tail; independent means p < significance."""

    x: str
    y: str
    z: tuple[str, ...]
    g: float | None = None
    dof: int | None = None
    n: int | None = None
    p: float | None = None
    significance: float | None = None
    insufficient: bool = False
    independent: bool | None = None
    dsep: bool | None = None
    duration_s: float | None = None
    statistic: str = "G"
    idx: int | None = None

    def close_to(self, other: Result, tolerance: float = 1e-11) -> bool:
        return not self.diff(other, tolerance)

    def diff(self, other: Result, tolerance: float = 1e-11) -> list[str]:
        out = [k for k in ("z", "dof", "insufficient", "independent") if getattr(self, k) != getattr(other, k)]
        if {self.x, self.y} != {other.x, other.y}:
            out.append("xy")
        for k in ("g", "p"):
            a, b = getattr(self, k), getattr(other, k)
            if (a is None) != (b is None) or a is not None and abs(a - b) > tolerance:
                out.append(k)
        return out

    def accurate(self) -> bool:
        """Whether the decision is that of d-separation; a test without a decision isn't."""
        return self.dsep is not None and self.independent == self.dsep

    def __str__(self):
        verdict = {True: "⊥", False: "not ⊥", None: "? ⊥"}[self.independent]
        return f"{self.x} {verdict} {self.y} | {'{' + ', '.join(self.z) + '}' if self.z else '∅'}"


@dataclass
class Score:
    """What a ranking heuristic said of candidate y for target x given z."""

    idx: int
    heuristic: str
    x: str
    y: str
    z: tuple[str, ...]
    value: float
    duration_s: float

    def __str__(self):
        return f"{self.heuristic}({self.x}, {self.y} | {'{' + ', '.join(self.z) + '}' if self.z else '∅'}) = {self.value}"


@dataclass
class CITestConfig:
    """strategy: 'direct' counts samples, 'cuboid' rolls counts up from stored cuboids, which grow with what is asked, 'entropy' also reuses joint entropies, 'dsep' asks a network.

    dof: 'structural', 'unadjusted', or a function of a tester, a request and its structural degrees of freedom (null where
    they aren't known, as with 'entropy') to a number. sufficient: columns (n, dof) -> boolean column. admit: a cuboid is
    stored if its cells are fewer than this share of the samples. cuboids: stored counts (a CuboidCache) to start
    with. batch: requests counted by one job."""

    significance: float = 0.95
    strategy: str = "direct"
    dof: str | Callable[[CITester, Request, int | None], int] = "structural"
    sufficient: Callable[[Column, Column], Column] = sufficient
    network: object = None
    admit: float = 0.5
    cuboids: CuboidCache | None = None
    batch: int = 4096
    entropy_path: str | None = None
    cuboid_path: str | None = None
    dof_path: str | None = None
    results_path: str | None = None
    heuristic_results_path: str | None = None


class Codes:
    """Columns as small integers: the place of each value among the column's sorted distinct values; null is a value.

    Distinct values are found in one aggregation per column set and must number at most MAX_DOMAIN: these are discrete data."""

    MAX_DOMAIN = 100_000

    def __init__(self, df: DataFrame, cols: Sequence[str]):
        self.cols, self.at = list(cols), {c: i for i, c in enumerate(cols)}
        sizes = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
        if max(sizes, default=0) > self.MAX_DOMAIN:
            raise ValueError(f"columns of more than {self.MAX_DOMAIN} values aren't discrete data: {[c for c in cols if sizes[c] > self.MAX_DOMAIN]}")
        row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols], *[F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in cols]).first()
        self.domain = {c: ([None] if row[f"null {c}"] else []) + list(row[c]) for c in cols}
        self.schema = df.schema
        self.whole = all(isinstance(v, int) and v == i for c in cols for i, v in enumerate(self.domain[c]))
        self.rows = self.coded(df, cols)

    def coded(self, df: DataFrame, cols: Sequence[str], *more: str) -> DataFrame:
        """An array `c` of the codes of some columns, in this order, and more columns as they are."""
        if self.whole:
            return df.select(F.array(*[F.col(c).cast("int") for c in cols]).alias("c"), *more)
        out, codes = df, []
        for i, c in enumerate(cols):
            values = [v for v in self.domain[c] if v is not None]
            shift = len(self.domain[c]) - len(values)
            if len(values) <= 64:
                place = F.array_position(F.array(*[F.lit(v) for v in values]).cast(T.ArrayType(self.schema[c].dataType)), F.col(c)).cast("int") - 1 + shift if values else F.lit(0)
                codes.append(F.coalesce(place, F.lit(0)))
            else:  # MAX_DOMAIN rows at most
                table = df.sparkSession.createDataFrame(list(enumerate(values, shift)), T.StructType([T.StructField(f"__k{i}", T.IntegerType()), T.StructField(f"__v{i}", self.schema[c].dataType)]))
                out = out.join(F.broadcast(table), F.col(c) == F.col(f"__v{i}"), "left")
                codes.append(F.coalesce(f"__k{i}", F.lit(0)))
        return out.select(F.array(*codes).alias("c"), *more)

    def size(self, c: str) -> int:
        return len(self.domain[c])


def covers(sets: Sequence[tuple[str, ...]], size: Callable[[str], int], limit: float, near: int = 128) -> list[tuple[tuple[str, ...], list[int]]]:
    """Unions of sets whose joint domains have `limit` cells at most, each with the numbers of the sets it covers.

    Greedy: sets come by falling domain; each goes to the one of the `near` latest unions that it widens least, or begins
    its own. A set of a larger domain than the limit is alone."""
    number = {c: i for i, c in enumerate(sorted({c for s in sets for c in s}))}
    wide = {1 << i: max(1, size(c)) for c, i in number.items()}

    def cells(mask: int) -> int:
        out = 1
        while mask:
            out *= wide[mask & -mask]
            mask &= mask - 1
        return out

    masks = [sum(1 << number[c] for c in s) for s in sets]
    found: list[list] = []  # mask, cells, members
    for i in sorted(range(len(sets)), key=lambda i: (-cells(masks[i]), sets[i])):
        best = None
        for u in found[-near:]:
            more = cells(masks[i] & ~u[0])
            if (more == 1 or u[1] * more <= limit) and (best is None or more < best[0]):
                best = (more, u)
                if more == 1:
                    break
        if best:
            best[1][0] |= masks[i]
            best[1][1] *= best[0]
            best[1][2].append(i)
        else:
            found.append([masks[i], cells(masks[i]), [i]])
    names = sorted(number)
    return [(tuple(c for k, c in enumerate(names) if u[0] >> k & 1), u[2]) for u in found]


class Counter:
    """Cells of many column sets, from samples, from a cuboid, or from what was counted before.

    Sets are gathered in unions of small joint domains (see covers): the samples are counted by union, once for each,
    and the sets are rolled up from the unions' cells. With keep the unions' cells are written and later
    sets that they contain are rolled up from them, without a look at the samples: a dynamic index of cuboids. Cuboids
    counted elsewhere can be added. `scans` counts the passes over the samples."""

    def __init__(self, codes: Codes, base: DataFrame, limit: float = 0, keep: bool = False):
        self.codes, self.base, self.limit, self.keep, self.scans = codes, base, limit, keep, 0
        self.stored: list[tuple[tuple[str, ...], int, DataFrame]] = []  # columns, number in the table, table (set, key, n)

    def add(self, cols: Sequence[str], table: DataFrame) -> None:
        """A cuboid: a table of these columns and n."""
        cols = tuple(sorted(cols))
        coded = self.codes.coded(table, cols, "n")
        key = sum((F.col("c")[i].cast("long") * s for i, s in enumerate(self.strides(cols))), F.lit(0).cast("long"))
        self.stored.append((cols, 0, coded.select(F.lit(0).alias("set"), key.alias("key"), "n")))

    def cells(self, sets: Sequence[tuple[str, ...]]) -> DataFrame:
        """(set, key, n); key packs the values' codes in mixed radix, the first column's digit lowest."""
        have = sorted(self.stored, key=lambda x: math.prod(map(self.codes.size, x[0])))
        source = {i: next((x for x in have if set(s) <= set(x[0])), None) for i, s in enumerate(sets)}
        fresh = [i for i in range(len(sets)) if source[i] is None]
        parts = []
        if fresh:
            self.scans += 1
            unions = covers([sets[i] for i in fresh], self.codes.size, self.limit)
            if self.keep or any(len(members) > 1 for _, members in unions):
                table = self._counted([u for u, _ in unions])
                if self.keep:
                    table = written(table, "cuboids")
                    self.stored += [(u, k, table) for k, (u, _) in enumerate(unions) if u]
                parts.append(self._rolled(table, [(fresh[i], sets[fresh[i]], k, u) for k, (u, members) in enumerate(unions) for i in members]))
            else:
                order = [fresh[members[0]] for _, members in unions]
                names = F.array(*[F.lit(i) for i in order])
                parts.append(self._counted([u for u, _ in unions]).withColumn("set", names[F.col("set")]))
        tables: dict[int, list] = {}
        for i, x in source.items():
            if x is not None:
                tables.setdefault(id(x[2]), []).append((i, x))
        for asked in tables.values():
            parts.append(self._rolled(asked[0][1][2], [(i, sets[i], x[1], x[0]) for i, x in asked]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _counted(self, sets: Sequence[tuple[str, ...]]) -> DataFrame:
        """Cells by one aggregation of the samples, each exploded over the sets."""
        width = max((len(s) for s in sets), default=0)
        rows = []
        for i, s in enumerate(sets):
            strides = self.strides(s)
            rows.append({"set": i, **{f"i{k}": self.codes.at[c] for k, c in enumerate(s)}, **{f"s{k}": v for k, v in enumerate(strides)}})
        ddl = "set int" + "".join(f", i{k} int, s{k} bigint" for k in range(width))
        table = F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl.replace(' int', ':int').replace(' bigint', ':bigint')}>>"))
        key = F.lit(0).cast("long")
        for k in range(width):
            key = key + F.when(F.col(f"s.i{k}").isNull(), F.lit(0).cast("long")).otherwise(F.get("c", F.col(f"s.i{k}")).cast("long") * F.col(f"s.s{k}"))
        return self.base.select("c", "n", table.alias("s")).select(F.col("s.set").alias("set"), key.alias("key"), "n").groupBy("set", "key").agg(F.sum("n").alias("n"))

    def _rolled(self, table: DataFrame, asked: Sequence[tuple[int, tuple[str, ...], int, tuple[str, ...]]]) -> DataFrame:
        """Cells of sets (number, columns) from a table's cells of wider ones (number in it, columns)."""
        width, rows = max(len(s) for _, s, _, _ in asked), []
        for i, s, k, wider in asked:
            place, own = dict(zip(wider, self.strides(wider), strict=True)), self.strides(s)
            digits = [(place[c], max(1, self.codes.size(c)), t) for c, t in zip(s, own, strict=True)] + [(1, 1, 0)] * (width - len(s))
            rows.append((k, i, *[v for d in digits for v in d]))
        ddl = "wide int, set int" + "".join(f", d{k} long, m{k} long, s{k} long" for k in range(width))
        plan = self.base.sparkSession.createDataFrame(rows, ddl)  # a batch's sets at most
        key = F.lit(0).cast("long")
        for k in range(width):
            key = key + F.expr(f"((key div d{k}) % m{k}) * s{k}")
        met = table.withColumnRenamed("set", "wide").join(F.broadcast(plan), "wide")
        return met.select("set", key.alias("key"), "n").groupBy("set", "key").agg(F.sum("n").alias("n"))

    def strides(self, s: Sequence[str]) -> list[int]:
        out, stride = [], 1
        for c in s:
            out.append(stride)
            stride *= max(1, self.codes.size(c))
        if stride >= 1 << 62:
            raise ValueError(f"the joint domain of {s} has {stride} cells; keys are packed in 62 bits")
        return out


class CITester:
    """Tests of conditional independence over one dataset, in batches or one by one.

    `results` keeps what was tested and `scores` what heuristics said, in order; `end()` appends them to
    config.results_path and config.heuristic_results_path and stores caches."""

    def __init__(self, df: DataFrame, columns: Sequence[str], config: CITestConfig | None = None):
        self.config, self.columns, self.results, self.scores = config or CITestConfig(), list(columns), [], []
        self.spark: SparkSession = df.sparkSession
        self.entropies: dict[frozenset[str], float] = {frozenset(): 0.0}
        self.reads = self.misses = 0
        self.dofs: dict[tuple[frozenset[str], frozenset[str]], int] = {}
        if self.config.strategy == "dsep":
            self.n = None
            return
        self.codes = Codes(df, self.columns)
        self.n = df.count()
        base, keep = self.codes.rows.withColumn("n", F.lit(1).cast("long")), self.config.strategy in ("cuboid", "entropy")
        if keep:
            base = self._cuboid(base)
        keep &= self.config.strategy == "cuboid" or self.n >= KEEP_ROWS
        self.counter = Counter(self.codes, base, min(self.config.admit * self.n, UNION_CELLS), keep)
        if self.config.cuboids is not None:
            for cols, (table, _) in self.config.cuboids.stored.items():
                if cols and cols <= set(self.columns):
                    self.counter.add(cols, table)
        if self.config.entropy_path:
            self.entropies |= load_entropies(self.spark, self.config.entropy_path)
        if self.config.dof_path:
            self.dofs |= load_dofs(self.spark, self.config.dof_path)

    def _cuboid(self, rows: DataFrame) -> DataFrame:
        """The cells of all columns, stored if they are few enough to be worth it."""
        path = self.config.cuboid_path
        if path and _exists(self.spark, path):
            return self.spark.read.parquet(path)
        cells = rows.groupBy("c").agg(F.sum("n").alias("n"))
        if path:
            cells.write.parquet(path)
            return self.spark.read.parquet(path)
        few = rows.agg(F.approx_count_distinct(F.xxhash64("c"))).first()[0] < self.config.admit * max(self.n, 1)
        return written(cells, "cells") if few else rows

    def test(self, x: str, y: str, z: Iterable[str] = ()) -> Result:
        return self.batch([Request.of(x, y, z)])[0]

    def conditionally_independent(self, x: str, y: str, z: Iterable[str] = ()) -> bool:
        r = self.test(x, y, z)
        if r.insufficient:
            raise InsufficientSamples(r)
        return r.independent

    def batch(self, requests: Sequence[Request]) -> list[Result]:
        """Results in the order of requests, `config.batch` of them to a job."""
        import time

        out, began = [], time.time()
        for lo in range(0, len(requests), self.config.batch):
            part = list(requests[lo : lo + self.config.batch])
            out += [self._separated(r) for r in part] if self.config.strategy == "dsep" else self._tested(part)
        each = (time.time() - began) / max(1, len(out))
        for r in out:
            r.idx, r.duration_s = len(self.results), each
            if self.config.network is not None and r.dsep is None:
                r.dsep = self.config.network.d_separated(r.x, r.z, r.y)
            self.results.append(r)
        return out

    def _separated(self, q: Request) -> Result:
        d = self.config.network.d_separated(q.x, q.z, q.y)
        return Result(q.x, q.y, q.z, independent=d, dsep=d, significance=self.config.significance, statistic="d-separation")

    def unadjusted(self, q: Request) -> int:
        return max(1, (self.codes.size(q.x) - 1) * (self.codes.size(q.y) - 1) * math.prod(self.codes.size(c) for c in q.z))

    def _free(self, q: Request, structural: int | None) -> int:
        if callable(self.config.dof):
            return max(1, int(self.config.dof(self, q, structural)))
        return self.unadjusted(q) if self.config.dof == "unadjusted" else structural

    def statistics(self, requests: Sequence[Request]) -> DataFrame:
        """(req, g, dof, xyz, xz, yz, z) by number of request, from cells: windows give the margins, and reciprocals of their sizes the numbers of values.

        The last four are sums of n ln n over the cells of these columns, which are the joint entropies but for the scale."""
        sets = sorted({tuple(sorted(q.all)) for q in requests})
        number, rows = {s: i for i, s in enumerate(sets)}, []
        for i, q in enumerate(requests):
            s = tuple(sorted(q.all))
            strides = dict(zip(s, self.counter.strides(s), strict=True))
            rows.append((i, number[s], strides[q.x], self.codes.size(q.x), strides[q.y], self.codes.size(q.y)))
        asked = self.spark.createDataFrame(rows, "req int, set int, sx long, dx long, sy long, dy long")
        cells = self.counter.cells(sets).join(F.broadcast(asked), "set")  # config.batch rows at most
        x, y = F.expr("(key div sx) % dx"), F.expr("(key div sy) % dy")
        cells = cells.select("req", "n", x.alias("x"), y.alias("y"), (F.col("key") - x * F.col("sx") - y * F.col("sy")).alias("z"))
        wz, wx, wy = (Window.partitionBy("req", "z", *more) for more in ((), ("x",), ("y",)))
        cells = cells.select("req", "z", "n", F.sum("n").over(wz).alias("nz"), F.sum("n").over(wx).alias("nx"), F.sum("n").over(wy).alias("ny"), (1 / F.count("*").over(wx)).alias("vx"), (1 / F.count("*").over(wy)).alias("vy"))
        d = lambda c: F.col(c).cast("double")
        sums = {"xyz": "n", "xz": "nx", "yz": "ny", "z": "nz"}
        logs = [F.sum(d("n") * F.ln(d(n))).alias(f"s_{k}") for k, n in sums.items()]
        strata = cells.groupBy("req", "z").agg(F.sum(d("n") * F.ln(d("n") * d("nz") / (d("nx") * d("ny")))).alias("g"), F.round(F.sum("vx")).alias("vx"), F.round(F.sum("vy")).alias("vy"), *logs)
        free = F.greatest(F.lit(1), F.sum((F.col("vx") - 1) * (F.col("vy") - 1))).cast("long")
        return strata.groupBy("req").agg((2 * F.abs(F.sum("g"))).alias("g"), free.alias("dof"), *[F.sum(f"s_{k}").alias(k) for k in sums])

    def _tested(self, requests: list[Request]) -> list[Result]:
        known: dict[int, tuple[float, int]] = {}
        if self.config.strategy == "entropy":
            known = self._by_entropies(requests)
        else:
            known = {r["req"]: (r["g"], r["dof"]) for r in self.statistics(requests).collect()}
        return self.decided(requests, {i: (g, self._free(requests[i], d)) for i, (g, d) in known.items()})

    def decided(self, requests: Sequence[Request], known: dict[int, tuple[float, int]]) -> list[Result]:
        """p-values and decisions of requests whose statistic and degrees of freedom are known."""
        s = self.config.significance
        rows = self.spark.createDataFrame([(i, float(g), int(d), self.n) for i, (g, d) in known.items()], "req int, g double, dof long, n long")
        rows = rows.withColumn("enough", self.config.sufficient(F.col("n"), F.col("dof"))).withColumn("p", F.when(F.col("enough"), chi2_cdf(F.col("g"), F.col("dof"))))
        out: list[Result] = [None] * len(requests)
        for r in rows.collect():
            q = requests[r["req"]]
            out[r["req"]] = Result(q.x, q.y, q.z, r["g"], r["dof"], r["n"], r["p"], s, not r["enough"], r["p"] < s if r["enough"] else None)
        return out

    # Joint entropies.

    def learn_entropies(self, sets: Iterable[frozenset[str]]) -> None:
        """Compute the entropies that aren't known yet, in one job."""
        new = sorted({tuple(sorted(s)) for s in sets if s not in self.entropies})
        if not new:
            return
        sums = self.counter.cells(new).groupBy("set").agg(F.sum(F.col("n") * F.ln(F.col("n").cast("double"))).alias("s")).collect()
        for r in sums:
            self.entropies[frozenset(new[r["set"]])] = math.log(self.n) - r["s"] / self.n

    def _by_entropies(self, requests: list[Request]) -> dict[int, tuple[float, int]]:
        terms = [(q.all, q.all - {q.y}, q.all - {q.x}, frozenset(q.z)) for q in requests]
        asked = [t for four in terms for t in four if t]
        fresh = {t for t in asked if t not in self.entropies}
        self.reads, self.misses = self.reads + len(asked), self.misses + len(fresh)
        if self.config.dof == "structural":
            self._learn_both(requests, terms)
        else:
            self.learn_entropies(fresh)
        h = self.entropies
        g = {i: 2 * self.n * (h[xz] + h[yz] - h[xyz] - h[z]) for i, (xyz, xz, yz, z) in enumerate(terms)}
        if self.config.dof != "structural":
            return {i: (v, None) for i, v in g.items()}
        return {i: (v, self.dofs[frozenset((requests[i].x, requests[i].y)), requests[i].all]) for i, v in g.items()}

    def _learn_both(self, requests: Sequence[Request], terms: Sequence[tuple[frozenset[str], ...]]) -> None:
        """Entropies and degrees of freedom that aren't known yet, from the same cells, in one job."""
        pair = lambda q: (frozenset((q.x, q.y)), q.all)
        new = list({pair(q): (q, t) for q, t in zip(requests, terms, strict=True) if pair(q) not in self.dofs or any(x not in self.entropies for x in t)}.values())
        if not new:
            return
        for r in self.statistics([q for q, _ in new]).collect():
            q, t = new[r["req"]]
            self.dofs[pair(q)] = r["dof"]
            for x, name in zip(t, ("xyz", "xz", "yz", "z"), strict=True):
                self.entropies.setdefault(x, math.log(self.n) - r[name] / self.n)

    def learn_dofs(self, sets: Iterable[frozenset[str]]) -> None:
        """Structural degrees of freedom of every pair inside each set given the set's other columns, from the sets' cells."""
        self._count_dofs(Request.of(x, y, set(s) - {x, y}) for s in sets for x, y in itertools.combinations(sorted(s), 2))

    def _count_dofs(self, asked: Iterable[Request]) -> None:
        """The degrees of freedom of those that aren't known yet."""
        pairs = list({(frozenset((q.x, q.y)), q.all): q for q in asked if (frozenset((q.x, q.y)), q.all) not in self.dofs}.values())
        for lo in range(0, len(pairs), self.config.batch):
            part = pairs[lo : lo + self.config.batch]
            for r in self.statistics(part).collect():
                self.dofs[frozenset((part[r["req"]].x, part[r["req"]].y)), part[r["req"]].all] = r["dof"]

    # Storage.

    def frame(self) -> DataFrame:
        rows = [(r.idx, r.x, r.y, list(r.z), r.statistic, r.g, r.dof, r.n, r.p, r.significance, r.insufficient, r.independent, r.dsep, r.duration_s) for r in self.results]
        return self.spark.createDataFrame(rows, RESULTS)

    def scored(self, heuristic: str, requests: Sequence[Request], values: Sequence[float], seconds: float) -> None:
        """Keep a batch of a heuristic's scores."""
        each = seconds / max(1, len(requests))
        self.scores += [Score(len(self.scores) + i, heuristic, q.x, q.y, q.z, float(v), each) for i, (q, v) in enumerate(zip(requests, values, strict=True))]

    def score_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(s.idx, s.heuristic, s.x, s.y, list(s.z), s.value, s.duration_s) for s in self.scores], SCORES)

    def end(self) -> None:
        if self.config.results_path:
            self.frame().coalesce(1).write.mode("append").parquet(self.config.results_path)
        if self.config.heuristic_results_path:
            self.score_frame().coalesce(1).write.mode("append").parquet(self.config.heuristic_results_path)
        if self.config.entropy_path:
            save_entropies(self.spark, self.entropies, self.config.entropy_path)
        if self.config.dof_path:
            rows = [(sorted(s), sorted(p)[0], sorted(p)[1], d) for (p, s), d in self.dofs.items()]
            self.spark.createDataFrame(rows, "vars array<string>, x string, y string, dof long").write.mode("overwrite").parquet(self.config.dof_path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_entropies(spark: SparkSession, path: str) -> dict[frozenset[str], float]:
    return {frozenset(r["vars"]): r["h"] for r in spark.read.parquet(path).collect()} if _exists(spark, path) else {}


def save_entropies(spark: SparkSession, entropies: dict[frozenset[str], float], path: str) -> None:
    spark.createDataFrame([(sorted(k), v) for k, v in entropies.items()], "vars array<string>, h double").write.mode("overwrite").parquet(path)


def load_dofs(spark: SparkSession, path: str) -> dict:
    if not _exists(spark, path):
        return {}
    return {(frozenset((r["x"], r["y"])), frozenset(r["vars"])): r["dof"] for r in spark.read.parquet(path).collect()}


def disagreements(left: DataFrame, right: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Results of two testers, paired by idx, that differ in g, p, degrees of freedom or decision, or that one of them lacks."""
    both = left.alias("a").join(right.alias("b"), "idx", "full_outer")
    far = lambda c: ~(F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")), F.when(F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNull(), 0.0).otherwise(1e300)) <= tolerance)
    other = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.where(far("g") | far("p") | other("dof") | other("independent")).select("idx", F.col("a.g").alias("g_left"), F.col("b.g").alias("g_right"), F.col("a.p").alias("p_left"), F.col("b.p").alias("p_right"))


def all_requests(columns: Sequence[str]) -> list[Request]:
    """Every pair of columns with every conditioning set of the others: m (m - 1) / 2 * 2^(m - 2) requests."""
    out = []
    for x, y in itertools.combinations(sorted(columns), 2):
        rest = [c for c in sorted(columns) if c not in (x, y)]
        out += [Request(x, y, z) for k in range(len(rest) + 1) for z in itertools.combinations(rest, k)]
    return out
