"""Discrete Bayesian networks: joint distributions, samples, paths, d-separation.

A network is a small graph and lives on the driver; distributions and samples are DataFrames."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from margrave.errors import NetworkNotFinalizedError


#: Copies of a row that one row is exploded to, at most.
COPIES = 1 << 20


@dataclass
class Node:
    """table: by tuple of parents' values, in the order of parents, the probabilities of the node's values; () for a root."""

    name: str
    values: tuple[str, ...]
    parents: tuple[str, ...] = ()
    table: dict[tuple[str, ...], tuple[float, ...]] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)

    def probability(self, value: str, parents: tuple[str, ...] = ()) -> float:
        return self.table[parents][self.values.index(value)]


def _below(bound):
    return lambda c: c < bound


class BayesianNetwork:
    """Nodes are numbered in alphabetical order of their names. A network is finalized before it is queried; finalizing again changes nothing."""

    def __init__(self, name: str, nodes: Iterable[Node], properties: dict[str, str] | None = None):
        self.name, self.nodes, self.properties, self.final = name, {n.name: n for n in nodes}, properties or {}, False

    @classmethod
    def from_edges(cls, edges: dict[str, Iterable[str]], name: str = "graph") -> BayesianNetwork:
        """A network with the structure only, from children by parent."""
        parents: dict[str, list[str]] = {n: [] for n in edges}
        for p, children in edges.items():
            for c in children:
                parents.setdefault(c, []).append(p)
        return cls(name, [Node(n, (), tuple(ps)) for n, ps in parents.items()]).finalize()

    def finalize(self) -> BayesianNetwork:
        self.names = sorted(self.nodes)
        self.number = {n: i for i, n in enumerate(self.names)}
        self.children = {n: sorted(c for c in self.names if n in self.nodes[c].parents) for n in self.names}
        self.neighbours = {n: sorted({*self.nodes[n].parents, *self.children[n]}) for n in self.names}
        self.order, placed = [], set()
        while len(self.order) < len(self.names):
            before = len(self.order)
            for n in self.names:  # a node may follow its last parent in the same pass
                if n not in placed and placed.issuperset(self.nodes[n].parents):
                    self.order.append(n)
                    placed.add(n)
            if len(self.order) == before:
                raise ValueError("the network has a cycle")
        self.final = True
        return self

    def _ready(self) -> None:
        if not self.final:
            raise NetworkNotFinalizedError(self.name)

    def __len__(self):
        return len(self.nodes)

    def joint_size(self) -> int:
        return math.prod(len(n.values) for n in self.nodes.values())

    def markov_boundary(self, name: str) -> list[str]:
        """Parents, children and children's other parents."""
        self._ready()
        spouses = {p for c in self.children[name] for p in self.nodes[c].parents}
        return sorted({*self.neighbours[name], *spouses} - {name})

    # Views.

    def node_frame(self, spark: SparkSession) -> DataFrame:
        self._ready()
        return spark.createDataFrame([(self.number[n], n, list(self.nodes[n].values)) for n in self.names], "id int, name string, values array<string>")

    def edge_frame(self, spark: SparkSession) -> DataFrame:
        self._ready()
        rows = [(self.number[p], self.number[n], i) for n in self.names for i, p in enumerate(self.nodes[n].parents)]
        return spark.createDataFrame(rows, "parent int, child int, parent_pos int")

    def cpt_frame(self, spark: SparkSession) -> DataFrame:
        """With running sums of the probabilities in the order of values."""
        self._ready()
        rows = [(self.number[n], list(k), i, p) for n in self.names for k, ps in self.nodes[n].table.items() for i, p in enumerate(ps)]
        cpt = spark.createDataFrame(rows, "node int, parent_values array<string>, value_idx int, p double")
        return cpt.withColumn("cum", F.sum("p").over(Window.partitionBy("node", "parent_values").orderBy("value_idx").rowsBetween(Window.unboundedPreceding, 0)))

    def factor(self, spark: SparkSession, name: str) -> DataFrame:
        """A node's probabilities as columns: its parents, itself, p."""
        node = self.nodes[name]
        rows = [(*k, v, p) for k, ps in node.table.items() for v, p in zip(node.values, ps, strict=True)]
        return spark.createDataFrame(rows, T.StructType([*[T.StructField(c, T.StringType()) for c in (*node.parents, name)], T.StructField("p", T.DoubleType())]))

    # Sub-networks.

    def ancestors(self, names: Iterable[str]) -> list[str]:
        """The names and all their ancestors."""
        self._ready()
        out, queue = set(), list(names)
        while queue:
            n = queue.pop()
            if n not in out:
                out.add(n)
                queue += self.nodes[n].parents
        return sorted(out)

    def subnetwork(self, names: Iterable[str]) -> BayesianNetwork:
        return BayesianNetwork(self.name, [self.nodes[n] for n in self.ancestors(names)]).finalize()

    # Distributions.

    def joint(self, spark: SparkSession, keep: Iterable[str] | None = None) -> DataFrame:
        """The joint distribution of the kept nodes (all by default), keys in alphabetical order, by joins of the factors.

        Factors are joined in topological order. A node is summed out as soon as no factor to come mentions it,
        so tables stay as small as the order allows."""
        self._ready()
        keep = set(self.names if keep is None else keep)
        out = None
        for i, n in enumerate(self.order):
            f = self.factor(spark, n)
            if out is None:
                out = f
            else:
                shared = list(self.nodes[n].parents)
                f = f.withColumnRenamed("p", "__p")
                out = (out.join(F.broadcast(f), shared) if shared else out.crossJoin(F.broadcast(f))).withColumn("p", F.col("p") * F.col("__p")).drop("__p")
            later = {m for q in self.order[i + 1 :] for m in self.nodes[q].parents}
            gone = [c for c in out.columns if c != "p" and c not in keep and c not in later]
            if gone:
                out = out.groupBy(*[c for c in out.columns if c not in (*gone, "p")]).agg(F.sum("p").alias("p"))
        return out.select(*sorted(c for c in out.columns if c != "p"), "p")

    def partial_joint(self, spark: SparkSession, names: Iterable[str]) -> DataFrame:
        """The joint distribution of some nodes: ancestors only, the others summed out."""
        names = list(names)
        return self.subnetwork(names).joint(spark, names)

    # Samples.

    def sample(self, spark: SparkSession, n: int, seed: int = 0, indices: bool = True, partitions: int | None = None) -> DataFrame:
        """n samples by ancestral sampling, as row_id and a column per node (value numbers, or values).

        A node's draw is a hash of row, node and seed, so samples don't depend on partitions; the value is the first whose
        running sum of probabilities reaches the draw (the last value, should sums end below 1). All nodes are one
        projection: no shuffle, no join."""
        self._ready()
        out = spark.range(0, n, 1, partitions).withColumnRenamed("id", "row_id")
        for name in self.order:
            node = self.nodes[name]
            draw = F.pmod(F.xxhash64("row_id", F.lit(name), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
            row = F.lit(0)
            for p in node.parents:
                row = row * len(self.nodes[p].values) + F.col(p)
            sums = []
            for key in itertools.product(*[self.nodes[p].values for p in node.parents]):
                sums += [F.array(*[F.lit(x) for x in itertools.accumulate(node.table[key])])]
            cum = F.get(F.array(*sums), row) if node.parents else sums[0]
            place = F.size(F.filter(cum, _below(draw)))
            out = out.withColumn(name, F.least(place, F.lit(len(node.values) - 1)).cast("tinyint"))
        if not indices:
            out = out.select("row_id", *[F.get(F.array(*[F.lit(v) for v in self.nodes[n].values]), F.col(n)).alias(n) for n in self.names])
        return out.select("row_id", *self.names)

    def exact_samples(self, spark: SparkSession, n: int, indices: bool = True) -> DataFrame:
        """n rows in proportion to the joint distribution, without chance."""
        from margrave.operators.counts import exact_instances

        rows = exact_instances(self.joint(spark), n)
        if indices:
            place = lambda c: (F.array_position(F.array(*[F.lit(v) for v in self.nodes[c].values]), F.col(c)) - 1).cast("tinyint")
            rows = rows.select(*[place(c).alias(c) for c in self.names], "n")
        # a key's copies are dealt out in pieces, so that no row makes more than COPIES of them
        rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}"))))
        rows = rows.withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("k") * COPIES))
        if n > COPIES:
            rows = rows.repartition(*self.names, "k")
        rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("k", "n")
        return rows.withColumn("row_id", F.monotonically_increasing_id()).select("row_id", *self.names)

    # Paths.

    def _paths(self, start: str, end: str, graph: dict[str, list[str]]) -> Iterator[list[str]]:
        stack = [(start, iter(graph[start]))]
        path = [start]
        while stack:
            for n in stack[-1][1]:
                if n == end:
                    yield [*path, n]
                elif n not in path:
                    path.append(n)
                    stack.append((n, iter(graph[n])))
                    break
            else:
                stack.pop()
                path.pop()

    def directed_paths(self, start: str, end: str) -> Iterator[list[str]]:
        self._ready()
        return self._paths(start, end, self.children)

    def undirected_paths(self, start: str, end: str) -> Iterator[list[str]]:
        self._ready()
        return self._paths(start, end, self.neighbours)

    def distance(self, start: str, end: str) -> int | None:
        """Nodes on a shortest undirected path; None without a path."""
        self._ready()
        near, far, seen = [start], 1, {start}
        while near:
            if end in near:
                return far
            near = sorted({m for n in near for m in self.neighbours[n]} - seen)
            seen.update(near)
            far += 1
        return None

    def d_separated(self, x: str, z: Iterable[str], y: str, descendants: str = "children") -> bool:
        """Whether z blocks every undirected path between x and y.

        A collider opens if it or, with descendants='children', one of its children is in z; with descendants='all', any
        of its descendants, which is the textbook rule. 'all' is decided by reachability in linear time; 'children' needs a
        search over simple paths, which is cut at blocked nodes."""
        self._ready()
        z = set(z)
        if descendants == "all":
            return not self._reachable(x, z, y)
        opens = {n for n in self.names if n in z or z.intersection(self.children[n])}

        def active(path: list[str]) -> bool:
            here = path[-1]
            if here == y:
                return True
            for n in self.neighbours[here]:
                if n in path:
                    continue
                if len(path) > 1:
                    collider = here in self.children[path[-2]] and here in self.children[n]
                    if (here not in opens) if collider else (here in z):
                        continue
                if active([*path, n]):
                    return True
            return False

        return not active([x])

    def _reachable(self, x: str, z: set[str], y: str) -> bool:
        above = set(self.ancestors(z))
        queue, seen = [(x, "up")], set()
        while queue:
            here, way = queue.pop()
            if (here, way) in seen:
                continue
            seen.add((here, way))
            if here == y and here not in z:
                return True
            if way == "up" and here not in z:
                queue += [(p, "up") for p in self.nodes[here].parents] + [(c, "down") for c in self.children[here]]
            elif way == "down":
                if here not in z:
                    queue += [(c, "down") for c in self.children[here]]
                if here in above:
                    queue += [(p, "up") for p in self.nodes[here].parents]
        return False


def path_frame(edges: DataFrame, start, end, directed: bool = False) -> DataFrame:
    """(path) of all simple paths in a table of edges (parent, child), by a recursive query."""
    spark, view = edges.sparkSession, f"edges_{id(edges)}"
    pairs = edges.select(F.col("parent").alias("a"), F.col("child").alias("b"))
    if not directed:
        pairs = pairs.unionByName(edges.select(F.col("child").alias("a"), F.col("parent").alias("b"))).distinct()
    pairs.createOrReplaceTempView(view)
    return spark.sql(
        f"""WITH RECURSIVE walk(node, path) AS (
          SELECT CAST({start} AS BIGINT), array(CAST({start} AS BIGINT))
          UNION ALL
          SELECT CAST(e.b AS BIGINT), array_append(w.path, CAST(e.b AS BIGINT)) FROM walk w JOIN {view} e ON e.a = w.node
          WHERE w.node <> {end} AND NOT array_contains(w.path, CAST(e.b AS BIGINT)))
        SELECT path FROM walk WHERE node = {end}"""
    )
