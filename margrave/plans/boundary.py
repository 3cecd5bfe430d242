"""Markov boundaries: ranking, IAMB, IPC-MB and PCMB as level-synchronous drivers of batched tests.

The driver holds sets of column names; whatever a level needs to know is one batch, so the number of Spark jobs follows the
number of levels, not the number of tests. Sets are visited in ascending order of names."""

from __future__ import annotations

import functools
import itertools
import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrave.operators.citest import CITester, Request, Result
from margrave.operators.information import binary_mutual_information, information_gains


def information_gain_ranking(df: DataFrame, features: Sequence[str], objective: str, top: int, binary: bool = False, base: float | str = 2) -> list[str]:
    """The `top` features of largest mutual information with the objective; of equal ones the first. One job for all features."""
    gains = binary_mutual_information(df, features, objective) if binary else information_gains(df, objective, features, base)
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    return [r["feature"] for r in gains.orderBy(F.round("mi", 12).desc(), place).limit(top).collect()]


class SepSets:
    """Separating sets by unordered pair."""

    def __init__(self):
        self.sets: dict[frozenset[str], frozenset[str]] = {}

    def add(self, z: Iterable[str], a: str, b: str) -> None:
        self.sets[frozenset((a, b))] = frozenset(z)

    def get(self, a: str, b: str) -> frozenset[str]:
        return self.sets[frozenset((a, b))]

    def __contains__(self, pair: tuple[str, str]) -> bool:
        return frozenset(pair) in self.sets


class Tests:
    """A tester whose answers are remembered by unordered pair and conditioning set."""

    def __init__(self, tester: CITester, chunk: int | None = None):
        self.tester, self.known, self.chunk = tester, {}, chunk or tester.config.batch

    @staticmethod
    def _key(q: Request):
        return frozenset((q.x, q.y)), q.z

    def ask(self, requests: Iterable[Request]) -> list[Result]:
        requests = list(requests)
        new = list({self._key(q): q for q in requests if self._key(q) not in self.known}.values())
        for q, r in zip(new, self.tester.batch(new), strict=True):
            self.known[self._key(q)] = r
        return [self.known[self._key(q)] for q in requests]


def recognize_pc(tests: Tests, targets: Iterable[str], universe: Iterable[str]) -> dict[str, tuple[set[str], list]]:
    """For each target: its candidate parents and children among the universe, and the separating sets written, in order.

    All targets walk the levels together. In a level of size k every candidate X is tested against the target given
    every k-subset of the other candidates; the first subset that separates them ends X, which leaves after the
    level. Tests come in chunks by the subsets' order: pairs separated in one chunk aren't asked in the next. Too few
    samples also end X, but the search for a separating set goes on."""
    universe = set(universe)
    near = {t: universe - {t} for t in targets}
    writes: dict[str, list] = {t: [] for t in near}
    seen: dict[str, set] = {t: set() for t in near}
    going, k = set(near), 0
    while going:
        walks = {(t, x): itertools.combinations(sorted(near[t] - {x}), k) for t in sorted(going) for x in sorted(near[t])}
        out: dict[tuple[str, str], tuple[str, ...] | None] = {}
        weak: set[tuple[str, str]] = set()
        while walks:
            share = max(1, tests.chunk // len(walks))
            wave = [(p, z) for p, it in walks.items() for z in itertools.islice(it, share)]
            got: dict[tuple[str, str], int] = {}
            for (pair, z), r in zip(wave, tests.ask(Request.of(x, t, z) for (t, x), z in wave), strict=True):
                got[pair] = got.get(pair, 0) + 1
                if pair in out:
                    continue
                if r.insufficient:
                    weak.add(pair)
                elif r.independent:
                    out[pair] = z
            walks = {p: it for p, it in walks.items() if p not in out and got.get(p, 0) == share}
        for t in sorted(going):
            for x in sorted(near[t]):
                if (t, x) in out:
                    writes[t].append((frozenset(out[t, x]), t, x, True))
                    seen[t].add(x)
                elif x not in seen[t]:
                    writes[t].append((frozenset(), t, x, False))
                    seen[t].add(x)
            near[t] -= {x for x in near[t] if (t, x) in out or (t, x) in weak}
        k += 1
        going = {t for t in going if len(near[t]) > k}
    return {t: (near[t], writes[t]) for t in near}


def ipcmb(tester: CITester | Tests, target: str, universe: Iterable[str] | None = None, pc_only: bool = False, memo: dict | None = None) -> list[str]:
    """The Markov boundary of target by IPC-MB, sorted.

    memo: a dictionary that keeps candidate parents and children over several targets on the same tests.

    The candidates' own candidates are sought in one walk. Separating sets are then written in the order a sequential run
    has: the target's walk, then each candidate's; a later one replaces an earlier one, and an empty set is only written
    where there is none."""
    tests = tester if isinstance(tester, Tests) else Tests(tester)
    universe = set(tests.tester.columns if universe is None else universe)
    memo = {} if memo is None else memo
    if target not in memo:
        memo |= recognize_pc(tests, [target], universe)
    candidates = sorted(memo[target][0])
    missing = [x for x in candidates if x not in memo]
    if missing:
        memo |= recognize_pc(tests, missing, universe)
    pc, asked = _spouse_tests(memo, target)
    if pc_only:
        return pc
    boundary = set(pc)
    for (y, _), r in zip(asked, tests.ask(q for _, q in asked), strict=True):
        if not r.insufficient and not r.independent:
            boundary.add(y)
    return sorted(boundary)


def _spouse_tests(memo: dict, target: str) -> tuple[list[str], list[tuple[str, Request]]]:
    """Parents and children of target, and the tests by which other candidates may join as spouses; memo has target and all its candidates."""
    candidates = sorted(memo[target][0])
    sep = SepSets()
    for t in [target, *candidates]:
        for z, a, b, found in memo[t][1]:
            if found or (a, b) not in sep:
                sep.add(z, a, b)
    pc = [x for x in candidates if target in memo[x][0]]
    return pc, [(y, Request.of(target, y, sep.get(target, y) | {x})) for x in pc for y in sorted(memo[x][0] - {target}) if y not in pc]


def ipcmb_all(tester: CITester, targets: Iterable[str] | None = None, pc_only: bool = False) -> dict[str, list[str]]:
    """Boundaries of many targets; all walks of all targets share their levels' batches, and all tests of spouses are one."""
    tests = Tests(tester)
    targets = list(tester.columns if targets is None else targets)
    memo = recognize_pc(tests, tester.columns, tester.columns) if len(targets) > 1 else {}
    if memo and not pc_only:
        tests.ask(q for t in targets for _, q in _spouse_tests(memo, t)[1])
    return {t: ipcmb(tests, t, pc_only=pc_only, memo=memo) for t in targets}


#: score(requests) -> a number for each.
Heuristic = Callable[[Sequence[Request]], list[float]]


def cmi_heuristic(tester: CITester) -> Heuristic:
    """Conditional mutual information in nats, from the tester's counts."""

    def cmi(requests):
        found = {r["req"]: r["g"] / (2 * tester.n) for r in tester.statistics(requests).collect()}
        return [found[i] for i in range(len(requests))]

    return cmi


def recorded(tester: CITester, heuristic: Heuristic, name: str | None = None) -> Heuristic:
    """The heuristic, whose scores the tester then keeps."""

    def score(requests):
        requests, began = list(requests), time.time()
        values = heuristic(requests)
        tester.scored(name or heuristic.__name__, requests, values, time.time() - began)
        return values

    return score


def network_cmi_heuristic(network, spark) -> Heuristic:
    """Conditional mutual information in nats of a network's own distribution."""
    from pyspark.sql import Window

    from margrave.functions.info import cmi_term

    def cells(i: int, q: Request) -> DataFrame:
        p = network.partial_joint(spark, q.all)
        over = lambda *by: F.sum("p").over(Window.partitionBy(*by))
        return p.where("p > 0").select(F.lit(i).alias("req"), "p", over(*q.z).alias("pz"), over(*q.z, q.x).alias("px"), over(*q.z, q.y).alias("py"))

    def cmi(requests):
        """One job for all requests."""
        if not requests:
            return []
        every = functools.reduce(DataFrame.unionByName, [cells(i, q) for i, q in enumerate(requests)])
        term = cmi_term(F.col("p"), F.col("px"), F.col("py"), F.col("pz"), F.lit(1.0))
        found = dict(every.groupBy("req").agg(F.abs(F.sum(term))).collect())
        return [found[i] for i in range(len(requests))]

    return cmi


def distance_heuristic(network) -> Heuristic:
    """0 for pairs that a non-empty set d-separates, else 1 / nodes on the shortest undirected path; 0 without a path."""

    def one(q: Request) -> float:
        if q.z and network.d_separated(q.x, q.z, q.y):
            return 0.0
        d = network.distance(q.x, q.y)
        return 1 / d if d else 0.0

    def distance(requests):
        return [one(q) for q in requests]

    return distance


def separation_heuristic(network) -> Heuristic:
    """0 if d-separated, else 1."""

    def separation(requests):
        return [0.0 if network.d_separated(q.x, q.z, q.y) else 1.0 for q in requests]

    return separation


def iamb(tester: CITester, target: str, heuristic: Heuristic | None = None, universe: Iterable[str] | None = None) -> list[str]:
    """The Markov boundary of target by IAMB, sorted.

    Growing: the candidate of highest score given the boundary so far joins it if dependent; if independent, growing ends;
    with too few samples it is discarded. Of equal scores the first name counts. Shrinking: members independent of the
    target given the other members go; with too few samples they stay. Each growing step is one batch of scores."""
    score = recorded(tester, heuristic or cmi_heuristic(tester))
    left = sorted(set(tester.columns if universe is None else universe) - {target})
    boundary: list[str] = []
    while left:
        scores = score([Request.of(target, c, boundary) for c in left])
        best = max(range(len(left)), key=lambda i: (scores[i], -i))
        r = tester.test(target, left[best], boundary)
        if r.insufficient:
            left.pop(best)
        elif not r.independent:
            boundary.append(left.pop(best))
        else:
            break
    gone: set[str] = set()
    for c in sorted(boundary):
        r = tester.test(target, c, set(boundary) - gone - {c})
        if not r.insufficient and r.independent:
            gone.add(c)
    return sorted(set(boundary) - gone)


def pcmb(tester: CITester, target: str, heuristic: Heuristic | None = None, universe: Iterable[str] | None = None) -> list[str]:
    """The Markov boundary of target by PCMB, after Pena, Nilsson, Bjorkegren and Tegner (2007), sorted.

    GetPCD grows a set of parents, children and descendants: each candidate is scored by the least dependence on the target
    over subsets of the set; the largest least one joins, and members that a subset separates go. GetPC keeps members
    that have the target in their own set. Spouses are found through common children."""
    tests = Tests(tester)
    universe = sorted(set(tester.columns if universe is None else universe))
    score = recorded(tester, heuristic or cmi_heuristic(tester))
    scored: dict = {}
    sep = SepSets()

    def dependence(requests: list[Request]) -> dict:
        new = [q for q in dict.fromkeys(requests) if q not in scored]
        if new:
            scored.update(zip(new, score(new), strict=True))
        return scored

    def subsets(items: Iterable[str]) -> list[tuple[str, ...]]:
        items = sorted(items)
        return [z for k in range(len(items) + 1) for z in itertools.combinations(items, k)]

    def separated(t: str, xs: Iterable[str], among: dict[str, Iterable[str]]) -> set[str]:
        asked = [(x, z) for x in xs for z in subsets(among[x])]
        out = set()
        for (x, z), r in zip(asked, tests.ask(Request.of(t, x, z) for x, z in asked), strict=True):
            if x not in out and not r.insufficient and r.independent:
                out.add(x)
                sep.add(z, t, x)
        return out

    def pcd(t: str) -> set[str]:
        own: set[str] = set()
        left = set(universe) - {t}
        while left:
            left -= separated(t, sorted(left), dict.fromkeys(left, own))
            if not left:
                break
            asked = {x: [Request.of(t, x, z) for z in subsets(own)] for x in sorted(left)}
            dependence([q for qs in asked.values() for q in qs])
            best = max(sorted(left), key=lambda x: min(scored[q] for q in asked[x]))
            own.add(best)
            left.discard(best)
            own -= separated(t, sorted(own), {x: own - {x} for x in own})
        return own

    memo: dict[str, set[str]] = {}

    def own(t: str) -> set[str]:
        if t not in memo:
            memo[t] = pcd(t)
        return memo[t]

    def pc(t: str) -> set[str]:
        return {x for x in sorted(own(t)) if t in own(x)}

    mine = pc(target)
    boundary = set(mine)
    for y in sorted(mine):
        for x in sorted(pc(y) - {target} - mine):
            z = sep.get(target, x) if (target, x) in sep else frozenset()
            r = tests.ask([Request.of(target, x, z | {y})])[0]
            if not r.insufficient and not r.independent:
                boundary.add(x)
    return sorted(boundary)
