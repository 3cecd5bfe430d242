"""The queries without SQL against plain versions: DuckDB decides each test, plain loops do the rest."""

import itertools
import math
import os
from collections import Counter

import duckdb
import pytest

from margrave import queries as q
from margrave.dataset import Dataset, SplitDataset, SplitOptions


class Decisions:
    """Each test and each score of lineitem's columns, asked once."""

    def __init__(self, small):
        self.duck, self.tests, self.scores = duckdb.connect(), {}, {}
        for t in ("lineitem", "events"):
            self.duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(small, t)}.parquet'")

    def test(self, x, y, z):
        key = *sorted((x, y)), tuple(sorted(z))
        if key not in self.tests:
            self.tests[key] = self.duck.sql(f"SELECT insufficient, independent FROM ({q.g_sql(*key)})").fetchall()[0]
        return self.tests[key]

    def score(self, x, y, z):
        cells = q._cells(x, y, tuple(sorted(z)))
        return self.duck.sql(f"SELECT abs(sum(n / t * ln(n * nz / (nxz * nyz)))) FROM ({cells})").fetchall()[0][0]


@pytest.fixture(scope="module")
def decide(small):
    return Decisions(small)


def plain_walk(decide, t):
    near, sets, k = set(q.CATEGORIES) - {t}, {}, 0
    while len(near) > k:
        gone = set()
        for x in sorted(near):
            for z in itertools.combinations(sorted(near - {x}), k):
                insufficient, independent = decide.test(x, t, z)
                if insufficient or independent:
                    gone.add(x)
                if independent:
                    sets[x] = z
                    break
        near, k = near - gone, k + 1
    return near, sets


def plain_ipcmb(decide, t, pc_only=False):
    walks = {x: plain_walk(decide, x) for x in q.CATEGORIES}
    candidates, sets = walks[t]
    pc = {x for x in candidates if t in walks[x][0]}
    out = set(pc)
    for x in () if pc_only else pc:
        for y in walks[x][0] - {t} - pc:
            z = walks[y][1].get(t, ()) if y in candidates else sets.get(y, ())
            insufficient, independent = decide.test(t, y, {*z, x})
            if not insufficient and not independent:
                out.add(y)
    return ",".join(sorted(out))


def test_ipcmb_lineitem(spark, small, decide):
    got = dict(q.QUERIES["ipcmb_lineitem"](spark, small).collect())
    assert got == {t: plain_ipcmb(decide, t) for t in q.CATEGORIES} and any(got.values())


def test_ipcmb_pc_only(spark, small, decide):
    assert q.QUERIES["ipcmb_pc_only"](spark, small).collect() == [("l_returnflag", plain_ipcmb(decide, "l_returnflag", True))]


def test_iamb_lineitem(spark, small, decide):
    t, boundary = "l_returnflag", []
    left = sorted(set(q.CATEGORIES) - {t})
    while left:
        best = min(left, key=lambda c: (-decide.score(t, c, boundary), c))
        insufficient, independent = decide.test(t, best, boundary)
        if not insufficient and independent:
            break
        left.remove(best)
        if not insufficient:
            boundary.append(best)
    for c in sorted(boundary):
        insufficient, independent = decide.test(t, c, [b for b in boundary if b != c])
        if not insufficient and independent:
            boundary.remove(c)
    assert q.QUERIES["iamb_lineitem"](spark, small).collect() == [(t, ",".join(sorted(boundary)))]


def test_windowed_event_dependence(spark, small, decide):
    cells = Counter()
    for day, kind, large in decide.duck.sql("SELECT date_trunc('day', ts), event_type, value > 50 FROM events").fetchall():
        cells[day, kind, large] += 1
    want = Counter()
    for (day, kind, large), n in cells.items():
        t = sum(m for (d, *_), m in cells.items() if d == day)
        a = sum(m for (d, k, _), m in cells.items() if (d, k) == (day, kind))
        b = sum(m for (d, _, v), m in cells.items() if (d, v) == (day, large))
        want[str(day)[:10]] += n / t * math.log(n * t / (a * b))
    got = {str(r.start)[:10]: r.mi for r in q.QUERIES["windowed_event_dependence"](spark, small).collect()}
    assert got == pytest.approx(dict(want), abs=1e-9)


def test_naive_bayes_confusion(spark, small):
    split = SplitDataset.build(Dataset.of(q._binary(spark, small), ["f", "q", "t"], ["r"]), SplitOptions(0.5, 3))
    train, test = ([(r.r, (r.f, r.q, r.t)) for r in d.df.collect()] for d in (split.train, split.test))
    assert len(train) > 1000 and len(test) > 1000
    n = Counter(y for y, _ in train)
    ones = {y: [sum(x[i] for k, x in train if k == y) for i in range(3)] for y in n}

    def guess(x):
        share = lambda y, i: (ones[y][i] + 1) / (n[y] + 2)
        return max(n, key=lambda y: math.log(n[y] + 1) + sum(math.log(share(y, i) if x[i] else 1 - share(y, i)) for i in range(3)))

    pairs = Counter((y, guess(x)) for y, x in test)
    want = {"tp": pairs[1, 1], "tn": pairs[0, 0], "fp": pairs[0, 1], "fn": pairs[1, 0]}
    assert q.QUERIES["naive_bayes_confusion"](spark, small).first().asDict() == want


def test_bn_sample_marginals(spark, small):
    net = q.garden()
    rows = q.QUERIES["bn_sample_marginals"](spark, small).collect()
    assert sum(r.n for r in rows) == 20_000
    seen = {(net.nodes["rain"].values[r.rain], net.nodes["grass"].values[r.grass]): r.p for r in rows}
    want = {(r.rain, r.grass): r.p for r in net.partial_joint(spark, ["rain", "grass"]).collect()}
    assert set(seen) <= set(want) and all(abs(seen.get(k, 0) - p) < 0.02 for k, p in want.items())
