"""Command line: definitions of experiments and datasets and their folders, runs' parameters, data points, boundaries of a table's columns.

Definitions are lists EXPERIMENTS (of Experiment) and DATASETS (of DatasetDefinition) of a Python module."""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from margrave.experiment import LockablePath, by_range, by_tag, plain


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("margrave").getOrCreate()


def folder(args) -> None:
    place = LockablePath(args.repository, args.name)
    if args.verb == "list":
        for p in sorted(Path(args.repository).glob("*/")):
            print(p.name, *LockablePath(args.repository, p.name).locks())
    elif args.verb == "locks":
        print(*place.locks())
    elif args.verb == "unlock":
        place.unlock(args.kind)
    elif args.verb == "lock":
        place.lock(args.kind)
    else:
        place.delete()


def _defined(module: str, kind: str) -> dict:
    return {x.name: x for x in getattr(importlib.import_module(module), kind, ())}


def _one(args, kind: str):
    found = _defined(args.module, kind)
    if args.name not in found:
        raise SystemExit(f"{args.module} defines no {args.name!r}; it has {', '.join(found) or 'none'}")
    return found[args.name]


def _place(args, place: LockablePath) -> None:
    """What can be done to a definition's folder."""
    if args.verb == "locks":
        print(*place.locks())
    elif args.verb == "lock":
        place.lock(args.kind)
    elif args.verb == "unlock":
        place.unlock(args.kind)
    else:
        place.delete()


def exp(args) -> None:
    if args.verb == "list":
        for name, e in _defined(args.module, "EXPERIMENTS").items():
            print(name, len(e.runs), *e.folder().locks())
        return
    e = _one(args, "EXPERIMENTS")
    if args.verb == "show":
        print(json.dumps({"name": e.name, "path": str(e.path), "runs": len(e.runs), "auto_lock": e.auto_lock, "locks": e.folder().locks()}))
    elif args.verb == "run":
        for p in e.run(_spark()):
            print(p.id, p.algorithm, p.target, *p.boundary)
    else:
        _place(args, e.folder())


def exds(args) -> None:
    from margrave.dataset import load_or_build

    if args.verb == "list":
        for name, x in _defined(args.module, "DATASETS").items():
            print(name, *x.tags, *LockablePath(x.path, x.name).locks())
        return
    x = _one(args, "DATASETS")
    if args.verb == "show":
        print(json.dumps({"name": x.name, "path": str(x.path), "tags": list(x.tags), "locks": LockablePath(x.path, x.name).locks()}))
    elif args.verb == "build":
        print(json.dumps(load_or_build(_spark(), str(x.path), x.name, lambda: x.source().create()).info()))
    else:
        _place(args, LockablePath(x.path, x.name, "dataset"))


def parameters(args) -> None:
    runs = list(_one(args, "EXPERIMENTS").runs)
    runs = by_tag(runs, args.tag) if args.tag else runs
    runs = by_range(runs, args.range) if args.range else runs
    if args.verb == "count":
        print(len(runs))
    else:
        for r in runs:
            print(json.dumps(plain(r)))


def paths(args) -> None:
    for kind in ("EXPERIMENTS", "DATASETS"):
        for x in _defined(args.module, kind).values():
            print(kind.lower(), x.name, LockablePath(x.path, x.name).url)


def datapoints(args) -> None:
    path = Path(args.repository, args.name, "datapoints")
    for r in _spark().read.parquet(str(path)).orderBy("start_s").collect():
        print(json.dumps({"id": r["id"], "algorithm": r["algorithm"], "target": r["target"], "boundary": r["boundary"], "seconds": round(r["duration_s"], 3)}))


def boundary(args) -> None:
    from margrave.operators.citest import CITestConfig, CITester
    from margrave.plans.boundary import ipcmb_all

    df = _spark().read.parquet(args.table)
    columns = args.columns.split(",") if args.columns else df.columns
    tester = CITester(df.select(*columns), columns, CITestConfig(significance=args.significance, strategy=args.strategy))
    print(json.dumps(ipcmb_all(tester, args.targets.split(",") if args.targets else None, args.pc_only)))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="margrave", description=__doc__)
    objects = parser.add_subparsers(dest="object", required=True)
    f = objects.add_parser("folder")
    f.add_argument("verb", choices=("list", "locks", "lock", "unlock", "delete"))
    f.add_argument("repository")
    f.add_argument("name", nargs="?", default="")
    f.add_argument("--kind", default="")
    f.set_defaults(run=folder)
    own = ("list", "show", "locks", "lock", "unlock", "delete")
    for name, verbs, run in (("exp", (*own, "run"), exp), ("exds", (*own, "build"), exds), ("parameters", ("list", "count"), parameters)):
        o = objects.add_parser(name)
        o.add_argument("verb", choices=verbs)
        o.add_argument("module")
        o.add_argument("name", nargs="?", default="")
        o.add_argument("--kind", default="")
        o.add_argument("--tag", default="")
        o.add_argument("--range", default="")
        o.set_defaults(run=run)
    p = objects.add_parser("paths")
    p.add_argument("module")
    p.set_defaults(run=paths)
    d = objects.add_parser("datapoints")
    d.add_argument("repository")
    d.add_argument("name")
    d.set_defaults(run=datapoints)
    b = objects.add_parser("boundary")
    b.add_argument("table")
    b.add_argument("--columns", default="")
    b.add_argument("--targets", default="")
    b.add_argument("--significance", type=float, default=0.95)
    b.add_argument("--strategy", choices=("direct", "cuboid", "entropy"), default="cuboid")
    b.add_argument("--pc-only", action="store_true")
    b.set_defaults(run=boundary)
    args = parser.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
