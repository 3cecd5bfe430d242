"""Exact Jaccard self-join on word shingles, candidates filtered under several global token orders."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrave.llm import fingerprints as fp
from margrave.llm.common import materialize
from margrave.llm.components import components
from margrave.llm.textops import lean, mix, slices, trimmed, utf8, windows, words

#: Bits of a shingle's hash in the sets that are compared.
TOKEN_BITS = 52
#: Bytes of sets, and their number, that one task compares at once.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 256
#: Bytes of leaders' sets that are broadcast, else joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Labels of candidates, and large groups, are broadcast up to this number of rows (16 bytes each), else joined by shuffle.
BROADCAST_ROWS = 2_000_000

_U = np.uint64


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of n, from its front in any global order, of which a set similar enough has one at least."""
    return n + (percent * n // -100) + 1


def _sets(t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle of each document, by ascending row and hash."""
    data, offsets = utf8(t["text"])
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi in slices(offsets):
        w = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
        first, h = windows(w, k, whole=True)
        row, h = w.doc[first], h >> _U(64 - TOKEN_BITS)
        by = np.lexsort((h, row))
        row, h = row[by], h[by]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        rows.append(row[new] + lo)
        hashes.append(h[new])
    return np.concatenate(rows), np.concatenate(hashes)


def _fronts(row: np.ndarray, token: np.ndarray, cls: np.ndarray, take: np.ndarray, order: int) -> np.ndarray:
    """Which tokens are among the first take[row] of their row by rarity class, then by the order's own hash."""
    by = np.lexsort((mix(token, order), cls, row))
    sorted_row = row[by]
    start = np.searchsorted(sorted_row, np.arange(len(take)))
    out = np.zeros(len(row), bool)
    out[by] = np.arange(len(row)) - start[sorted_row] < take[sorted_row]
    return out


def _links(t: pa.Table, percent: int, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and the smallest document that each reaches by links among these. Those marked absorbed are one component already.

    A breadth-first walk: a document is compared only with documents not reached yet that share a front token with
    it under every order and fit it in size; the walk ends as soon as all are reached."""
    ids, size = t["doc_id"].to_numpy(), t["n"].to_numpy()
    at = np.argsort(ids, kind="stable")
    sets = [fp.unpack(b) for b in t["tokens"].to_pylist()]
    cls = np.concatenate([np.frombuffer(b, np.uint8) for b in t["classes"].to_pylist()])
    length = np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(length)])
    row, token = np.repeat(np.arange(len(sets)), length), np.concatenate(sets)
    known, token_no = np.unique(token, return_inverse=True)
    take = np.maximum(_prefix(size, percent) - (size - length), 0)
    fronts = []
    for k in range(orders):
        front = np.flatnonzero(_fronts(row, token, cls, take, k))
        by = front[np.argsort(token_no[front], kind="stable")]
        fronts.append((row[by], np.searchsorted(token_no[by], np.arange(len(known) + 1)), token_no[front], np.searchsorted(row[front], np.arange(len(sets) + 1))))
    root, left, mark, seen = np.full(len(sets), -1), len(sets), np.zeros(len(known), bool), np.zeros(len(sets), np.int32)

    def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())

    absorbed = t["absorbed"].to_numpy() if "absorbed" in t.column_names else np.zeros(len(sets), bool)
    begins = [at[absorbed[at]], *at[~absorbed[at], None]]
    for own_front in begins:
        own_front = own_front[root[own_front] < 0]
        if not len(own_front):
            continue
        first = own_front[0]
        root[own_front], left = first, left - len(own_front)
        queue = own_front.tolist()
        while queue and left:
            i = queue.pop()
            seen[:] = 0
            for k, (rows, post, tokens, own) in enumerate(fronts):
                mine = tokens[own[i] : own[i + 1]]
                got = rows[ranges(post[mine], post[mine + 1])]
                got = got[seen[got] == k]
                seen[got] = k + 1
            c = np.flatnonzero((seen == orders) & (root < 0))
            c = c[(100 * size[c] >= percent * size[i]) & (100 * size[i] >= percent * size[c])]
            if not len(c):
                continue
            own = token_no[begin[i] : begin[i + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[token_no[ranges(begin[c], begin[c + 1])]].astype(np.int64), np.concatenate([[0], np.cumsum(length[c])[:-1]]))
            mark[own] = False
            c = c[100 * both >= percent * (size[i] + size[c] - both)]
            root[c], left = first, left - len(c)
            queue += c.tolist()
    return ids, ids[root]


def _small(df: DataFrame, n: int) -> DataFrame:
    """df, of n rows, to be broadcast if these are few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _large_groups(sets: DataFrame, n_groups: int, percent: int, link) -> DataFrame:
    """Links (u, v) that connect what is connected in each of n_groups large groups; see ngram_join."""
    leader = F.min_by(F.struct(F.col("doc_id").alias("lead"), F.col("n").alias("lead_n"), F.col("tokens").alias("lead_tokens")), "doc_id")
    leaders = materialize(sets.groupBy("root").agg(leader.alias("l")).select("root", "l.*"), "leaders")
    size = leaders.agg(F.sum(F.octet_length("lead_tokens"))).first()[0]
    met = sets.join(F.broadcast(leaders) if size <= BROADCAST_BYTES else leaders, "root")

    def absorb(batches):
        for b in batches:
            out, last, lead = [], None, None
            for x, n, m, tokens, lead_tokens in zip(b["lead"].to_pylist(), b["n"].to_pylist(), b["lead_n"].to_pylist(), b["tokens"].to_pylist(), b["lead_tokens"].to_pylist(), strict=True):
                if x != last:
                    last, lead = x, fp.unpack(lead_tokens)
                both = len(np.intersect1d(fp.unpack(tokens), lead, assume_unique=True))
                out.append(100 * both >= percent * (n + m - both))
            keep = ["root", "doc_id", "n", "tokens", "classes", "lead"]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(out, pa.bool_())], [*keep, "absorbed"])

    marked = materialize(met.select("root", "doc_id", "n", "tokens", "classes", "lead", "lead_n", "lead_tokens").mapInArrow(lean(absorb), "root long, doc_id long, n long, tokens binary, classes binary, lead long, absorbed boolean"), "marked-sets")
    halves = lambda rest: F.greatest(F.sum(F.when(rest, F.octet_length("tokens")).otherwise(0)) * 2 / BLOCK_BYTES, F.count_if(rest) * 2 / BLOCK_ROWS)
    blocks = lambda rest: F.greatest(F.lit(1), F.ceil(halves(rest))).cast("int")
    deal = marked.groupBy("root").agg(blocks(F.col("absorbed")).alias("a"), blocks(~F.col("absorbed")).alias("u"))
    dealt = marked.join(_small(deal, n_groups), "root")
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("absorbed"), F.col("a")).otherwise(F.col("u"))).cast("int")
    dealt = dealt.withColumn("own", own)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spot = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    absorbed_in = F.transform(every("u"), lambda j: spot("a", F.col("own"), j))
    rest_in = F.concat(F.transform(every("a"), lambda i: spot("a", i, F.col("own"))), F.transform(every("u"), lambda j: spot("u", F.least("own", j), F.greatest("own", j))))
    tasks = dealt.withColumn("at", F.explode(F.when(F.col("absorbed"), absorbed_in).otherwise(rest_in)))
    pairs = tasks.select("root", "at.kind", "at.i", "at.j", "doc_id", "n", "tokens", "classes", "absorbed").groupBy("root", "kind", "i", "j").applyInArrow(trimmed(link), "u long, v long")
    return pairs.unionByName(marked.where("absorbed").select(F.col("doc_id").alias("u"), F.col("lead").alias("v")))


def _grouped(sets: DataFrame, orders: int, percent: int) -> DataFrame:
    """(doc_id, front, band, root) of the sets (doc_id, front, band, perhaps root) that share, under every order, a prefix token with
    another of their band or the next, directly or through others, and in all orders with the same others.

    Roots are the groups' smallest ids. With a root already, only sets of one root are joined."""
    within = ["root"] if "root" in sets.columns else []
    slot = F.explode(F.array("band", F.col("band") + 1)) if percent < 100 else F.col("band")
    shared = sets.select(*within, "doc_id", "band", F.explode("front").alias("token")).select(*within, "doc_id", "token", slot.alias("slot"))
    least = shared.groupBy(*within, "token", "slot").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    edges = shared.join(least, [*within, "token", "slot"]).select(F.shiftright("token", 40).cast("int").alias("order"), F.col("doc_id").alias("u"), F.col("least").alias("v"))
    found = components(edges, "order").groupBy("node").agg(*[F.max(F.when(F.col("order") == k, F.col("root"))).alias(f"r{k}") for k in range(orders)])
    roots = [f"r{k}" for k in range(orders)]
    found = found.dropna(subset=roots)
    groups = found.groupBy(*roots).agg(F.min("node").alias("root"), F.count("*").alias("size")).where("size > 1").drop("size")
    placed = materialize(found.join(groups, roots).select(F.col("node").alias("doc_id"), "root"), "groups")
    return sets.drop("root").join(_small(placed, placed.count()), "doc_id")


def ngram_join(docs: DataFrame, n: int = 4, percent: int = 85, orders: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of distinct n-word shingles have a Jaccard similarity of percent / 100 or more.

    Words are maximal runs without ASCII white space, A-Z lower-cased; a text of fewer than n words, but not none,
    is one shingle. Returns doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    1. Shingles are counted in hash buckets (see fingerprints); a shingle's class is the bit length of its count.
    2. Documents of equal sets become one class, represented by its smallest id.
    3. A global token order sorts by class, rarest first, then by a hash of the order's own. Two similar sets share
       a token of their prefixes under every such order, and are in one band of sizes or in neighbouring ones. Under each order
       representatives that share a prefix token in such bands are joined (stars around the smallest, then connected
       components); the orders are intersected, so a group is what all of them hold together, and the same is done once more
       inside the groups, where fewer sets share a token. Inside a group only pairs that pass the prefix filters of all
       orders, and the length filter, are verified, on whole sets.
    4. In a group whose sets exceed BLOCK_BYTES or BLOCK_ROWS every set is first compared with the group's smallest document. Those
       linked with it are one component and needn't be compared with each other; what is left, few in a group of near
       copies, is dealt into blocks that are compared with all blocks of the group and with each other, each two in a
       task of their own. Components then join what the tasks found.

    Empty, blank or null texts have no shingles and link with nothing. A null doc_id gets a null component_id and
    links with nothing. Rows of equal doc_id count as one document for components. Extra columns are ignored."""
    groups, no_id, n_buckets = fp.met_and_unmet(docs, id_col, text_col)
    count = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0))).first()[0]
    bits = min(TOKEN_BITS, max(32, int(count).bit_length() + 8))  # of hashes that are counted: a rare false match only changes a token's place in the orders
    cut = _U(TOKEN_BITS - bits)

    def counted(t: pa.Table):
        _, h = _sets(t, n)
        keys, times = np.unique(h >> cut, return_counts=True)
        return keys, np.minimum(times, 255).astype(np.uint8)

    def classes(first, by, extra, rank):
        total = np.add.reduceat(extra[by].astype(np.int64), first)
        cls = np.where(total < 2, 0, np.frexp(total.astype(float))[1]).astype(np.uint8)
        code = np.empty(len(by), np.uint8)
        code[by] = np.repeat(cls, np.diff(np.append(first, len(by))))
        return code

    def describe(t: pa.Table, answers: pa.Table) -> pa.Table:
        row, h = _sets(t, n)
        m = t.num_rows
        size = np.bincount(row, minlength=m)
        sums = []
        for seed in (101, 102):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, seed), dtype=np.uint64)])
            edge = np.concatenate([[0], np.cumsum(size)])
            sums.append(mix(total[edge[1:]] - total[edge[:-1]] + size.astype(np.uint64), seed))
        marks = np.stack(sums, 1).astype("<u8").tobytes()
        sig = [marks[16 * i : 16 * i + 16] for i in range(m)]
        tokens, cls_out, front = [None] * m, [None] * m, [None] * m
        if m and t["g"][0].as_py() >= 0:
            keys, which = np.unique(h >> cut, return_inverse=True)
            cls = fp.codes(answers, len(keys))[which]
            shared = cls > 0
            common = np.bincount(row[shared], minlength=m)
            take = np.maximum(_prefix(size, percent) - (size - common), 0)
            take[size == 0] = 0
            ids, once = t["doc_id"].to_numpy(), {}
            for i in np.argsort(ids, kind="stable"):
                if take[i] and once.setdefault(sig[i], ids[i]) != ids[i]:
                    take[i] = 0  # an equal set of a smaller id in this group stands for it
            use = shared & (take[row] > 0)
            r, hh, cc = row[use], h[use], cls[use]
            # tokens of 40 bits, the order's number above them
            at_front = np.stack([_fronts(r, hh, cc, take, k) for k in range(orders)])
            short = np.stack([(hh >> _U(TOKEN_BITS - 40)).astype(np.int64) | (k << 40) for k in range(orders)])
            edge = np.searchsorted(r, np.arange(m + 1))
            for i in np.flatnonzero(take):
                s = slice(edge[i], edge[i + 1])
                tokens[i], cls_out[i] = fp.pack(hh[s]), cc[s].tobytes()
                front[i] = short[:, s][at_front[:, s]]
        return pa.table(
            {
                "doc_id": t["doc_id"].cast(pa.int64()),
                "n": pa.array(size, pa.int64()),
                "sig": pa.array(sig, pa.binary()),
                "tokens": pa.array(tokens, pa.binary()),
                "classes": pa.array(cls_out, pa.binary()),
                "front": pa.array(front, pa.list_(pa.int64())),
            }
        )

    def unmet_rows(batches):
        none = pa.table({c: pa.array([], t) for c, t in (("g", pa.int64()), ("b", pa.int32()), ("answer", pa.binary()))})
        for b in batches:
            yield from describe(pa.table(b), none).to_batches()

    schema = "doc_id long, n long, sig binary, tokens binary, classes binary, front array<long>"
    unmet = no_id.mapInArrow(lean(unmet_rows), schema)
    answers = fp.answer(fp.send(groups, n_buckets, counted, bits), classes)
    described = materialize(
        groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(trimmed(describe), schema).unionByName(unmet), "shingle-sets"
    )
    reps = described.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    first = described.where("front is not null").select("doc_id", "n", "sig", "front").join(reps, "sig").where("doc_id = rep")
    band = F.floor(F.ln("n") / (math.log(100 / percent) * (1 + 1e-9))).cast("int") if percent < 100 else F.col("n")
    near = _grouped(_grouped(first.select("doc_id", "front", band.alias("band")), orders, percent), orders, percent).select(F.col("doc_id").alias("node"), "root")
    near = _small(near, near.count())
    sets = described.where("tokens is not null").select("doc_id", "n", "tokens", "classes").join(near, F.col("doc_id") == F.col("node")).select("doc_id", "n", "tokens", "classes", "root")
    large = sets.groupBy("root").agg(F.sum(F.octet_length("tokens")).alias("bytes"), F.count("*").alias("rows")).where((F.col("bytes") > BLOCK_BYTES) | (F.col("rows") > BLOCK_ROWS)).select("root")
    large = materialize(large, "large-groups")
    n_large = large.count()

    def link(t: pa.Table) -> pa.Table:
        ids, root = _links(t, percent, orders)
        return pa.table({"u": pa.array(ids, pa.int64()), "v": pa.array(root, pa.int64())})

    few = _small(large, n_large)
    linked = sets.join(few, "root", "left_anti").groupBy("root").applyInArrow(trimmed(link), "u long, v long")
    if not n_large:
        linked = linked.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("component"))
    else:
        linked = linked.unionByName(_large_groups(sets.join(few, "root", "left_semi"), n_large, percent, link))
        linked = components(linked).select(F.col("node").alias("rep"), F.col("root").alias("component"))
    own = reps.join(linked, "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    whole = described.select("doc_id", "n", "sig").join(own, "sig", "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
