"""Corpus-wide lookups of window hashes, without a row per window in any shuffle.

Documents are dealt to *groups*. Each group sends its sorted distinct 64-bit hashes to hash-range *buckets*: one small
binary row per group and bucket, delta-packed, or plain where a row has few entries. A bucket answers every group
with one small code per hash; the answers meet the group's documents again in a co-group that reuses the same shuffle
of the texts. A hash that occurs in a third of all documents costs one entry per group, whatever its count.

Rows number groups times buckets, the square of the input over GROUP_BYTES * BUCKET_BYTES, so groups grow with the
input up to MOST_GROUP_BYTES: 15 thousand groups and 960 buckets at 30 GB, 65 thousand and 33 thousand at 1 TB, with
about 80 entries a row. Near 100 TB a row holds a handful of entries, about as many rows as a shuffle of windows has
after it was combined by group. Rows are cut out of whole arrays, none is a Python object unless it is packed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrave.llm.common import partitions, total_bytes
from margrave.llm.textops import trimmed

#: Bytes of text of a group of documents, at least and at most, and how many groups there are before they grow.
GROUP_BYTES, MOST_GROUP_BYTES, MOST_GROUPS = 2 << 20, 16 << 20, 1 << 16
#: Bytes of a hash bucket's share of all texts; quantiles of ids that cut groups.
BUCKET_BYTES = 32 << 20
CUTS = 2048
#: Rows of fewer entries than this, on average, are sent plain.
PACKED = 64
#: Parts of a group whose rows have one id, at most.
PARTS = 1 << 20


def pack(hashes: np.ndarray) -> bytes:
    """Ascending hashes, one at least: the first, then differences in as few bytes each as the largest needs."""
    d = np.diff(hashes)
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return bytes([width]) + hashes[:1].astype("<u8").tobytes() + np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width, raw = blob[0], np.frombuffer(blob, np.uint8, offset=9)
    d = np.zeros((1 + len(raw) // width, 8), np.uint8)
    d[0] = np.frombuffer(blob, np.uint8, 8, 1)
    d[1:, :width] = raw.reshape(-1, width)
    return np.add.accumulate(d.view("<u8").reshape(-1))


def plain(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values that end at `ends`: a byte 0, then the values' bytes as they are."""
    item, n = values.itemsize, len(ends)
    marks = np.concatenate([[0], ends * item + np.arange(1, n + 1)])
    out, body = np.zeros(marks[-1], np.uint8), np.ones(marks[-1], bool)
    body[marks[:-1]] = False
    out[body] = np.ascontiguousarray(values).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(marks.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def packed(blobs: list[bytes]) -> pa.Array:
    return pa.array([b"\1" + b for b in blobs], pa.binary())


def runs(column: pa.ChunkedArray | pa.Array, order: np.ndarray, kind: str, open_blob: Callable[[bytes], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values end to end) of a column's blobs in an order; blobs are plain, or a byte 1 and what open_blob takes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary()).take(pa.array(order))
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, kind)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8)
    if not data[off[:-1]].any():
        body = np.ones(off[-1] - off[0], bool)
        body[off[:-1] - off[0]] = False
        return (np.diff(off) - 1) // np.dtype(kind).itemsize, data[off[0] : off[-1]][body].view(kind)
    parts = [open_blob(b[1:]) if b[0] else np.frombuffer(b, kind, offset=1) for b in column.to_pylist()]
    return np.array([len(p) for p in parts]), np.concatenate(parts)


def _inflated(kind: str) -> Callable[[bytes], np.ndarray]:
    return lambda blob: np.frombuffer(zlib.decompress(blob), kind)


def bucket_of(hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Which of n hash ranges of equal size each hash of so many bits, 32 at least, lies in; n is under 2^32."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(doc_id, text, g) with g growing with doc_id, and -1 for null, and the number of hash buckets for them.

    g comes from approximate quantiles of the ids, so that groups have like numbers of rows, and, if more than CUTS
    groups are wanted, from equal steps between two quantiles. Equal ids share a rank, g // PARTS; an id that is two
    quantiles at once has so many rows that its rank is dealt out to PARTS groups, by text and place in the input.
    Sizes follow the bytes of text, so a group fits one task at any scale."""
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size, p = total_bytes(own, "text"), partitions(spark)
    n_groups = max(2 * p, size // max(GROUP_BYTES, min(MOST_GROUP_BYTES, size // MOST_GROUPS)))
    n_buckets = max(2 * p, size // BUCKET_BYTES)
    n_cuts = max(2, min(n_groups, CUTS))
    steps = -(-n_groups // n_cuts)
    first = own.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n_cuts) for i in range(1, n_cuts)]), 10 * n_cuts).alias("q"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    found = list(first["q"] or [])
    if not found:
        return own.select("doc_id", "text", F.lit(-1).cast("long").alias("g")), int(n_buckets)
    hot = sorted({int(a) for a, b in zip(found, found[1:]) if a == b and abs(a) < 1 << 53})  # beyond, doubles don't tell neighbours apart
    bounds = sorted({float(x) for x in found} | {float(x + 1) for x in hot})  # a hot id is alone between two bounds
    cut = Bucketizer(splits=[-np.inf, *bounds, np.inf], inputCol="_id", outputCol="_g", handleInvalid="keep")
    out = cut.transform(own.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
    low, high = (F.get(F.array(*[F.lit(x) for x in ends]), F.col("_g").cast("int")) for ends in ([float(first["lo"]), *bounds], [*bounds, float(first["hi"])]))
    step = F.floor((F.col("_id") - low) * steps / F.greatest(high - low, F.lit(1.0))) if steps > 1 else F.lit(0)
    inside = F.greatest(F.lit(0), F.least(step, F.lit(steps - 1)))
    rank = F.col("_g").cast("int") * steps + inside
    parts = max(1, min(PARTS, n_groups))
    part = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(parts)) if hot else F.lit(0)
    part = F.when(F.col("doc_id").isin(hot), part).otherwise(0) if hot else part
    g = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(rank * PARTS + part)
    return out.select("doc_id", "text", g.cast("long").alias("g")), int(n_buckets)


def met_and_unmet(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """grouped's rows by whether they have an id: those without one meet no others, and must not make a group; and the number of buckets."""
    groups, n_buckets = grouped(docs, id_col, text_col)
    return groups.where("doc_id is not null"), groups.where("doc_id is null"), n_buckets


ANSWERS = "g long, b int, answer binary"


def send(groups: DataFrame, n_buckets: int, hashes: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], bits: int = 64) -> DataFrame:
    """One row (g, b, keys, extra) per group and bucket. hashes(documents of a group): its distinct hashes ascending, and a number with each."""

    def emit(t: pa.Table) -> pa.Table:
        g, (h, extra) = t["g"][0].as_py(), hashes(t)
        bucket, first = np.unique(bucket_of(h, n_buckets, bits), return_index=True)
        ends = np.append(first[1:], len(h)) if len(h) else first
        if len(h) >= PACKED * len(ends):
            rows = list(zip(first.tolist(), ends.tolist()))
            keys, more = packed([pack(h[i:j]) for i, j in rows]), packed([zlib.compress(extra[i:j].tobytes(), 1) for i, j in rows])
        else:
            keys, more = plain(h, ends), plain(extra, ends)
        return pa.table({"g": pa.array(np.full(len(ends), g), pa.int64()), "b": pa.array(bucket, pa.int32()), "keys": keys, "extra": more})

    return groups.groupBy("g").applyInArrow(trimmed(emit), "g long, b int, keys binary, extra binary")


def answer(sent: DataFrame, reply: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], extra: str = "u1", checked: bool = False) -> DataFrame:
    """ANSWERS. reply(run starts of equal hashes in sorted order, order, number by entry, rank by entry) gives a uint8 code by entry.

    Entries come by ascending g, and a run's too. extra: type of the numbers. checked: hashes are equal only if their
    numbers are."""

    def solve(t: pa.Table) -> pa.Table:
        b, order = t["b"][0].as_py(), np.argsort(t["g"].to_numpy(), kind="stable")
        gs = t["g"].to_numpy()[order]
        n, h = runs(t["keys"], order, "<u8", unpack)
        _, more = runs(t["extra"], order, extra, _inflated(extra))
        by = np.lexsort((more, h)) if checked else np.argsort(h, kind="stable")
        s = h[by]
        new = s[1:] != s[:-1]
        if checked:
            new |= more[by][1:] != more[by][:-1]
        first = np.flatnonzero(np.concatenate([[True], new]))
        code = reply(first, by, more, np.repeat(gs // PARTS, n)).astype(np.uint8)
        ends = np.cumsum(n)
        if len(h) >= PACKED * len(n):
            answers = packed([zlib.compress(code[e - m : e].tobytes(), 1) for e, m in zip(ends.tolist(), n.tolist(), strict=True)])
        else:
            answers = plain(code, ends)
        return pa.table({"g": pa.array(gs, pa.int64()), "b": pa.array([b] * len(gs), pa.int32()), "answer": answers})

    return sent.groupBy("b").applyInArrow(trimmed(solve), ANSWERS)


def codes(answers: pa.Table, n: int) -> np.ndarray:
    """The codes of a group's n distinct hashes, in ascending order of hash."""
    _, found = runs(answers["answer"], np.argsort(answers["b"].to_numpy(), kind="stable"), "u1", _inflated("u1"))
    if len(found) != n:
        raise ValueError(f"{len(found)} answers for {n} hashes: a group's documents changed between two reads of the input")
    return found
