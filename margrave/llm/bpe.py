"""Byte-level BPE: encoding whose unit of work is a piece of a text, and decoding."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrave.llm.common import materialize, partitions
from margrave.llm.textops import lean

#: Characters of a chunk, and of the overlap in which neighbours' boundaries are compared.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Texts in an Arrow batch that goes back to Spark.
ROWS = 512


@functools.lru_cache(4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@functools.lru_cache(4)
def _pieces(ranks: bytes) -> dict[int, bytes]:
    return {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.splitlines())}


def _ids(encoded: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *[x.view(np.int32) for x in encoded]])))


def _decoded(table: dict[int, bytes], ids: pa.ListArray) -> pa.Array:
    every = [table[i] for i in ids.flatten().to_pylist()]
    at = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
    return pa.array([b"".join(every[i:j]) for i, j in zip(at, at[1:])], pa.binary())


def boundaries(text: str, pattern: str, begin: int, end: int, last: bool) -> list[int]:
    """Where, from begin to end, a match of pattern ends on a character that isn't white space, or the text itself ends.

    At such a place a text can be cut: no match looks back, and none of these matches depends on what follows it.
    Unless text is the last chunk, its own end isn't a known boundary."""
    import regex

    out = [m.end() for m in regex.compile(pattern).finditer(text) if begin <= m.end() <= end and not text[m.end() - 1].isspace()]
    return out if last or not out or out[-1] < len(text) else out[:-1]


def cuts(chunks: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """Starts of a text's pieces. chunks: by number, boundaries at the front and at the back of each, as offsets in the text.

    The first boundary that two neighbours share is where the later chunk, which began at an arbitrary character,
    has fallen in step with the true matches; from there on both are the same. Where no boundary is shared the rest
    of the text is one piece, so ids are right in any case."""
    out = [0]
    for (_, _, back), (_, front, _) in zip(chunks, chunks[1:], strict=False):
        both = set(back) & set(front)
        if not both:
            break
        out.append(min(both))
    return out


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """doc_id and ids array<int>: each match of pattern in the text, merged by the ranks of a tiktoken file.

    With decoded also what bpe_decode gives for the ids; texts encoded whole are then decoded by the same worker.

    Texts of up to `chunk` characters are encoded whole. A longer text is cut into chunks that overlap: chunks are
    split by the pattern in parallel, the cuts are moved to boundaries on which neighbours agree (see cuts), and the
    pieces between them are encoded in parallel and put together by number. The rank file is read by the driver and
    broadcast (about 1 MB).

    Null and empty texts have no ids; null and repeated doc_ids stay, a row each. Extra columns are ignored."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value, pattern)
        for b in batches:
            names = [n for n in b.schema.names if n != "text"]
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                yield pa.RecordBatch.from_arrays([*[part[n] for n in names], encoded_batch(enc, part)], [*names, "ids"])

    def encoded_batch(enc, part: pa.RecordBatch) -> pa.Array:
        return _ids([enc.encode_to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32) for t in part["text"].to_pylist()])

    def round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = _encoding(ranks.value, pattern), _pieces(ranks.value)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                ids = encoded_batch(enc, part)
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids, _decoded(table, ids)], ["doc_id", "ids", "decoded"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = own.where(F.length("text") <= chunk)
    short = short.mapInArrow(lean(round_trip), "doc_id long, ids array<int>, decoded binary") if decoded else short.mapInArrow(lean(encode), "doc_id long, ids array<int>")
    long = materialize(own.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "long-texts")

    def cut_chunks(batches):
        for b in batches:
            for row, text in zip(b["row"].to_pylist(), b["text"].to_pylist(), strict=True):
                n = -(-len(text) // chunk)
                for k in range(n):
                    part = text[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([k == n - 1]), pa.array([part])], ["row", "k", "last", "text"])

    def find(batches):
        for b in batches:
            fronts, backs = [], []
            for k, last, text in zip(b["k"].to_pylist(), b["last"].to_pylist(), b["text"].to_pylist(), strict=True):
                at = np.array(boundaries(text, pattern, 0, len(text), last), np.int64)
                fronts.append((at[at <= overlap] + k * chunk).tolist())
                backs.append((at[at >= chunk] + k * chunk).tolist())
            yield pa.RecordBatch.from_arrays([b["row"], b["k"], pa.array(fronts, pa.list_(pa.int64())), pa.array(backs, pa.list_(pa.int64()))], ["row", "k", "front", "back"])

    def stitch(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["k"].to_pylist(), t["front"].to_pylist(), t["back"].to_pylist(), strict=True))
        return pa.table({"row": t["row"][:1], "starts": pa.array([cuts(rows)], pa.list_(pa.int64()))})

    def cut_pieces(batches):
        for b in batches:
            for doc_id, row, text, starts in zip(b["doc_id"].to_pylist(), b["row"].to_pylist(), b["text"].to_pylist(), b["starts"].to_pylist(), strict=True):
                for k, (i, j) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True)):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([text[i:j]])], ["doc_id", "row", "k", "text"])

    p = partitions(spark)
    starts = long.mapInArrow(lean(cut_chunks), "row long, k int, last boolean, text string").repartition(p, "row", "k").mapInArrow(lean(find), "row long, k int, front array<long>, back array<long>").groupBy("row").applyInArrow(stitch, "row long, starts array<long>")
    pieces = long.join(starts, "row").select("doc_id", "row", "text", "starts").mapInArrow(lean(cut_pieces), "doc_id long, row long, k int, text string").repartition(p, "row", "k")
    encoded = pieces.mapInArrow(lean(encode), "doc_id long, row long, k int, ids array<int>")
    whole = encoded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    whole = whole.select("doc_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
    return short.unionByName(bpe_decode(whole, ranks_path) if decoded else whole)


def bpe_decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: the bytes of its ids, one after the other. Null ids give no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def decode(batches):
        table = _pieces(ranks.value)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                ids = part[ids_col].fill_null([]) if part[ids_col].null_count else part[ids_col]
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(table, ids)], [*part.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return encoded.mapInArrow(lean(decode), StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))
