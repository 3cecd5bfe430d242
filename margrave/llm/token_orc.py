"""Token ids of a corpus in ORC: run-length coded integers, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import functools
import json
import os
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from margrave.llm.common import materialize, partitions
from margrave.llm.textops import lean, run_hashes, slices, utf8

SCHEMA = "doc_id long, ids array<int>"
#: Of the files: bytes of a stripe, rows of an index entry, share of false positives of the Bloom filters.
STRIPE, STRIDE, FPP = 64 << 20, 1000, 0.01
#: Splits text as the byte-level pre-tokenizer of the tokenizers library does.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are split at a time; slots for pieces a worker remembers, and ids these may have in all.
SLICE, SLOTS, POOL = 1 << 20, 1 << 20, 1 << 23
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of every code point."""
    import regex

    out, every = np.zeros(0x110000, np.uint8), "".join(map(chr, range(0x110000)))
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


@functools.cache
def _byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


def piece_starts(code: np.ndarray, offsets: np.ndarray, text: str) -> np.ndarray:
    """Where SPLIT's matches start, over texts that lie end to end: code points, the texts' offsets, and the same as a string.

    Without contractions the pattern says: runs of one kind, except that the last white space before other
    characters is a piece of its own, and if a space joins the piece after it. Texts with an apostrophe that may
    begin a contraction are split by the pattern itself."""
    import regex

    n, kind = len(code), _kinds()[code]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    start = begins[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~begins[1:n])
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    mark = np.flatnonzero(code[:-1] == 39)
    mark = mark[np.isin(code[mark + 1], [ord(c) for c in "stmdrvl"])]
    for d in np.unique(np.searchsorted(offsets, mark, "right") - 1):
        i, j = offsets[d], offsets[d + 1]
        start[i:j] = False
        start[[i + m.start() for m in regex.finditer(SPLIT, text[i:j])]] = True
    return np.flatnonzero(start)


def splits_by_kind(spec: str) -> bool:
    """Whether a tokenizers file splits texts by SPLIT and merges each piece alone, as PieceEncoder does."""
    parts = json.loads(spec)
    pre, model = parts.get("pre_tokenizer") or {}, parts.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return plain and parts.get("normalizer") is None and parts.get("truncation") is None and parts.get("padding") is None and model.get("type") == "BPE" and not model.get("dropout")


class PieceEncoder:
    """Encodes texts by a byte-level tokenizer of the tokenizers library. A worker remembers pieces' ids, by the pieces' 64-bit hashes, in a table of fixed size.

    A slot's piece is taken for another if their hashes are equal: 2^-64 for each piece looked up, under 10^-6 for a
    corpus of 10^13 pieces. Files that normalize texts or split them in another way go to the library as a whole."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_pieces = Tokenizer.from_str(spec), splits_by_kind(spec)
        self.model, self.special = self.tokenizer.model, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        # an empty slot's key is a hash that belongs to another slot
        self.key = (np.arange(SLOTS, dtype=np.uint64) ^ np.uint64(1)) << np.uint64(64 - SLOTS.bit_length() + 1)
        self.begin, self.length = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.pool, self.used = np.zeros(POOL, np.int32), 0

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters = _byte_letters()
        ids = [[t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(letters))] for p in pieces]
        length = np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.int32)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(POOL, len(flat)), np.int32)])
        begin = self.used + np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return begin, length

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) of texts as UTF-8 bytes and their offsets."""
        text = data.tobytes().decode()
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # offsets in characters
        docs = len(at) - 1
        if not self.by_pieces or any(s in text for s in self.special):
            each = [np.array(self.tokenizer.encode(text[i:j], add_special_tokens=False).ids, np.int32) for i, j in zip(at, at[1:])]
            return np.concatenate([np.zeros(0, np.int32), *each]), np.array([len(x) for x in each], np.int64)
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(docs, np.int64)
        if self.used > POOL * 3 // 4:
            self._forget()
        start = piece_starts(code, at, text)
        end = np.append(start[1:], len(code))
        h = run_hashes(code.astype(np.uint64), start, end)
        slot = (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        begin, length = self.begin[slot], self.length[slot]
        missing = np.flatnonzero(self.key[slot] != h)
        if len(missing):
            new, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
            first = missing[first]
            b, n = self._learn([text[i:j] for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            begin[missing], length[missing] = b[which], n[which]
            s = slot[first]
            self.key[s], self.begin[s], self.length[s] = new, b, n
        each = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(begin - each[:-1], length) + np.arange(each[-1])]
        return ids, np.diff(each[np.searchsorted(start, at)])


@functools.lru_cache(2)
def _encoder(spec: bytes) -> PieceEncoder:
    return PieceEncoder(spec.decode())


def write_token_orc(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text with a tokenizers file, append end_id, and write (doc_id, ids) to ORC files at path in ascending doc_id order.

    Documents are range-partitioned by id, so file names follow ids. Columns of integers are run-length coded
    in stripes, each with a row index and a Bloom filter on doc_id; stripes can be read in parallel, and skipped by
    their statistics. Special tokens' strings in a text become those tokens, as the tokenizers library does by default.

    Null and empty texts have end_id alone. Null ids come first; rows of equal id stay, next to each other. Extra
    columns are ignored. No rows: no ids."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def encode(batches):
        encoder = _encoder(spec.value)
        for b in batches:
            data, offsets = utf8(b["text"])
            for lo, hi in slices(offsets, SLICE):
                ids, n = encoder(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at = np.concatenate([[0], np.cumsum(n + 1)])
                out = np.full(at[-1], end_id, np.int32)
                inside = np.ones(at[-1], bool)
                inside[at[1:] - 1] = False
                out[inside] = ids
                yield pa.RecordBatch.from_arrays([b["doc_id"][lo:hi], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out))], ["doc_id", "ids"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = own.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FPP, "orc.create.index": "true", "orc.row.index.stride": STRIDE, "orc.stripe.size": STRIPE, "compression": "zstd"}
    ordered.mapInArrow(lean(encode), SCHEMA).write.options(**options).orc(path)


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) of all documents or of some; the latter reads only stripes whose statistics and Bloom filters admit them."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers), all read from the files.

    Running sums are kept inside each file; a file's own offset comes from the totals of the files before it, a row per file."""

    def measure(batches):
        for b in batches:
            ids, n = b["ids"], b["ids"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, at = np.ascontiguousarray(ids.flatten().to_numpy(), "<u4").tobytes(), np.concatenate([[0], np.cumsum(n)]) * 4
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["file"], b["row"], pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "file", "row", "n_tokens", "ids_crc32"])

    read = read_token_orc(spark, path).select("doc_id", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"), "ids")
    rows = materialize(read.mapInArrow(lean(measure), "doc_id long, file string, row long, n_tokens long, ids_crc32 long"), "token-index")
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")  # names past 99,999 aren't in the order of numbers
    before = F.coalesce(F.sum("n").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", before.alias("before"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("own", own).join(files, "file").select("doc_id", (F.col("before") + F.col("own")).cast("long").alias("start"), "n_tokens", "ids_crc32")
