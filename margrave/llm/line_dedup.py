"""Repeated runs of lines, found by prefix doubling over line ids; all copies but the first are deleted."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from margrave.llm.common import free_name, materialize
from margrave.llm.textops import lean

#: A line of white space alone isn't part of any run.
_INK = r"[^\x20\x09-\x0D]"
#: Texts handled at a time.
ROWS = 256
#: Documents with deleted lines are broadcast up to this number of documents and of runs, else joined by shuffle.
BROADCAST_ROWS, BROADCAST_RUNS = 500_000, 5_000_000


def _ranked(pairs: DataFrame, *by: str) -> DataFrame:
    """pairs with `place`, which grows with the columns by: a row's place in its range partition, after the partition's number."""
    return materialize(pairs.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), "ranks")


def suffix_ranks(lines: DataFrame, least: int) -> tuple[list[DataFrame], DataFrame]:
    """Prefix doubling over lines (key, doc_id, i, h1, h2).

    Gives for k = 0, 1, ... the suffixes (key, doc_id, i, rank, first) whose first 2^k lines occur more than once;
    suffixes of equal rank agree in these lines and lie together in the suffix array, ranks grow with its order of line
    ids (line id: the order of hashes), and first is the place of the first of them. A suffix that is alone keeps its
    place and needs no further round; rounds end when none is left. And, second, the suffixes (key, doc_id, i, first)
    whose first `least` lines occur at an earlier place, with the first such place.

    Places are ordered by doc_id, then key (one per document), then line."""
    place = F.struct("doc_id", "key", "i")

    def refined(rows: DataFrame, *by: str) -> DataFrame:
        classes = _ranked(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), *by)
        return rows.join(classes, list(by)).select("key", "doc_id", "i", F.col("place").alias("rank"), "first")

    levels, k = [], 0
    rows = refined(lines, "h1", "h2")
    while True:
        level = materialize(rows, f"suffixes-{k}")
        if level.isEmpty():
            break
        levels.append(level)
        ahead = level.select("key", "doc_id", (F.col("i") - (1 << k)).alias("i"), F.col("rank").alias("next"))
        rows = refined(level.select("key", "doc_id", "i", "rank").join(ahead, ["key", "doc_id", "i"]), "rank", "next")
        k += 1
    none = lines.select("key", "doc_id", "i", place.alias("first")).limit(0)
    # the class of `least` lines: ranks of powers of two that add up to it
    bits = [b for b in range(least.bit_length() - 1, -1, -1) if least >> b & 1]
    if bits[0] >= len(levels):
        return levels, none
    out, done = levels[bits[0]], 1 << bits[0]
    for b in bits[1:]:
        ahead = levels[b].select("key", "doc_id", (F.col("i") - done).alias("i"), F.col("rank").alias("next"))
        out, done = materialize(refined(out.select("key", "doc_id", "i", "rank").join(ahead, ["key", "doc_id", "i"]), "rank", "next"), "suffixes"), done + (1 << b)
    return levels, out.where(F.col("first") < place).select("key", "doc_id", "i", "first")


def common_prefixes(pairs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """pairs (key, doc_id, i, first) with `length`: the longest common prefix, in lines, of the suffixes at the two places.

    It is under 2^len(levels). From the last level to the first, both suffixes move on by 2^k lines if those are in
    one class of level k: a binary descent over the stored ranks of the prefix doubling."""
    out = pairs.withColumn("length", F.lit(0))
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k].select("key", "doc_id", F.col("i").alias("at"), F.col("rank").alias("here"))
        there = levels[k].select(F.col("key").alias("key2"), F.col("doc_id").alias("id2"), F.col("i").alias("at2"), F.col("rank").alias("there"))
        out = out.withColumns({"at": F.col("i") + F.col("length"), "key2": F.col("first.key"), "id2": F.col("first.doc_id"), "at2": F.col("first.i") + F.col("length")})
        out = out.join(here, ["key", "doc_id", "at"], "left").join(there, ["key2", "id2", "at2"], "left")
        more = F.when(F.col("here") == F.col("there"), 1 << k).otherwise(0)
        out = materialize(out.select("key", "doc_id", "i", "first", (F.col("length") + more).alias("length")), "prefixes")
    return out


def repeated_runs(lines: DataFrame, min_lines: int) -> DataFrame:
    """Maximal repeated runs of min_lines lines or more, of lines (key, doc_id, i, h1, h2): key, doc_id, i (first line of a
    later copy), first (place of the first copy) and length, in lines. With a boolean column `long`, later copies of
    single long lines are runs too, of length 1 where min_lines is more.

    A suffix whose first min_lines lines occur earlier is a later member of an interval of the suffix array with longest
    common prefixes of min_lines or more. It begins a run unless the lines before it and before the first copy begin
    or continue the same one; its common prefix with the first copy is the run's length. Runs that end inside an
    earlier one of their document, as those of a repeated line do, are left out."""
    levels, later = suffix_ranks(lines, min_lines)
    if not levels:
        return later.withColumn("length", F.lit(0))
    if "long" in lines.columns:
        alone = levels[0].where(F.col("first") < F.struct("doc_id", "key", "i")).join(lines.where("long").select("key", "doc_id", "i"), ["key", "doc_id", "i"], "left_semi")
        alone = alone.select("key", "doc_id", "i", "first", F.lit(1).alias("length"))
    later = materialize(later, "later")
    before = later.select("key", "doc_id", (F.col("i") + 1).alias("i"), F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"), (F.col("first.i") + 1).alias("i")).alias("first"))
    runs = common_prefixes(later.join(before, ["key", "doc_id", "i", "first"], "left_anti"), levels)
    ends = F.max(F.col("i") + F.col("length")).over(Window.partitionBy("key", "doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("ends", ends).where("ends is null or i + length > ends").drop("ends")
    return runs.unionByName(alone) if "long" in lines.columns else runs


def line_dedup(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """Delete the later copies of every maximal run of min_lines or more lines that occurs more than once.

    With long_words also the later copies of every single line of so many words or more, whatever stands around it.

    Lines end at line feeds; lines of white space alone are no part of a run, and stay. The first copy, by doc_id and
    line, stays; a line is deleted if it lies in a run whose lines also start at an earlier place, of another
    document or of the same. Returns docs with the text replaced by what is left, and n_lines and n_removed (of lines
    that aren't blank); columns of those names are replaced, all others are kept.

    Runs come from the suffix array of all documents' line ids (see repeated_runs), and what is deleted is the union of
    their later copies. A run's length is that of its common prefix with the first copy, up to the whole document.

    Null texts stay null. Rows of null id are kept whole and count as no one's copy. Rows of one id and different
    texts are separate documents, ordered by a hash; equal rows get equal results, as one document. Lines count as
    equal if their two 64-bit hashes are."""
    docs = docs.drop("n_lines", "n_removed")
    key_col, k_col, doc_col, runs_col = (free_name(n, docs.columns) for n in ("key_", "key2_", "doc_", "runs_"))
    keyed = docs.withColumn(key_col, F.xxhash64(F.col(id_col), F.col(text_col)))
    own = keyed.where(F.col(id_col).isNotNull()).select(F.col(key_col).alias("key"), F.col(id_col).alias("doc_id"), F.filter(F.split(text_col, "\n"), lambda x: x.rlike(_INK)).alias("lines"))
    lines = own.where(F.size("lines") >= (min_lines if long_words is None else 1)).select("key", "doc_id", F.posexplode("lines").alias("i", "line"))
    long = [] if long_words is None else [(F.size(F.regexp_extract_all("line", F.lit(_INK + "+"), F.lit(0))) >= long_words).alias("long")]
    lines = lines.select("key", "doc_id", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), *long).distinct()
    runs = repeated_runs(materialize(lines, "lines"), min_lines).groupBy("key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "length"))).alias(runs_col))
    runs = materialize(runs.select(F.col("key").alias(k_col), F.col("doc_id").alias(doc_col), runs_col), "runs")
    size = runs.agg(F.count("*"), F.coalesce(F.sum(F.size(runs_col)), F.lit(0))).first()
    small = F.broadcast(runs) if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_RUNS else runs
    met = keyed.join(small, (F.col(key_col) == F.col(k_col)) & (F.col(id_col) == F.col(doc_col)), "left")
    met = met.drop(key_col, k_col, doc_col)

    def delete(batches):
        import re

        ink = re.compile(_INK)
        for b in (batch.slice(lo, ROWS) for batch in batches for lo in range(0, batch.num_rows, ROWS)):
            texts, n_lines, n_removed = [], [], []
            for text, runs in zip(b[text_col].to_pylist(), b[runs_col].to_pylist(), strict=True):
                parts = text.split("\n") if text is not None else []
                number, gone, end = -1, set(), 0
                for run in runs or ():
                    gone.update(range(max(run["i"], end), run["i"] + run["length"]))
                    end = max(end, run["i"] + run["length"])
                kept = []
                for line in parts:
                    if ink.search(line):
                        number += 1
                        if number in gone:
                            continue
                    kept.append(line)
                texts.append("\n".join(kept) if text is not None else None)
                n_lines.append(number + 1)
                n_removed.append(len(gone))
            names = [n for n in b.schema.names if n != runs_col]
            yield pa.RecordBatch.from_arrays([*[pa.array(texts, pa.string()) if n == text_col else b[n] for n in names], pa.array(n_lines, pa.int32()), pa.array(n_removed, pa.int32())], [*names, "n_lines", "n_removed"])

    schema = StructType([*docs.schema.fields, StructField("n_lines", IntegerType()), StructField("n_removed", IntegerType())])
    return met.mapInArrow(lean(delete), schema)
