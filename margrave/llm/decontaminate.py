"""Documents that hold passages of benchmark items: a prefix-filtered set join in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from margrave.llm.common import ascii_lower, materialize

#: Words outside of letters a-z, digits and non-ASCII characters end a word.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle.
SHINGLE = 3
#: Hashes of item shingles, starts of candidates, and texts of windows are broadcast up to these numbers, else joined by shuffle.
BROADCAST_HASHES, BROADCAST_STARTS, BROADCAST_WINDOWS = 1_000_000, 1_000_000, 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def _shingles(ws: Column, size: int) -> Column:
    """Hashes of the runs of size words, by position."""
    n = F.size(ws)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(F.lit(size), *[ws[i + j] for j in range(size)]))).otherwise(F.array().cast("array<long>"))


def _small(df: DataFrame, most: int, size: Column | None = None) -> DataFrame:
    """df, to be broadcast if it has at most so many rows, or items as size counts them."""
    n = df.count() if size is None else df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= most else df


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Find the words of documents inside any occurrence of a window of an item.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Texts
    are lower-cased (A-Z); words are runs of digits, letters and non-ASCII characters. Returns doc_id, n_words,
    n_hit (words in an occurrence), n_items and item_ids (items with windows that occur, sorted as strings).

    Every window is a set of shingles that a document must contain whole, so one shingle is prefix enough: the one
    rarest in the corpus. Documents' shingles meet the items' shingles by hash; rarity is counted over all of these
    meetings; meetings of a window's rarest shingle give a start, which must leave the window inside the document;
    the words there are then compared with the window's words in full.

    Null texts have no words; items of null id are ignored; several rows of one item_id count as one item. Rows of
    equal doc_id are judged each by its own text. Extra columns are ignored. No items: nothing is hit."""
    own_items = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("ws")).where("item is not null and size(ws) > 0")
    each = own_items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1))), lambda i: F.slice("ws", i, window))).alias("ws"))
    windows = materialize(each.select("item", "ws", F.array_join("ws", " ").alias("win")).distinct(), "windows")
    sets = windows.select("win", "ws").distinct()
    pieces = None
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("ws"), F.lit(SHINGLE))).distinct().collect())
    for size in sizes:
        part = sets.where(F.least(F.size("ws"), F.lit(SHINGLE)) == size).select("win", F.size("ws").alias("len"), F.posexplode(_shingles(F.col("ws"), size)).alias("at", "h"))
        pieces = part if pieces is None else pieces.unionByName(part)

    # two hashes tell documents apart: 128 bits
    key = F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("a"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("b"))
    own = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), words(F.col(text_col)).alias("ws"))
    if pieces is None:
        return own.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("item_ids"))
    pieces = materialize(pieces, "item-shingles")
    tokens = F.flatten(F.array(*[F.transform(_shingles(F.col("ws"), size), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for size in sizes])) if len(sizes) > 1 else None
    if tokens is None:
        met = own.select("key", F.size("ws").alias("n"), F.posexplode(_shingles(F.col("ws"), sizes[0])).alias("pos", "h"))
    else:
        met = own.select("key", F.size("ws").alias("n"), F.explode(tokens).alias("t")).select("key", "n", "t.pos", "t.h")
    met = materialize(met.join(_small(pieces.select("h").distinct(), BROADCAST_HASHES), "h", "left_semi"), "met-shingles")

    often = met.groupBy("h").agg(F.count("*").alias("df"))
    ranked = pieces.join(_small(often, BROADCAST_HASHES), "h", "left")
    prefix = ranked.groupBy("win", "len").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "at")).alias("least")).where("least.df > 0")
    prefix = materialize(prefix.select("len", F.col("least.h").alias("h"), F.col("least.at").alias("at")).distinct(), "prefixes")
    start = F.col("pos") - F.col("at")
    starts = met.join(_small(prefix, BROADCAST_HASHES), "h").where((start >= 0) & (start + F.col("len") <= F.col("n"))).select("key", start.alias("start"), "len").distinct()
    by_doc = materialize(starts.groupBy("key").agg(F.collect_list(F.struct("start", "len")).alias("cands")), "candidates")
    text_at = F.transform("cands", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), F.array_join(F.slice("ws", c["start"] + 1, c["len"]), " ").alias("win")))
    found = materialize(own.join(_small(by_doc, BROADCAST_STARTS, F.size("cands")), "key", "left").select("doc_id", "key", F.size("ws").cast("long").alias("n_words"), text_at.alias("found")), "found")

    hits = materialize(found.where("found is not null").select("key", F.explode("found").alias("f")).select("key", "f.*").join(_small(sets.select("win"), BROADCAST_WINDOWS), "win", "left_semi").distinct(), "hits")
    spans = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    words_hit = hits.groupBy("key").agg(F.collect_set(F.struct("start", "len")).alias("spans")).select("key", spans.cast("long").alias("n_hit"))
    # a row per document and item, however many occurrences and windows they share
    items_hit = hits.select("key", "win").distinct().join(_small(windows.select("win", "item"), BROADCAST_WINDOWS), "win").select("key", "item").distinct()
    items_hit = items_hit.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    per_doc = words_hit.join(items_hit, "key").select("key", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids")
    none = F.array().cast("array<string>")
    return found.join(per_doc, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("item_ids", none).alias("item_ids")
    )
