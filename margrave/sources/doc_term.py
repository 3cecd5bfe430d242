"""Documents as bags of words with topics: counts or presence of words, presence of topics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margrave.dataset import Dataset

#: Columns of a wide table, at most; more words stay in the long form.
MAX_COLUMNS = 5000


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id of a file with an id per line, ascending."""
    return spark.read.text(path).select(F.trim("value").cast("long").alias("doc_id")).where("doc_id is not null").orderBy("doc_id")


def read_relevance(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, doc_id) of a file of lines `<name> <doc_id> 1`."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias(name), parts[1].cast("long").alias("doc_id"))


def ids_in_industry(industries: DataFrame, code: str) -> DataFrame:
    """Ids of an industry, ascending; repeated lines repeat."""
    return industries.where(F.col("industry") == code).select("doc_id").orderBy("doc_id")


def read_tokens(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc_id, text) of files of records `.I <id>`, `.W`, lines of tokens. A record is a row from the start, so order doesn't matter."""
    raw = spark.read.option("lineSep", ".I ").text(list(paths)).where(r"value rlike '^\\s*[0-9]+\\s'")
    return raw.select(F.regexp_extract("value", r"^\s*([0-9]+)", 1).cast("long").alias("doc_id"), F.regexp_extract("value", r"(?s)^\s*[0-9]+\s+\.W\s*(.*)$", 1).alias("text"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word, n) of words between white space."""
    words = F.explode(F.array_remove(F.split(F.trim(text_col), r"\s+"), ""))
    return docs.select(F.col(id_col).alias("doc_id"), words.alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, name: str = "word") -> DataFrame:
    """(name, idx): the sorted distinct words with their places from 0."""
    from margrave.dataset import numbered

    return numbered(counts.select(name).distinct(), name, name="idx").withColumn("idx", F.col("idx") - 1)


def widened(docs: DataFrame, long: DataFrame, name: str, values: list[str], value: str | None) -> DataFrame:
    """A column for each of values: the sum of `value`, or 1 for presence; 0 where a document has none."""
    cell = F.sum(value) if value else F.lit(1)
    wide = long.groupBy("doc_id").pivot(name, values).agg(cell if value else F.max(cell))
    return docs.select("doc_id").join(wide, "doc_id", "left").fillna(0).select("doc_id", *[F.col(f"`{v}`").cast("int").alias(v) for v in values])


class DocTermSource:
    """A corpus as documents x words (features) and documents x topics (objectives).

    docs: (doc_id, text); topics: (topic, doc_id); industries: (industry, doc_id). feature_type: 'wordcount' or 'binary'.
    filters: {} or {'industry': code}. Topics of documents that aren't loaded are dropped."""

    def __init__(self, docs: DataFrame, topics: DataFrame, industries: DataFrame | None = None):
        self.docs, self.topics, self.industries = docs, topics, industries

    def long(self, filters: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(documents, words, topics) of the chosen documents, zeros left out: the form for any number of words."""
        filters = dict(filters or {})
        if set(filters) - {"industry"}:
            raise ValueError(f"unsupported filters: {sorted(filters)}")
        docs = self.docs
        if filters:
            docs = docs.join(ids_in_industry(self.industries, filters["industry"]).distinct(), "doc_id", "left_semi")
        return docs, word_counts(docs), self.topics.join(docs.select("doc_id"), "doc_id", "left_semi").distinct()

    def create(self, label: str = "corpus", feature_type: str = "wordcount", filters: Mapping[str, str] | None = None) -> Dataset:
        if feature_type not in ("wordcount", "binary"):
            raise ValueError(f"unknown feature type {feature_type!r}")
        docs, words, topics = self.long(filters)
        lists = [[r[0] for r in t.select(c).distinct().orderBy(c).limit(MAX_COLUMNS + 1).collect()] for t, c in ((words, "word"), (topics, "topic"))]
        if max(map(len, lists)) > MAX_COLUMNS:
            raise ValueError(f"over {MAX_COLUMNS} columns: use long()")
        wide = widened(docs, words, "word", lists[0], "n" if feature_type == "wordcount" else None)
        own = {t: f"topic {t}" if t in lists[0] else t for t in lists[1]}
        both = wide.join(widened(docs, topics, "topic", lists[1], None).select("doc_id", *[F.col(f"`{t}`").alias(n) for t, n in own.items()]), "doc_id")
        df = both.withColumn("row_id", F.col("doc_id")).withColumn("row_label", F.col("doc_id").cast("string")).drop("doc_id").orderBy("row_id")
        return Dataset.of(df, lists[0], list(own.values()), label)
