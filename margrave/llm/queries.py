"""The registered queries of the corpus operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margrave.llm.bpe import bpe_decode, bpe_encode
from margrave.llm.common import scratch_path, ship
from margrave.llm.cross_polytope import nearest
from margrave.llm.decontaminate import decontaminate
from margrave.llm import pseudo_likelihood
from margrave.llm.line_dedup import line_dedup
from margrave.llm.ngram_join import ngram_join
from margrave.llm.quality_knn import fit_quality, held_out, score_quality
from margrave.llm.secrets import find_secrets, written
from margrave.llm.substring_dedup import substring_dedup
from margrave.llm.token_orc import token_index, write_token_orc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


def _digits(ids: str):
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe_decode(bpe_encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _digits("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_token_orc(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_index(spark, path)


#: A document of at least this score counts as of good quality.
GOOD = 0.7


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    voters = fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), voters)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=2)
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pseudo_likelihood.score(docs, pseudo_likelihood.train(docs))


QUERIES = {
    "op1_pseudo_likelihood": op1_pseudo_likelihood,
    "op5_line_dedup": op5_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op6_cross_polytope": op6_cross_polytope,
    "op7_quality_knn": op7_quality_knn,
    "op4_token_orc": op4_token_orc,
    "op8_byte_level_bpe": op8_byte_level_bpe,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup,
}

ORACLES = {
    "op5_line_dedup": r"""
WITH l AS (
  SELECT doc_id, p, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS ink
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
n AS (SELECT doc_id, p, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM l WHERE ink),
win AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS line2 FROM n),
firsts AS (SELECT line, line2, min((doc_id, i)) AS f FROM win WHERE line2 IS NOT NULL GROUP BY ALL),
hit AS (SELECT doc_id, i FROM win JOIN firsts USING (line, line2) WHERE f < (doc_id, i)),
gone AS (SELECT doc_id, i FROM hit UNION SELECT doc_id, i + 1 FROM hit),
kept AS (
  SELECT l.doc_id, l.p, l.line, l.ink, g.i IS NOT NULL AS gone
  FROM l LEFT JOIN n USING (doc_id, p) LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i)
SELECT d.doc_id, coalesce(count(*) FILTER (ink), 0) AS n_lines, coalesce(count(*) FILTER (k.gone), 0) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT k.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) GROUP BY d.doc_id
""",
    "op9_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS s FROM (
    SELECT item_id, list_slice(ws, i, i + 7) AS x FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS i FROM b WHERE len(ws) > 0))),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT spot.doc_id, spot.i, spot.n, win.item_id FROM spot JOIN win USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
""",
    "op2_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
least AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least USING (s) WHERE least.d < win.doc_id),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: js IS NULL OR NOT list_contains(js, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
""",
}
