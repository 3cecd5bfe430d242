"""Document quality by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from margrave.llm.textops import SLICE, lean, slices, utf8, words

#: Hashed features: words, and triples of character kinds.
WORD_BINS, SHAPE_BINS = 1024, 1024
#: Further features: share of words equal to the word before; and the weight it gets, as of so many log counts. Junk
#: that stammers has the words of good text, which hashed bins alone don't tell apart.
REPEAT_BINS, REPEAT_SCALE = 1, 20
_BINS = WORD_BINS + SHAPE_BINS + REPEAT_BINS
#: Labelled documents in the vote, at most; latent dimensions; neighbours that vote; power of a similarity that is its weight.
MAX_LABELLED, DIMENSIONS, NEIGHBOURS, SHARPNESS = 4096, 64, 15, 8
#: Similarities that differ by no more are ties: single precision leaves less between copies of one text.
TIE = 1e-6
#: Documents in a block of cosine products.
BLOCK = 512

_KIND = np.full(256, 3, np.int64)
_KIND[128:] = 4  # of a character beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
for _i, _c in enumerate(b" \n\t.,;:!?'\"-_|#$%&*@()[]{}<>/\\=+"):
    _KIND[_c] = 5 + _i
_KINDS = int(_KIND.max()) + 1
_SHAPE_BIN = np.random.Generator(np.random.PCG64(7)).permutation(_KINDS**3) % SHAPE_BINS


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log counts of hashed words and of triples of character kinds, and the share of repeated words, a row a text."""
    n, bins = len(offsets) - 1, _BINS
    w = words(data, offsets, lower=True)
    at = [w.doc * bins + (w.hash % np.uint64(WORD_BINS)).astype(np.int64)]
    if len(data) > 2:
        kind, doc = _KIND[data], np.repeat(np.arange(n), np.diff(offsets))
        inside = doc[2:] == doc[:-2]
        code = _SHAPE_BIN[(kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:]]
        at.append((doc[:-2] * bins + WORD_BINS + code)[inside])
    out = np.log1p(np.bincount(np.concatenate(at), minlength=n * bins).reshape(n, bins)).astype(np.float32)
    again = np.bincount(w.doc[1:][(w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n)
    out[:, -1] = REPEAT_SCALE * again / np.maximum(w.counts(), 1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Voters:
    """The model: feature weights, latent axes, and the labelled documents' latent unit vectors with their labels."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Voters:
        """Inverse document frequency weights, then a truncated SVD by randomised subspace iteration."""
        weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        x = _unit(counts * weight)
        k = min(dimensions, *x.shape)
        q = np.random.Generator(np.random.PCG64(11)).standard_normal((x.shape[1], min(k + 8, x.shape[1]))).astype(np.float32)
        for _ in range(5):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        axes = (q @ v.T[:, :k]).astype(np.float32)
        return cls(weight, axes, _unit(x @ axes), labels.astype(np.float32))

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The labels of the NEIGHBOURS most similar voters and of all that tie with the last of these, weighted by similarity.

        A document like none of them gets the mean label."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = _unit(_unit(counts * self.weight) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        last = np.partition(near, -k, axis=1)[:, -k]
        doc, voter = np.nonzero(near >= last[:, None] - TIE)
        weight = np.maximum(near[doc, voter], 0).astype(float) ** SHARPNESS
        total, prior = np.bincount(doc, weight, minlength=len(counts)), float(self.labels.mean())
        vote = np.bincount(doc, weight * self.labels[voter], minlength=len(counts))
        return np.clip(np.where(total > 1e-12, vote / np.maximum(total, 1e-12), prior), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Documents that no label is learnt from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Voters:
    """Voters from at most max_labelled labelled documents that aren't held out, those whose hashed ids come first.

    The bound keeps what the driver gets at a row of _BINS half floats for each of max_labelled ids, and what is broadcast
    at max_labelled * (DIMENSIONS + 1) floats. Labels that are null, or of null ids, are left out; of several labels for
    an id the smallest counts, and of several rows of an id the one whose text is smallest (null: empty)."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b["text"])
            for lo, hi in slices(offsets, SLICE, BLOCK):
                x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b["doc_id"][lo:hi], b["label"][lo:hi], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    rows = labelled.mapInArrow(lean(describe), "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float16).reshape(rows.num_rows, _BINS).astype(np.float32)
    y = rows["label"].to_numpy()
    return Voters.fit(x, y) if len(y) else Voters(np.ones(x.shape[1], np.float32), np.zeros((x.shape[1], 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))


def score_quality(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`: the score from 0 to 1, higher the likelier label 1, of every whole text.

    Null and empty texts are like no voter and get the voters' mean label. All rows and columns stay; a column
    named as `out` is replaced."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    model = docs.sparkSession.sparkContext.broadcast(voters)
    docs = docs.drop(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b[text_col])
            for lo, hi in slices(offsets, SLICE, BLOCK):
                s = model.value.score(features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(s, pa.float64())], [*b.schema.names, out])

    return docs.mapInArrow(lean(score), StructType([*docs.schema.fields, StructField(out, DoubleType())]))
