"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both of its sides.

The network's classes are the most frequent words, and buckets of all others; a word's share of its bucket comes from the
counts of the whole corpus, which stay a table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrave.llm.common import materialize, partitions, scratch_path, total_bytes
from margrave.llm.textops import lean, mix, slices, utf8, words

#: Words of the vocabulary, then hash buckets for all others; both together are CLUSTERS * CLUSTER classes.
WORDS, BUCKETS, CLUSTERS, CLUSTER = 960, 64, 32, 32
#: Offsets of the context's tokens, hidden units, tokens of a training step, step size.
CONTEXT, HIDDEN, STEP, RATE = (-2, -1, 1, 2), 16, 8192, 0.08
#: Bytes of text of a shard, at least, and number of shards, at most; parts in which their weights are averaged.
SHARD_BYTES, MOST_SHARDS, PARTS = 8 << 20, 4095, 16
#: Added to the count of each word of a bucket, and of one never seen.
ADDED = 0.5
_V = WORDS + BUCKETS


@dataclass
class Network:
    """Embeddings by position (the last row: beyond the text), hidden bias, and a softmax of clusters, then of a cluster's members."""

    table: np.ndarray  # of the vocabulary: word hashes ascending
    token: np.ndarray  # and their tokens
    weights: list[np.ndarray]
    counts: DataFrame | None = None  # of all words outside the vocabulary: h (hash), n; workers don't get it
    totals: np.ndarray | None = None  # of each bucket: its words' counts and one unseen word's, each with ADDED

    def __getstate__(self):
        return self.__dict__ | {"counts": None}

    @classmethod
    def initial(cls, hashes: np.ndarray, counts: np.ndarray, others: float) -> Network:
        """Random embeddings; output biases at the unigram frequencies. Words by falling count; others: count of all further words."""
        rng = np.random.Generator(np.random.PCG64(3))
        freq = np.concatenate([counts, np.zeros(WORDS - len(counts)), np.full(BUCKETS, others / BUCKETS)]) + 0.5
        by_cluster = freq.reshape(CLUSTERS, CLUSTER)
        order = np.argsort(hashes)
        weights = [
            rng.normal(0, 0.1, (len(CONTEXT), _V + 1, HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, 0.1, (HIDDEN, CLUSTERS)),
            np.log(by_cluster.sum(1)),
            rng.normal(0, 0.1, (CLUSTERS, HIDDEN, CLUSTER)),
            np.log(by_cluster),
        ]
        return cls(hashes[order], order.astype(np.int64), [w.astype(np.float32) for w in weights])

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        other = WORDS + (hashes % np.uint64(BUCKETS)).astype(np.int64)
        if not len(self.table):
            return other
        at = np.minimum(np.searchsorted(self.table, hashes), len(self.table) - 1)
        return np.where(self.table[at] == hashes, self.token[at], other)

    def contexts(self, token: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Tokens at the context's offsets of each token, a column each."""
        out = np.full((len(token), len(CONTEXT)), _V, np.int64)
        for c, o in enumerate(CONTEXT):
            if len(token) > abs(o):
                here, there = (slice(None, -o), slice(o, None)) if o > 0 else (slice(-o, None), slice(None, o))
                same = doc[here] == doc[there]
                out[here, c] = np.where(same, token[there], _V)
        return out

    def _forward(self, token: np.ndarray, context: np.ndarray):
        e, b, wc, bc, ww, bw = self.weights
        h = np.tanh(sum(e[c][context[:, c]] for c in range(len(CONTEXT))) + b)
        cluster, member = token // CLUSTER, token % CLUSTER
        pc = _softmax(h @ wc + bc)
        by = np.argsort(cluster.astype(np.uint8), kind="stable")
        edge = np.searchsorted(cluster[by], np.arange(CLUSTERS + 1))
        hs, pw = h[by], np.empty((len(token), CLUSTER), np.float32)
        for k in range(CLUSTERS):
            i, j = edge[k], edge[k + 1]
            if j > i:
                pw[i:j] = _softmax(hs[i:j] @ ww[k] + bw[k])
        rows = np.arange(len(token))
        logp = np.log(pc[rows, cluster] + 1e-30)
        logp[by] += np.log(pw[rows, member[by]] + 1e-30)
        return h, cluster, member, pc, by, edge, hs, pw, rows, logp

    def log_probabilities(self, token: np.ndarray, doc: np.ndarray) -> np.ndarray:
        context, out = self.contexts(token, doc), np.empty(len(token))
        for lo in range(0, len(token), STEP):
            out[lo : lo + STEP] = self._forward(token[lo : lo + STEP], context[lo : lo + STEP])[-1]
        return out

    def step(self, token: np.ndarray, context: np.ndarray, history: list[np.ndarray]) -> None:
        """One Adagrad step on the mean negative log-probability."""
        h, cluster, member, pc, by, edge, hs, pw, rows, _ = self._forward(token, context)
        e, b, wc, bc, ww, bw = self.weights
        n = np.float32(len(token))
        pc[rows, cluster] -= 1
        pw[rows, member[by]] -= 1
        pc /= n
        pw /= n
        g_ww, g_bw, back = np.zeros_like(ww), np.zeros_like(bw), np.empty_like(hs)
        for k in range(CLUSTERS):
            i, j = edge[k], edge[k + 1]
            if j > i:
                g_ww[k], g_bw[k], back[i:j] = hs[i:j].T @ pw[i:j], pw[i:j].sum(0), pw[i:j] @ ww[k].T
        d = pc @ wc.T
        d[by] += back
        d *= 1 - h * h
        g_e = np.zeros_like(e)
        for c in range(len(CONTEXT)):
            order = np.argsort(context[:, c].astype(np.uint16), kind="stable")
            seen = context[order, c]
            first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
            g_e[c, seen[first]] = np.add.reduceat(d[order], first)
        for w, g, past in zip(self.weights, [g_e, d.sum(0), h.T @ pc, pc.sum(0), g_ww, g_bw], history, strict=True):
            past += g * g
            w -= RATE * g / (np.sqrt(past) + 1e-6)

    def flat(self) -> np.ndarray:
        return np.concatenate([w.reshape(-1) for w in self.weights])

    def shaped(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for w in self.weights:
            out.append(flat[at : at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size
        return out

    def replaced(self, flat: np.ndarray) -> Network:
        return Network(self.table, self.token, self.shaped(flat), self.counts, self.totals)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    x /= x.sum(1, keepdims=True)
    return x


def _words(batch: pa.RecordBatch):
    data, offsets = utf8(batch["text"])
    for lo, hi in slices(offsets):
        yield lo, hi, words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)


def _bucket(h: str):
    return F.col(h).bitwiseAND(F.lit(BUCKETS - 1))


class Learner:
    """Walks over the tokens of one shard in steps of STEP, wherever batches end."""

    def __init__(self, net: Network, history: np.ndarray):
        self.net, self.history, self.seen = net.replaced(net.flat()), net.shaped(history), 0
        self.token, self.context = [], []

    def take(self, token: np.ndarray, doc: np.ndarray) -> None:
        self.token.append(token)
        self.context.append(self.net.contexts(token, doc))
        if sum(map(len, self.token)) >= STEP:
            self._walk(STEP)

    def _walk(self, least: int) -> None:
        token, context = np.concatenate(self.token), np.concatenate(self.context)
        lo = 0
        while len(token) - lo >= least:
            self.net.step(token[lo : lo + STEP], context[lo : lo + STEP], self.history)
            lo += min(STEP, len(token) - lo)
        self.seen += lo
        self.token, self.context = [token[lo:]], [context[lo:]]

    def parts(self) -> list[bytes]:
        """Weights and history after all tokens."""
        if sum(map(len, self.token)):
            self._walk(1)
        both = np.concatenate([self.net.flat(), *[h.reshape(-1) for h in self.history]])
        return [p.astype("<f4").tobytes() for p in np.array_split(both, PARTS)]


def waves(shards: int) -> list[tuple[int, int]]:
    """Ranges of shard numbers: 1, 2, 4, ... shards, until all are dealt."""
    out, lo = [], 0
    while lo < shards:
        out.append((lo, min(shards, 2 * lo + 1)))
        lo = out[-1][1]
    return out


def train(docs: DataFrame, text_col: str = "text", rounds: int = 1, id_col: str = "doc_id") -> Network:
    """Fit the network to every token of every document, `rounds` times.

    Words are counted over the corpus; the WORDS most frequent are the vocabulary, the counts of all others stay a
    table that grows with the corpus (Network.counts). Documents are dealt to shards of SHARD_BYTES or more by a hash of
    id and text, and shards to waves of 1, 2, 4, ... of them. The shards of a wave all start from the same weights and
    step sizes, which the waves before it learnt, walk over their own tokens in a fixed order, and are averaged by
    their numbers of tokens: the first wave finds the way, and later ones widen the data. So the network is
    synchronised as often as the logarithm of the corpus, and is the same on any partitioning. Tokens are written once,
    two bytes each, and streamed: a shard needs no memory of its size. The driver holds one network and its step sizes
    (about 0.8 MB) and the buckets' totals; an averaging task holds 50 kB of each of MOST_SHARDS / 2 shards at most.

    Rows of one id and one text share a shard."""
    own = docs.select(F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *[w.hash for *_, w in _words(b)]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counts = materialize(own.mapInArrow(lean(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word-counts")
    top = counts.orderBy(F.desc("n"), "h").limit(WORDS).toArrow()
    hashes, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by = np.lexsort((hashes, -n))
    every = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    net = Network.initial(hashes[by], n[by], float(every - n.sum()))
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(pa.table({"h": top["h"]})))
    net.counts = materialize(counts.join(known, "h", "left_anti"), "other-words")
    net.totals = np.full(BUCKETS, ADDED)
    for b, count_of, kinds in net.counts.groupBy(_bucket("h")).agg(F.sum("n"), F.count("*")).collect():  # BUCKETS rows
        net.totals[b] += count_of + ADDED * kinds
    if not every or not rounds:
        return net
    shards = max(1, min(MOST_SHARDS, -(-total_bytes(docs, text_col) // SHARD_BYTES)))
    dealt = waves(shards)
    given = spark.sparkContext.broadcast(net)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in _words(b):
                token = given.value.tokens(w.hash).astype("<u2")
                at = np.concatenate([[0], np.cumsum(w.counts())]) * 2
                tokens = pa.Array.from_buffers(pa.large_binary(), w.docs, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(token)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b["shard"][lo:hi], b["k"][lo:hi], tokens], ["shard", "k", "tokens"])

    key = F.xxhash64(F.col(id_col), F.col(text_col))
    keyed = docs.select(F.pmod(F.xxhash64(F.lit(8), F.col(id_col), F.col(text_col)), F.lit(shards)).cast("int").alias("shard"), key.alias("k"), F.col(text_col).alias("text"))
    tokens = keyed.where("text is not null").mapInArrow(lean(tokenize), "shard int, k long, tokens binary")
    wave = F.lit(0)
    for i, (lo, _) in enumerate(dealt):
        wave = F.when(F.col("shard") >= lo, i).otherwise(wave)
    path = scratch_path(spark, "tokens")
    tokens.repartition(partitions(spark), "shard").withColumn("wave", wave).write.partitionBy("wave").parquet(path)  # a shard is in one file
    tokens = spark.read.schema("shard int, k long, tokens binary, wave int").parquet(path)
    history = np.full(net.flat().size, 1e-6, np.float32)
    for i in [*range(len(dealt))] * rounds:
        net, history = _wave(tokens.where(F.col("wave") == i).drop("wave"), net, history)
    return net


def _wave(tokens: DataFrame, net: Network, history: np.ndarray) -> tuple[Network, np.ndarray]:
    """The averages of the shards' networks and step sizes (see train)."""
    start = tokens.sparkSession.sparkContext.broadcast((net, history))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = None, None

        def done() -> pa.RecordBatch:
            columns = [pa.array(range(PARTS), pa.int32()), pa.array([shard] * PARTS, pa.int32()), pa.array(own.parts(), pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([own.seen] * PARTS, pa.int64())], ["part", "shard", "w", "n"])

        for b in batches:
            number = b["shard"].to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if b.num_rows else []
            for lo, hi in zip(edge, edge[1:]):
                if number[lo] != shard:
                    if own:
                        yield done()
                    shard, own = int(number[lo]), Learner(*start.value)
                for i in range(lo, hi, 64):
                    part = b["tokens"][i : min(i + 64, hi)].to_pylist()
                    doc = np.repeat(np.arange(len(part)), [len(t) // 2 for t in part])
                    own.take(np.frombuffer(b"".join(part), "<u2").astype(np.int64), doc)
        if own:
            yield done()

    def average(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["shard"].to_pylist(), t["n"].to_pylist(), t["w"].to_pylist(), strict=True))
        total = max(1, sum(n for _, n, _ in rows))
        mean = sum(np.frombuffer(w, "<f4").astype(float) * (n / total) for _, n, w in rows)
        return pa.table({"part": t["part"][:1], "w": pa.array([mean.astype("<f4").tobytes()], pa.binary())})

    own = tokens.where(F.octet_length("tokens") > 0).repartition(partitions(tokens.sparkSession), "shard").sortWithinPartitions("shard", "k")
    learnt = own.mapInArrow(lean(learn), "part int, shard int, w binary, n long").groupBy("part").applyInArrow(average, "part int, w binary").toArrow().sort_by("part")
    if not learnt.num_rows:
        return net, history
    both = np.concatenate([np.frombuffer(w, "<f4") for w in learnt["w"].to_pylist()])
    return net.replaced(both[: len(history)]), both[len(history) :]


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens of ln P(token | both sides)) and per_token (their mean).

    P of a word of the vocabulary is the network's; of any other word it is the network's P of its bucket times the
    word's share of the bucket: (n + ADDED) / total, n from the whole corpus's counts, 0 if the word isn't there. A
    document's other words meet the counts in a join by hash, a row each.

    Null and empty texts have no tokens, log_likelihood 0 and a null per_token. Ids may be null or repeat; extra
    columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    fields = ["row", "doc_id", "n_tokens", "p", "h", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in _words(b):
                token, row = model.value.tokens(w.hash), b["row"][lo:hi]
                p = model.value.log_probabilities(token, w.doc)
                n, total = w.counts(), np.bincount(w.doc, p, minlength=w.docs)
                none, anywhere = pa.nulls(w.docs, pa.int64()), mix(row.to_numpy().astype(np.uint64)).view(np.int64)  # what these rows meet in the join is of no account
                yield pa.RecordBatch.from_arrays([row, b["doc_id"][lo:hi], pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(anywhere), none], fields)
                other = np.flatnonzero(token >= WORDS)
                if len(other):
                    doc, h = w.doc[other], w.hash[other]
                    by = np.lexsort((h, doc))
                    doc, h = doc[by], h[by]
                    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
                    none = pa.nulls(len(first), pa.int64())
                    times = np.diff(np.append(first, len(h)))
                    yield pa.RecordBatch.from_arrays([row.take(pa.array(doc[first])), none, none, none.cast(pa.float64()), pa.array(h[first].view(np.int64)), pa.array(times, pa.int64())], fields)

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = own.mapInArrow(lean(run), "row long, doc_id long, n_tokens long, p double, h long, times long")
    # the counts, whose keys are unique hashes, are the side to build: even parts of them on any corpus
    met = parts.join(net.counts.withColumnRenamed("n", "seen").hint("shuffle_hash"), "h", "left")
    total = F.array(*[F.lit(float(t)) for t in net.totals])[_bucket("h").cast("int")]
    share = F.ln((F.coalesce("seen", F.lit(0)) + ADDED) / total)
    sums = met.select("row", "doc_id", "n_tokens", F.coalesce("p", F.col("times") * share).alias("p")).groupBy("row")
    out = sums.agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("p").alias("log_likelihood"))
    return out.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("per_token"))
