"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Word vectors: every token (a run of letters and digits, or of other signs) falls into one of BUCKETS hashed buckets,
each with a fixed sparse random index vector. Over all documents, a bucket's row sums the index vectors of the two
tokens on either side. The sums are integers, so their order doesn't matter; the table's size doesn't depend on the
corpus. A document's features pool its tokens' frequency-weighted vectors, their squares, and their
products with the next two tokens' vectors.

The network (one hidden layer, numpy) is fitted on the driver from at most `sample` labelled rows, chosen by the hash
of the id; a part of them is kept out of the fitting and sets the temperature that calibrates the probabilities.

Defined results: null or blank text has all-zero features and is scored like any other; labels that contradict each
other or are null aren't learnt from; without labels of both kinds every score is the share of label 1 (0.5 without
any); a null id is never held out; an empty table gives an empty result; rows that repeat are scored alike; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64, partitions, text_bytes

BUCKETS, DIM, NONZERO, NEAR = 1 << 15, 32, 4, (1, 2)
BLOCK = 512
#: Weight of nothing in every pool.
PRIOR = 3.0
PIECE = 1 << 18
_P = 0x9E3779B97F4A7C15
_cache: dict = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _cache:
        n = 2 * PIECE + 1
        inverse = pow(_P, -1, 1 << 64)
        _cache["p"] = tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, q, np.uint64))]) for q in (_P, inverse))
    return _cache["p"]


#: 0: white space and control, 1: letters, digits and all bytes of longer characters, 2: the rest.
KIND = np.array([0 if c <= 32 or c == 127 else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of each bucket's NONZERO entries."""
    if "r" not in _cache:
        h = mix64(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(0x51ED27)).reshape(BUCKETS, NONZERO)
        _cache["r"] = ((h >> np.uint64(8)) % np.uint64(DIM)).astype(np.int64), np.where(h & np.uint64(1), 1, -1).astype(np.int64)
    return _cache["r"]


def tokens(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, index of the text) of the tokens, over pieces of bounded size; a longer text is cut at a blank."""
    power, inverse = _powers()

    def work(parts: list[bytes], owner: list[int]) -> tuple[np.ndarray, np.ndarray]:
        a = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        kind = KIND[a]
        edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        stop = np.concatenate([edge[1:], [len(a)]])
        use = kind[edge] > 0
        start, stop = edge[use], stop[use]
        total = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)])])
        h = (total[stop] - total[start]) * inverse[start]
        ends = np.cumsum([len(p) + 1 for p in parts])
        return (mix64(h) >> np.uint64(49)).astype(np.int64), np.asarray(owner)[np.searchsorted(ends, start, side="right")]

    held, owner, total = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > PIECE:
                blank = text.rfind(b" ", at + 1, at + PIECE)
                stop = blank if blank > 0 else at + PIECE
            held.append(text[at:stop])
            owner.append(i)
            total += stop - at + 1
            at = stop
            if total >= PIECE:
                yield work(held, owner)
                held, owner, total = [], [], 0
    if held:
        yield work(held, owner)


def _contexts(batches: Iterator[pa.RecordBatch], salts: int) -> Iterator[pa.RecordBatch]:
    """One task's sums, by block of buckets: DIM columns of contexts and one of counts."""
    place, sign = index_vectors()
    table = np.zeros((BUCKETS, DIM + 1), np.int64)
    flat, seen = table.reshape(-1), 0
    for batch in batches:
        for b, doc in tokens(text_bytes(batch.column(0))):
            table[:, DIM] += np.bincount(b, minlength=BUCKETS)
            for k in NEAR:
                same = doc[k:] == doc[:-k]
                x, y = b[:-k][same], b[k:][same]
                for i in range(NONZERO):
                    np.add.at(flat, x * (DIM + 1) + place[y, i], sign[y, i])
                    np.add.at(flat, y * (DIM + 1) + place[x, i], sign[x, i])
            seen += len(b)
    if seen:
        from pyspark import TaskContext

        task = TaskContext.get()
        yield _rows({i: table[i * BLOCK : (i + 1) * BLOCK] for i in range(BUCKETS // BLOCK)}, (task.partitionId() if task else 0) % salts)


def _rows(blocks: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(blocks), pa.int32()), pa.array([salt] * len(blocks), pa.int32()), pa.array([narrow(x) for x in blocks.values()], pa.binary())], names=["block", "salt", "sums"]
    )


def narrow(x: np.ndarray) -> bytes:
    """In 2, 4 or 8 bytes a number, as the largest needs; the first byte says which."""
    most = int(np.abs(x).max(initial=0))
    kind = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([kind]) + x.astype(f"<i{kind}").tobytes()


def wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<i{blob[0]}", offset=1).astype(np.int64).reshape(BLOCK, DIM + 1)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the rows of each (block, salt) as they stream by."""
    blocks: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, s, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
            blocks[i, s] = blocks.get((i, s), 0) + wide(blob)
    for (i, s), x in blocks.items():
        yield _rows({i: x}, s)


def word_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, 2 * DIM + 1): weighted vector, weighted square and weight of each bucket, from counts over all documents."""
    spark = docs.sparkSession
    salts = max(1, partitions(spark) // (BUCKETS // BLOCK))
    schema = "block int, salt int, sums binary"
    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda it: _contexts(it, salts), schema)
    sums = sums.repartition("block", "salt").mapInArrow(_add, schema).withColumn("salt", F.lit(0))
    sums = sums.repartition("block").mapInArrow(_add, schema)
    table = np.zeros((BUCKETS, DIM + 1), np.float64)
    for i, _, blob in sums.collect():
        table[i * BLOCK : (i + 1) * BLOCK] = wide(bytes(blob))
    count = table[:, DIM]
    unit = table[:, :DIM] / np.maximum(np.linalg.norm(table[:, :DIM], axis=1, keepdims=True), 1)
    unit[count > 0] -= unit[count > 0].mean(axis=0) if (count > 0).any() else 0
    weight = 1e-3 / (1e-3 + count / max(1.0, count.sum()))
    return np.concatenate([unit * weight[:, None], unit**2 * weight[:, None], weight[:, None]], axis=1).astype(np.float32)


def features(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """(len(texts), 4 * DIM): pooled vectors, squares, and products with the next token and the one after; zero without tokens.

    Products see what a mean can't: how alike neighbours are. Pools are divided by their weight plus PRIOR, so that a few tokens
    say less than many."""
    mean = np.zeros((len(texts), 2 * DIM + 1))
    product = np.zeros((len(texts), len(NEAR), DIM + 1))
    for b, doc in tokens(texts):
        if not len(b):
            continue
        g = table[b]
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        mean[doc[cut]] += np.add.reduceat(g, cut, axis=0)
        for i, k in enumerate(NEAR):
            if len(b) > k:
                same = doc[k:] == doc[:-k]
                both = np.concatenate([g[:-k, :DIM] * g[k:, :DIM], g[:-k, -1:] * g[k:, -1:]], axis=1)[same]
                owner = doc[:-k][same]
                if len(owner):
                    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    product[owner[cut], i] += np.add.reduceat(both, cut, axis=0)
    pools = [mean[:, :-1] / (mean[:, -1:] + PRIOR), *(product[:, i, :-1] / (product[:, i, -1:] + PRIOR) for i in range(len(NEAR)))]
    return np.concatenate(pools, axis=1)


class Network:
    """Two layers, fitted by Adam, with a temperature. scores() is deterministic given the fitted arrays."""

    def __init__(self, hidden: int = 32, epochs: int = 40, seed: int = 7):
        self.hidden, self.epochs, self.seed, self.constant = hidden, epochs, seed, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        if len(y) < 20 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        held, rest = order[: len(y) // 7], order[len(y) // 7 :]
        self.mean, self.scale = x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-6
        self.w1, self.b1 = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden)), np.zeros(self.hidden)
        self.w2, self.b2 = rng.normal(0, self.hidden**-0.5, self.hidden), 0.0
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w1, self.b1, self.w2, np.float64(self.b2))]
        step, z = 0, (x - self.mean) / self.scale
        for epoch in range(self.epochs):
            rate = 3e-3 * (1 - epoch / self.epochs) + 1e-4
            for at in np.array_split(rng.permutation(rest), max(1, len(rest) // 128)):
                a, t, step = z[at], y[at], step + 1
                h = np.tanh(a @ self.w1 + self.b1)
                g = (1 / (1 + np.exp(-(h @ self.w2 + self.b2))) - t) / len(at)
                back = np.outer(g, self.w2) * (1 - h * h)
                grads = (a.T @ back + 1e-4 * self.w1, back.sum(axis=0), h.T @ g + 1e-4 * self.w2, g.sum())
                new = []
                for p, d, m in zip((self.w1, self.b1, self.w2, self.b2), grads, moments):
                    m[0] = 0.9 * m[0] + 0.1 * d
                    m[1] = 0.999 * m[1] + 0.001 * d * d
                    new.append(p - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
                self.w1, self.b1, self.w2, self.b2 = new
        raw, t = self.logits(x[held]), y[held]
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, raw / c) - t * raw / c) for c in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


class Model:
    def __init__(self, table: np.ndarray, network: Network):
        self.table, self.network = table, network

    def column(self, spark, text: Column) -> Column:
        """The score of a text column; the table goes once to each executor (its size is fixed: 8.5 MB)."""
        told = spark.sparkContext.broadcast((self.table, self.network))

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            table, network = told.value
            return pa.array(network.scores(features(text_bytes(texts), table)))

        return score(text)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> Model:
    """Word vectors from all of docs, the network from at most `sample` labelled rows that aren't held out."""
    table = word_table(docs, text_col)
    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z").select("id", "y")
    known = known.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    told = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(text_bytes(batch.column(1)), told.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), batch.column(2)], names=["id", "x", "y"])

    got = rows.select("id", "text", F.col("y").cast("double").alias("y")).mapInArrow(run, "id long, x binary, y double").collect()
    got = sorted(got, key=lambda r: (r["id"], r["x"]))
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(len(got), (2 + len(NEAR)) * DIM)
    return Model(table, Network().fit(x, np.array([min(1.0, max(0.0, r["y"])) for r in got])))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs."""
    model = fit(docs, labels, id_col, text_col, **more)
    scored = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), model.column(docs.sparkSession, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
