"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its NEAREST reference points in order of distance, which are drawn from the data. Inverted lists
hold, under every pair of pivots, the vectors that have both among their nearest; vectors that meet there share two
pivots at least. Each pair is looked at in one list only, that of its two smallest shared pivots, counts `shared` or
more pivots in common there, and is verified by its cosine in double precision. No pairs are emitted: a task returns
how many links each vector has, and a star of links per component.

Equal vectors are one class from the start and link with each other; a class is one entry of the lists. A list longer
than LIST is cut into blocks of some LIST entries, and every two of its blocks are a task's group, so that no group is
unbounded and no pair is left out.

The reference points grow with the vectors, one for every PER distinct ones from PIVOTS on, so that lists stay as long as they are;
their number is bounded by MOST and by BYTES. They are picked from a sample of SAMPLE times as many distinct vectors, by hash, well
apart from each other; everything else covers every row.
What the index misses is a parameter's choice: tests and README give the recall measured against brute force.

Defined results: null, zero, empty vectors and those with null or non-finite components link with nothing, nor do rows with
a null label; vectors of different lengths have no cosine and don't link; rows that repeat an id are counted as rows, and a null
id is never a component's id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, connected_components, materialize, min_labels

NEAREST, SHARED, LIST = 6, 2, 4096
#: Reference points at least, distinct vectors for each of more, reference points at most, and bytes of them at most.
PIVOTS, PER, MOST, BYTES = 512, 20, 16_384, 64 << 20
#: Vectors that pivots are picked from, for each, and the cosine from which two are too close to be both picked.
SAMPLE, APART = 4, 0.9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def separated(x: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """Unit vectors, in order, that are no closer than the cosine to one taken before; at most so many. In a dense region more
    of them would order each other's neighbourhood finer than the links that are looked for."""
    x = _unit(x)
    taken, n = np.empty((min(most, len(x)), x.shape[1])), 0
    for at in range(0, len(x), 256):
        some, before = x[at : at + 256], n
        far = (some @ taken[:n].T).max(axis=1, initial=-2.0) < cosine
        for v in some[far]:
            if n == most:
                return taken
            if (taken[before:n] @ v).max(initial=-2.0) < cosine:
                taken[n], n = v, n + 1
    return taken[:n]


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k pivots of the largest cosine, nearest first, smaller number first on ties.

    Single precision finds a few more than k; double precision orders them."""
    out, small, more = np.empty((len(x), k), np.int64), pivots.astype(np.float32), min(len(pivots), k + 10)
    for at in range(0, len(x), 256):  # a bounded part of the matrix at once
        unit = _unit(x[at : at + 256])
        far = unit.astype(np.float32) @ small.T
        few = np.sort(np.argpartition(far, len(pivots) - more, axis=1)[:, len(pivots) - more :], axis=1) if len(pivots) > more else np.tile(np.arange(more), (len(far), 1))
        cosine = -np.round(np.einsum("ij,ikj->ik", unit, pivots[few]), 12)
        out[at : at + 256] = np.take_along_axis(few, np.argsort(cosine, axis=1, kind="stable")[:, :k], axis=1)
    return out


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as they are, in single precision where that loses nothing."""
    small = (x.astype(np.float32) == x).all(axis=1)
    return [b"f" + r.astype("<f4").tobytes() if f else b"d" + r.astype("<f8").tobytes() for r, f in zip(x, small)]


def unpack(blobs: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f4" if b[:1] == b"f" else "<f8", offset=1).astype(np.float64) for b in blobs])


def _links(vec: np.ndarray, perm: np.ndarray, block: np.ndarray | None, pair: tuple[int, int], shared: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of one list: verified pairs whose two smallest shared pivots are the list's (and of two blocks, if given)."""
    for at in range(0, len(vec), 512):
        near = vec[at : at + 512] @ vec[at:].T >= cosine
        i, j = np.nonzero(near)
        i, j = i[j > i] + at, j[j > i] + at
        if block is not None:
            i, j = i[block[i] != block[j]], j[block[i] != block[j]]
        if not len(i):
            continue
        both = (perm[i][:, :, None] == perm[j][:, None, :]).any(axis=2)
        names = np.sort(np.where(both, perm[i], 1 << 30), axis=1)
        ok = (both.sum(axis=1) >= shared) & (names[:, 0] == pair[0]) & (names[:, 1] == pair[1])
        yield i[ok], j[ok]


def _search(batches: Iterator[pa.RecordBatch], shared: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows (label, size, a, b, block 1, block 2, own block, node, n, perm, vec) sorted by the first six → (node, near, root)."""

    def work(rows: list[tuple]) -> pa.RecordBatch | None:
        node, n = np.array([r[7] for r in rows]), np.array([r[8] for r in rows])
        vec, perm = _unit(unpack([r[10] for r in rows])), np.array([r[9] for r in rows])
        block = np.array([r[6] for r in rows]) if rows[0][4] != rows[0][5] else None
        near, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for i, j in _links(vec, perm, block, rows[0][2:4], shared, cosine):
            np.add.at(near, i, n[j])
            np.add.at(near, j, n[i])
            up = np.flatnonzero(label != np.arange(len(rows)))
            label = min_labels(len(rows), np.concatenate([i, up]), np.concatenate([j, label[up]]))
        some = np.flatnonzero(near)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(near[some]), pa.array(node[label[some]])], names=["node", "near", "root"]) if len(some) else None

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(11))):
            if held and held[0][:6] != row[:6]:
                if len(held) > 1 and (out := work(held)):
                    yield out
                held = []
            held.append(row)
    if len(held) > 1 and (out := work(held)):
        yield out


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, pivots: int | None = None, nearest_k: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.col("v").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    canonical = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = materialize(rows.select("id", F.when(usable, F.sha2(F.concat_ws("|", F.length("label"), "label", F.array_join(canonical, ",")), 256)).alias("same"), F.when(usable, canonical).alias("v"), "label"))
    classes = rows.where("same is not null").groupBy("same", "label").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least"))
    # the node's number is 63 bits of the digest: two classes in one would take some 2^31 classes
    classes = materialize(classes.withColumn("node", F.shiftrightunsigned(F.conv(F.substring("same", 1, 16), 16, -10).cast("long"), 1)))
    if pivots is None:
        count, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
        pivots = max(nearest_k, min(max(PIVOTS, count // PER), MOST, BYTES // (8 * width)))
    sample = classes.orderBy("same").limit(SAMPLE * pivots).select("v").toArrow().column("v").combine_chunks()
    sizes = sample.value_lengths().to_numpy(zero_copy_only=False) if len(sample) else np.zeros(0, int)
    table = {int(d): separated(sample.filter(pa.array(sizes == d)).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d)), pivots, APART) for d in np.unique(sizes)}
    told = spark.sparkContext.broadcast(table)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3).to_pylist()
            perms, packed = [[]] * len(vectors), [b""] * len(vectors)
            for d in sorted({len(v) for v in vectors}):
                at = [i for i, v in enumerate(vectors) if len(v) == d]
                x = np.array([vectors[i] for i in at], np.float64)
                p = told.value.get(d, np.zeros((0, d)))
                # too few pivots of this length to tell vectors apart: one list for all of them
                perm = nearest(x, p, nearest_k) if len(p) >= nearest_k and p.shape[1] == d else np.tile(np.arange(max(2, shared)), (len(at), 1))
                for i, q, blob in zip(at, perm.tolist(), pack(x)):
                    perms[i], packed[i] = q, blob
            arrays = [batch.column(i) for i in range(3)] + [pa.array([len(v) for v in vectors], pa.int32()), pa.array(perms, pa.list_(pa.int32())), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "label", "n", "size", "perm", "vec"])

    entries = classes.select("node", "label", "n", "v").mapInArrow(described, "node long, label string, n long, size int, perm array<int>, vec binary")
    entries = materialize(entries.withColumn("p", F.sort_array("perm")))
    pairs = F.array(*(F.struct(F.get("p", F.lit(i)).alias("a"), F.get("p", F.lit(j)).alias("b")) for i, j in combinations(range(max(nearest_k, shared)), 2)))
    lists = entries.withColumn("k", F.explode(F.filter(pairs, lambda k: k["b"].isNotNull()))).withColumn("a", F.col("k.a")).withColumn("b", F.col("k.b"))
    keys = ["label", "size", "a", "b"]
    long = checkpoint(lists.groupBy(keys).agg(F.count("*").alias("c")).where(F.col("c") > LIST).select(*keys, F.ceil(F.col("c") / LIST).alias("blocks")))
    many = long.count()
    if many:
        lists = lists.join(F.broadcast(long) if many <= 10_000 else long, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        lists = lists.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    else:
        lists = lists.withColumn("own", F.lit(0)).withColumn("other", F.lit(0))
    keys += ["b1", "b2"]
    lists = lists.select("label", "size", "a", "b", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "node", "n", "perm", "vec")
    met = checkpoint(lists.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _search(it, shared, cosine), "node long, near long, root long"))
    near = met.groupBy("node").agg(F.sum("near").alias("near"))
    component = connected_components(met.where("node <> root").select("node", "root"))
    named = classes.select("same", "node", "n", "least").join(near, "node", "left").join(component.select(F.col("v").alias("node"), "m"), "node", "left")
    named = named.withColumn("m", F.coalesce("m", "node"))
    least = named.groupBy("m").agg(F.min("least").alias("component"))
    classes = named.join(least, "m").select("same", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"), "component")
    out = rows.select("id", "same").join(classes, "same", "left")
    component_id = F.coalesce("component", "id")
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))


def op10_embeddings(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read

    return near_duplicates(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: All pairs of a label, in double precision, and the smallest id reachable by links.
SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
    where label is not null and embedding is not null and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as n from v where len(e) > 0),
p as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.n > 0 and b.n > 0 and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r as (select vec_id as a, vec_id as m from embeddings union select p.b, r.m from r join p on p.a = r.a),
c as (select a, min(m) as component_id from r group by a),
l as (select a, count(*) as n from p group by a)
select c.a as vec_id, coalesce(l.n, 0)::bigint as n_links, component_id, c.a = component_id as kept from c left join l on c.a = l.a"""
