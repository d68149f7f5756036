"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into B blocks. Two fingerprints that differ in at most d bits agree on at least B - d of
them, so each is listed once under every choice of B - d blocks (the key of one table), candidates meet on
equal keys, and the Hamming distance is then checked. A pair is counted in the first table only that it meets
in, so nothing has to be made distinct and no pairs are emitted: a task returns, per fingerprint, how many
others it verified, and a star of links per component.

Defined results: null or blank text has fingerprint 0 and links like any other; rows with equal fingerprints
are one class and link with each other; a null id is a row like any other but is never a component's id;
rows that repeat an id are counted as rows; an empty table gives an empty result; columns other than the id
and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, connected_components, min_labels, text_bytes

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: A key's rows beyond this many are split again by the bits that the key leaves free.
SPLIT = 8192
#: Rows that are looked at together, unless one key has more.
PIECE = 200_000


def fingerprint(text: bytes, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of all 2-word shingles of the text, A-Z lowered, repeats counted."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:])) if len(words) > 1 else words
    n = max(1, len(words) - 1)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, n).view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(h[:, i], minlength=256) @ BITS for i in range(8)])
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, fp): one row per row of docs, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(b, seed) for b in text_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def layout(distinct: int, distance: int) -> list[tuple[int, int]]:
    """(offset, width) of the blocks: more of them, hence longer keys, for more fingerprints."""
    blocks = distance + (2 if distinct < 1 << 22 else 3 if distinct < 1 << 28 else 4 if distinct < 1 << 33 else 6)
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _agree(x: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """For each xor, a column per block: do the two agree on it?"""
    return np.stack([(x >> np.uint64(o)) & np.uint64((1 << w) - 1) == 0 for o, w in blocks], axis=1)


def _owned(x: np.ndarray, table: np.ndarray, tables: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """Is this the first table that the pair meets in: do its key's blocks come first among those agreed on?"""
    agree = _agree(x, blocks)
    first = agree & (np.cumsum(agree, axis=1) <= tables[0].sum())
    return (first == tables[table]).all(axis=1)


def _close(fp: np.ndarray, end: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, xor) of the close pairs i < j < end[i], in pieces of bounded size."""
    alive, lag = np.arange(len(fp)), 1
    while True:
        alive = alive[alive + lag < end[alive]]
        if not len(alive):
            return
        x = fp[alive] ^ fp[alive + lag]
        near = np.bitwise_count(x) <= distance
        if near.any():
            i = alive[near]
            yield i, i + lag, x[near]
        lag += 1


def _split(fp: np.ndarray, free: list[tuple[int, int]], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As _close, of one large key: its free bits are cut once more, now into distance + 1 blocks of which one agrees."""
    bits = [o + i for o, w in free for i in range(w)]
    parts = [bits[round(i * len(bits) / (distance + 1)) : round((i + 1) * len(bits) / (distance + 1))] for i in range(distance + 1)]
    masks = [np.uint64(sum(1 << b for b in p)) for p in parts]
    for k, mask in enumerate(masks):
        order = np.argsort(fp & mask, kind="stable")
        key = (fp & mask)[order]
        end = np.searchsorted(key, key, side="right")
        for i, j, x in _close(fp[order], end, distance):
            mine = np.ones(len(x), bool)
            for m in masks[:k]:
                mine &= (x & m) != 0
            if mine.any():
                yield order[i[mine]], order[j[mine]], x[mine]


def _verify(batches: Iterator[pa.RecordBatch], blocks: list[tuple[int, int]], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (table, key, fp, n) sorted by table and key → (fp, near, root): rows verified near it, and a link."""
    size = len(blocks) - distance
    tables = np.zeros((0, len(blocks)), bool)
    for c in combinations(range(len(blocks)), size):
        tables = np.vstack([tables, np.isin(np.arange(len(blocks)), c)])

    def work(t: np.ndarray, key: np.ndarray, fp: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        ends = np.r_[new[1:], len(t)]
        large = ends - new > SPLIT
        end = np.repeat(np.where(large, new, ends), ends - new)
        near, links, held = np.zeros(len(t), np.int64), [], 0

        def contract() -> None:
            nonlocal links, held
            a, b = (np.concatenate(x) for x in zip(*links))
            label = min_labels(len(t), a, b)
            at = np.flatnonzero(label != np.arange(len(t)))
            links, held = [(at, label[at])], 0

        def take(i: np.ndarray, j: np.ndarray, x: np.ndarray) -> None:
            nonlocal held
            mine = _owned(x, t[i], tables, blocks)
            i, j = i[mine], j[mine]
            np.add.at(near, i, n[j])
            np.add.at(near, j, n[i])
            links.append((j, i))
            held += len(i)
            if held > 2_000_000:
                contract()

        for piece in _close(fp, end, distance):
            take(*piece)
        for a, b in zip(new[large].tolist(), ends[large].tolist()):
            free = [blocks[i] for i in np.flatnonzero(~tables[t[a]])]
            for i, j, x in _split(fp[a:b], free, distance):
                take(i + a, j + a, x)
        if links:
            contract()
            to = np.arange(len(t))
            to[links[0][0]] = links[0][1]
            some = np.flatnonzero((near > 0) | (to != np.arange(len(t))))
        else:
            to = some = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fp[some].view(np.int64)), pa.array(near[some]), pa.array(fp[to[some]].view(np.int64))], names=["fp", "near", "root"])

    held: list[tuple[np.ndarray, ...]] = []
    limit = PIECE
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()))
        if sum(len(x[0]) for x in held) < limit:
            continue
        t, key, fp, n = (np.concatenate(x) for x in zip(*held))
        last = int(np.flatnonzero((t == t[-1]) & (key == key[-1]))[0])  # this key may go on in the next batch
        if last:
            yield work(t[:last], key[:last], fp[:last], n[:last])
        limit = max(PIECE, 2 * (len(t) - last))  # a key that goes on is put together anew only when it has doubled
        held = [(t[last:], key[last:], fp[last:], n[last:])]
    if held:
        yield work(*(np.concatenate(x) for x in zip(*held)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 6, seed: int = 42) -> DataFrame:
    """(id, fp, n_near, component_id) for every row: others linked directly, smallest id reachable."""
    rows = checkpoint(fingerprints(docs, id_col, text_col, seed))
    classes = checkpoint(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    blocks = layout(classes.count(), distance)
    keys = []
    for t, c in enumerate(combinations(range(len(blocks)), len(blocks) - distance)):
        key, at = F.lit(0).cast("long"), 0
        for i in c:
            o, w = blocks[i]
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", o).bitwiseAND((1 << w) - 1), at))
            at += w
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    listed = classes.select(F.explode(F.array(*keys)).alias("k"), "fp", "n").select("k.t", "k.key", "fp", "n")
    met = listed.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(lambda it: _verify(it, blocks, distance), "fp long, near long, root long")
    met = checkpoint(met)
    near = met.groupBy("fp").agg(F.sum("near").alias("near"))
    component = connected_components(met.where("root <> fp").select("fp", "root"))
    named = classes.join(near, "fp", "left").join(component.select(F.col("v").alias("fp"), "m"), "fp", "left").withColumn("m", F.coalesce("m", "fp"))
    named = checkpoint(named)
    least = named.groupBy("m").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "m").select("fp", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), "component_id")
    return rows.join(classes, "fp").select("id", "fp", "n_near", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 6) -> DataFrame:
    """The rows of docs whose id is the smallest of their component (and those without an id), all columns kept."""
    kept = near_duplicates(docs, id_col, text_col, distance).where("id = component_id").select(F.col("id").alias("__kept")).distinct()
    named = docs.withColumn("__id", F.col(id_col).cast("long"))
    return named.join(kept, F.col("__id") == F.col("__kept"), "left_semi").unionByName(named.where("__id is null")).drop("__id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")
