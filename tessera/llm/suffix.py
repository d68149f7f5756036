"""Removal of repeated byte strings, exact over the corpus: suffix order, with bounded interval expansion.

A byte goes if a string of `length` bytes that covers it also starts earlier in the corpus (smaller id, or the
same document and an earlier offset). The corpus is never sorted as a whole:

1. Every window of `length` bytes is assigned to the smallest hashed `GRAM`-gram in it. Equal windows get equal
   minimisers, whatever surrounds them. Runs of windows with one minimiser are slices; a slice is described by
   (minimiser, hash of its bytes, id, start, windows), packed per bucket of minimisers.
2. In a bucket, a slice whose bytes occur earlier is repeated as a whole. Of the rest, only slices that share
   their minimiser with other bytes, or that may repeat inside themselves, need their text.
3. The texts of those are gathered by minimiser and sorted as suffixes to the depth `length`. On the
   Burrows-Wheeler transform of that order, intervals are extended backwards breadth first, which finds the
   boundaries between suffixes by increasing common prefix; it stops at `length`. What isn't separated by then
   shares `length` bytes, and all but the first of each class go.

A minimiser with very many different surroundings would make one task's group unbounded. Those found in a bounded
sample (a hint for routing, which changes no result) are listed by the hash of every window instead of by slice,
and so are those of more than `CROWD` slices in step 2: such keys spread over all tasks.

Defined results: null text is empty; texts shorter than `length` keep every byte; a row that repeats another
row's id, or has none, gets its place in the order (id, text) and is handled as a document of its own, nulls last;
an empty table gives an empty result; other columns are ignored or, by `remove_repeats`, kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_bytes, materialize, mix64, partitions, ranges, text_bytes

GRAM = 32
#: Bytes that are hashed at once, and bytes that are sorted at once.
PIECE, SORTED = 1 << 18, 1 << 20
#: Bytes of text for each bucket of minimisers, at most on average; the session's shuffle partitions are the least number of buckets.
BUCKET = 256 << 20
#: Slices of different bytes under one minimiser, beyond which their windows are compared by hash.
CROWD = 4096
#: Documents in the routing sample, and the share of them that makes a minimiser hot.
SAMPLE, HOT = 50_000, 0.001
SPAN = "id long, start int, stop int"
RUN = np.dtype([("m", "<u8"), ("h", "<u8"), ("id", "<i8"), ("start", "<i4"), ("n", "<i4")])


def gram_of(length: int) -> int:
    """The largest power of two up to GRAM that fits in the length."""
    return min(GRAM, 1 << (length.bit_length() - 1))


def minimisers(a: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every GRAM-gram, smallest hash in every window) of one buffer of bytes, wrapping on overflow."""
    gram = gram_of(length)
    h = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    s = 1
    while s < gram:  # from the hashes of s bytes to those of 2 s
        h = h[:-s] * np.uint64(pow(0xD6E8FEB86659FD93, s, 1 << 64)) + h[s:]
        s *= 2
    h = mix64(h)
    m, s, w = h, 1, length - gram + 1
    while s < w:
        t = min(s, w - s)
        m = np.minimum(m[: len(m) - t], m[t:])
        s += t
    return h, m


def slices(texts: list[bytes], ids: np.ndarray, length: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs, inner): a run per slice of the texts, and whether a window may occur twice in it."""
    out, inner, gram = [], [], gram_of(length)

    def work(parts: list[tuple[int, int, bytes]]) -> None:
        """parts: (id, offset in the document, bytes)."""
        buf = b"".join(p[2] for p in parts)
        size = np.fromiter((len(p[2]) for p in parts), np.int64, len(parts))
        stop = np.cumsum(size)
        base = stop - size
        a = np.frombuffer(buf, np.uint8)
        h, m = minimisers(a, length)
        edge = np.zeros(len(m) + 1, bool)
        edge[0] = True
        edge[1:-1] = m[1:] != m[:-1]
        edge[base] = True
        edge[np.minimum(stop - length + 1, len(m))] = True
        s = np.flatnonzero(edge[:-1])
        e = np.r_[s[1:], len(m)]
        doc = np.searchsorted(stop, s, side="right")
        ok = s + length <= stop[doc]
        s, e, doc = s[ok], e[ok], doc[ok]
        key = m[s]
        first = hash_bytes([buf[x:y] for x, y in zip(s.tolist(), (e + length - 1).tolist())])
        at = np.arange(length - gram + 1)
        twice = np.zeros(len(s), bool)
        for i in range(0, len(s), 8192):
            x = h[s[i : i + 8192, None] + at] == key[i : i + 8192, None]
            y = h[e[i : i + 8192, None] - 1 + at] == key[i : i + 8192, None]
            twice[i : i + 8192] = (x.sum(1) > 1) | (y.sum(1) > 1) | (s[i : i + 8192] + x.argmax(1) != e[i : i + 8192] - 1 + y.argmax(1))
        where = np.fromiter((p[0] for p in parts), np.int64, len(parts))
        offset = np.fromiter((p[1] for p in parts), np.int64, len(parts)) - base
        if len(hot):
            crowded = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
            if crowded.any():  # one run per window, under the hash of its bytes
                n = (e - s)[crowded]
                w, d = ranges(s[crowded], n), np.repeat(doc[crowded], n)
                strings = [buf[x : x + length] for x in w.tolist()]
                s, e, doc, twice = np.r_[s[~crowded], w], np.r_[e[~crowded], w + 1], np.r_[doc[~crowded], d], np.r_[twice[~crowded], np.zeros(len(w), bool)]
                key, first = np.r_[key[~crowded], hash_bytes(strings, 1)], np.r_[first[~crowded], hash_bytes(strings, 2)]
        runs = np.empty(len(s), RUN)
        runs["m"], runs["h"], runs["id"], runs["start"], runs["n"] = key, first, where[doc], s + offset[doc], e - s
        out.append(runs)
        inner.append(twice & (e - s > 1))

    held, total = [], 0
    for i, text in zip(ids.tolist(), texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text if len(text) <= PIECE + length - 1 else text[at : at + PIECE + length - 1]
            if len(part) >= length:
                held.append((i, at, part))
                total += len(part)
            if total >= PIECE:
                work(held)
                held, total = [], 0
    if held:
        work(held)
    return (np.concatenate(out), np.concatenate(inner)) if out else (np.empty(0, RUN), np.zeros(0, bool))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _describe(batches: Iterator[pa.RecordBatch], length: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents → packed runs by bucket. Within a batch, equal slices go on once; the rest are known to be repeats,
    travel marked by a negative count, and spread by document."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        runs, inner = slices(text_bytes(batch.column(1)), ids, length, hot)
        if not len(runs):
            continue
        order = np.lexsort((runs["start"], runs["id"], runs["h"], runs["m"]))
        runs, inner = runs[order], inner[order]
        new = _groups(runs["m"], runs["h"])
        at = np.flatnonzero(new)[np.cumsum(new) - 1]
        repeat = ~new & ((runs["id"] != runs["id"][at]) | (runs["start"] != runs["start"][at]))
        bucket = np.where(repeat, mix64(runs["id"].astype(np.uint64)), mix64(runs["m"])) % np.uint64(buckets)
        runs["start"] = np.where(inner, -runs["start"] - 1, runs["start"])  # the sign says that it may repeat inside
        runs["n"] = np.where(repeat, -runs["n"], runs["n"])
        order = np.argsort(bucket, kind="stable")
        runs, bucket = runs[order], bucket[order]
        cut = np.flatnonzero(_groups(bucket))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array([pack(x) for x in np.split(runs, cut[1:])], pa.binary())], names=["bucket", "runs"])


def pack(runs: np.ndarray) -> bytes:
    """Column by column, so that it compresses."""
    return b"".join(np.ascontiguousarray(runs[f]).tobytes() for f in RUN.names)


def unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // RUN.itemsize
    runs, at = np.empty(n, RUN), 0
    for f in RUN.names:
        size = RUN[f].itemsize * n
        runs[f] = np.frombuffer(blob, RUN[f], n, at)
        at += size
    return runs


def _spans(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.ascontiguousarray(x)) for x in (ids.astype(np.int64), start.astype(np.int32), stop.astype(np.int32), kind.astype(np.int32), m.astype(np.uint64).view(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "start", "stop", "kind", "m"])


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Packed runs of the buckets of a task → spans: kind 0 repeats as a whole, 1 needs its text, 2 needs its windows' hashes."""
    held = [unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
    if not held:
        return
    runs = np.concatenate(held)
    del held
    known = runs["n"] < 0
    inner, start = runs["start"] < 0, np.where(runs["start"] < 0, -runs["start"] - 1, runs["start"])
    k = runs[known]
    yield _spans(k["id"], start[known], start[known] - k["n"] + length - 1, np.zeros(len(k)), k["m"])
    runs, inner, start = runs[~known], inner[~known], start[~known]
    order = np.lexsort((start, runs["id"], runs["h"], runs["m"]))
    runs, inner, start = runs[order], inner[order], start[order]
    new = _groups(runs["m"], runs["h"])
    at = np.flatnonzero(new)[np.cumsum(new) - 1]
    repeat = ~new & ((runs["id"] != runs["id"][at]) | (start != start[at]))
    group = np.cumsum(_groups(runs["m"])) - 1
    others = np.bincount(group, weights=new).astype(np.int64)[group] if len(group) else group
    edge = new & ((others > 1) | inner)
    some = repeat | edge
    kind = np.where(repeat, 0, np.where(others > CROWD, 2, 1))
    yield _spans(runs["id"][some], start[some], (start + runs["n"] + length - 1)[some], kind[some], runs["m"][some])


def _fetch(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Documents with the spans that need comparing → (bucket, m, id, start, text), text null for windows by hash.

    For those, m is the hash of the window, and start goes with a second hash in the place of the text's length."""
    for batch in batches:
        rows = {"bucket": [], "m": [], "id": [], "start": [], "text": []}
        for i, text, spans in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
            for s in spans:
                part = text[s["start"] : s["stop"]]
                if s["kind"] == 1:
                    take = [(s["m"], s["start"], part)]
                else:
                    windows = [part[k : k + length] for k in range(len(part) - length + 1)]
                    one, two = hash_bytes(windows, 1).view(np.int64).tolist(), hash_bytes(windows, 2)
                    take = [(m, s["start"] + k, b"\0" + two[k].tobytes()) for k, m in enumerate(one)]
                for m, start, data in take:
                    rows["m"].append(m)
                    rows["id"].append(i)
                    rows["start"].append(start)
                    rows["text"].append(data)
        if rows["m"]:
            m = np.array(rows["m"], np.int64)
            rows["bucket"] = mix64(m.view(np.uint64)) % np.uint64(buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["bucket"].astype(np.int32)), pa.array(m), pa.array(rows["id"], pa.int64()), pa.array(rows["start"], pa.int32()), pa.array(rows["text"], pa.binary())],
                names=["bucket", "m", "id", "start", "text"],
            )


def suffix_order(sym: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the symbols, sorted by their first `depth` symbols (prefix doubling; ties in any order)."""
    n, width = len(sym), 6
    bits = max(1, int(sym.max()).bit_length())
    width = min(depth, 62 // bits)
    pad = np.concatenate([sym.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = (key << bits) | pad[i : i + n]
    done = width
    while True:
        order = np.argsort(key)
        if done >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], sorted_key[1:] != sorted_key[:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        step = min(done, depth - done)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        done += step


def boundaries(sym: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True at i if the suffixes order[i - 1] and order[i] differ within `length` symbols, none of them a separator (0).

    Backward extension, breadth first: from the interval of every string w found at one level, each string cw that
    occurs gives an interval whose end, if it is new, is a boundary with a common prefix of |w|, and is extended in
    turn. Levels are the common prefixes 0, 1, ... length - 1, and nothing longer is derived."""
    n = len(sym)
    bwt = sym[order - 1]  # cyclic: the symbol before
    count = np.bincount(sym, minlength=int(sym.max()) + 1)
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    ends = np.cumsum(count)
    mark = np.zeros(n + 1, bool)
    mark[0] = True
    some = np.flatnonzero(count[1:]) + 1
    lo, hi = ends[some] - count[some], ends[some]
    mark[lo[0] if len(lo) else 0] = True
    mark[hi] = True
    flags = np.full(n, -1, np.int64)
    for _ in range(1, length):
        if not len(lo):
            break
        size = hi - lo
        at = ranges(lo, size)
        owner = np.repeat(np.arange(len(lo)), size)
        use = bwt[at] != 0
        at, owner = at[use], owner[use]
        to, c = lf[at], bwt[at]
        if len(at) * 16 > n:
            flags[to] = owner * 512 + c
            p = np.flatnonzero(flags >= 0)
            tag = flags[p]
            flags[to] = -1
        else:
            o = np.argsort(to)
            p, tag = to[o], (owner * 512 + c)[o]
        if not len(p):
            break
        new = np.concatenate([[True], tag[1:] != tag[:-1]])
        lo = p[new]
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(p) - 1]])
        hi = p[last] + 1
        fresh = ~mark[hi]
        lo, hi = lo[fresh], hi[fresh]
        mark[hi] = True
    return mark


def repeats(texts: list[bytes], length: int) -> list[tuple[int, np.ndarray]]:
    """For texts in corpus order: (index, starts of the windows that occur earlier in these texts)."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    base = np.cumsum(size + 1) - size - 1
    buf = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    sym = buf.astype(np.int16) + 1
    sym[base + size] = 0
    sym = (np.cumsum(np.bincount(sym) > 0) - 1).astype(np.int16)[sym]  # the symbols in use, without gaps
    order = suffix_order(sym, length)
    mark = boundaries(sym, order, length)
    left = np.repeat(base + size, size + 1) - np.arange(len(buf))  # bytes up to the separator
    valid = left[order] >= length
    group = np.cumsum(mark[:-1])[valid]
    place = order[valid]
    if not len(place):
        return []
    first = np.full(int(group[-1]) + 1, len(buf), np.int64)
    np.minimum.at(first, group, place)
    again = np.sort(place[place > first[group]])
    text = np.searchsorted(base, again, side="right") - 1
    cut = np.flatnonzero(_groups(text))
    return [(int(text[c]), x - base[text[c]]) for c, x in zip(cut, np.split(again, cut[1:]))] if len(again) else []


def _resolve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Texts by minimiser, in any order → repeated spans. Whole minimisers are sorted together, SORTED bytes at once."""
    m, ids, start, text = [], [], [], []
    for batch in batches:
        m.append(batch.column(1).to_numpy())
        ids.append(batch.column(2).to_numpy())
        start.append(batch.column(3).to_numpy())
        text += batch.column(4).to_pylist()
    if not m:
        return
    m, ids, start = np.concatenate(m), np.concatenate(ids), np.concatenate(start)
    hashed = np.fromiter((len(t) == 9 for t in text), bool, len(text))  # a text has at least `length` bytes
    at = np.flatnonzero(hashed)
    if len(at):
        two = np.fromiter((int.from_bytes(text[i][1:], "little") for i in at.tolist()), np.uint64, len(at))
        order = np.lexsort((start[at], ids[at], two, m[at]))
        at, two = at[order], two[order]
        again = at[~_groups(m[at], two)]
        yield _cover(ids[again], start[again], start[again] + length)
    at = np.flatnonzero(~hashed)
    at = at[np.lexsort((start[at], ids[at], m[at]))]
    held, total = [], 0
    cuts = np.flatnonzero(_groups(m[at])) if len(at) else np.zeros(0, np.int64)

    def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = rows[np.lexsort((start[rows], ids[rows]))]
        out = []
        for k, w in repeats([text[i] for i in rows.tolist()], length):
            run = np.flatnonzero(np.r_[True, np.diff(w) != 1])
            out.append((np.full(len(run), ids[rows[k]]), start[rows[k]] + w[run], start[rows[k]] + np.r_[w[run[1:] - 1], w[-1]] + length))
        if out:
            yield _cover(*(np.concatenate(x) for x in zip(*out)))

    for group in np.split(at, cuts[1:]) if len(at) else []:
        size = sum(len(text[i]) for i in group.tolist())
        if held and total + size > SORTED:
            yield from work(np.concatenate(held))
            held, total = [], 0
        held.append(group)
        total += size
    if held:
        yield from work(np.concatenate(held))


def _cover(ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["id", "start", "stop"])


def _hot(docs: DataFrame, length: int, rows: int) -> np.ndarray:
    """Minimisers with different slices in a noticeable share of a bounded sample; at most some 100 per SAMPLE * HOT documents."""
    share = SAMPLE / max(1, rows)
    some = docs if share >= 1 else docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, _ = slices(text_bytes(batch.column(1)), batch.column(0).to_numpy(), length, np.zeros(0, np.uint64))
            pairs = np.unique(runs[["m", "h"]])
            m, n = np.unique(pairs["m"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(m[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["m", "n"])

    least = max(64, int(HOT * min(SAMPLE, SAMPLE / max(share, 1e-9))))
    rows = some.mapInArrow(run, "m long, n long").groupBy("m").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("m").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame]:
    """docs (id, text), ids distinct → (documents by id, spans (id, start, stop) of repeated bytes, overlapping, by id)."""
    spark = docs.sparkSession
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(partitions(spark), -(-size // BUCKET))
    hot = _hot(docs, length, rows)
    told = spark.sparkContext.broadcast(hot)
    runs = docs.mapInArrow(lambda it: _describe(it, length, n, told.value), "bucket int, runs binary").repartition(n, "bucket")
    found = materialize(runs.mapInArrow(lambda it: _compare(it, length), SPAN + ", kind int, m long"))
    by_id = docs.repartition(n, "id")
    ask = found.where("kind > 0").groupBy("id").agg(F.collect_list(F.struct("start", "stop", "kind", "m")).alias("spans"))
    texts = by_id.join(ask, "id").select("id", "text", "spans").mapInArrow(lambda it: _fetch(it, length, n), "bucket int, m long, id long, start int, text binary")
    more = texts.repartition(n, "bucket").mapInArrow(lambda it: _resolve(it, length), SPAN)
    return by_id, found.where("kind = 0").select("id", "start", "stop").unionByName(more)


def merge(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes; spans that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text, given, row): distinct keys in corpus order, the id as it came, and the other columns."""
    rest = [F.col(c) for c in docs.columns if c != text_col]
    base = docs.select(F.col(id_col).cast("long").alias("given"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*rest).alias("row"))
    n, distinct = base.agg(F.count("*"), F.countDistinct("given")).first()
    if n == distinct:
        return base.withColumn("key", F.col("given"))
    order = [F.col("given").asc_nulls_last(), F.col("text")]
    ordered = base.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(ordered.withColumn("key", F.monotonically_increasing_id()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> tuple[DataFrame, DataFrame]:
    """((key, n_bytes, spans, kept), (key, given, row)): by row, its size, the removed runs and the bytes that stay, in
    order; and by the same keys the id and the columns other than the text. Distinct ids are their own keys."""
    if length < 16:
        raise ValueError("length must be 16 or more")
    named = keyed(docs, id_col, text_col)
    rows = named.select(F.col("key").alias("id"), "text")
    by_id, spans = repeated_spans(rows, length)
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            texts = text_bytes(batch.column(1))
            cut = [merge(s, len(t)) for s, t in zip(batch.column(2).to_pylist(), texts)]
            kept = [b"".join(t[a:b] for a, b in zip([0] + [y for _, y in c], [x for x, _ in c] + [len(t)])) for c, t in zip(cut, texts)]
            removed = pa.array([[{"start": a, "stop": b} for a, b in c] for c in cut], span)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), removed, pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    out = by_id.join(spans, "id", "left").select("id", "text", "spans").mapInArrow(run, "id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
    return out.withColumnRenamed("id", "key"), named.select("key", "given", "row")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """docs with what stays of their texts. Bytes of a character that was cut in two go with it."""

    @F.arrow_udf("string")
    def decoded(kept: pa.Array) -> pa.Array:
        return pa.array([(b or b"").decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())

    kept, named = remove_repeats(docs, id_col, text_col, length)
    both = kept.join(named, "key").withColumn("text", decoded("kept"))
    return both.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read

    docs = read(spark, sf_dir, "documents")
    kept, named = remove_repeats(docs)
    ids_differ = named.where("key is distinct from given").limit(1).count()
    out = kept.join(named.select("key", "given"), "key") if ids_differ else kept.withColumn("given", F.col("key"))
    return out.select(
        F.col("given").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
