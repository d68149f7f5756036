"""Mixing sources to target weights by Pfair scheduling.

Every source's rows, in a random order fixed by a seed, are cut into blocks. Block j of a source of weight w has the
release time floor(j / w) and the deadline ceil((j + 1) / w), in slots of one block. Earliest deadline first among the
released blocks fills one slot after the other; the weights sum to 1, so every deadline is met, and at any time a
source has had its share of the slots to within less than one block.

Release times and deadlines are exact: the weights, as the doubles they are, are integers over their sum, of any size.
The schedule of all blocks is laid out on the driver, a block after the other, and sent out as one slot number a block;
it is bounded by BLOCKS, and more of them than that are refused: larger blocks (`block_rows`) hold more rows.
When a source runs out, the rest go on with their weights in proportion, from that slot: an epoch per source at most.
Every row is placed, none twice.

Defined results: a null source is a source of its own; sources without a target weight get the smallest given one; a
weight of 0 or less is refused; repeated rows are placed separately; the order of rows that equal each other in
id and text is open; an empty table gives an empty result; other columns stay as they are, but for columns that are called
block, slot or position already, which become block_0 and so on (or the next free number); they may be the source or the id.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Callable
from fractions import Fraction
from math import gcd, inf, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import set_aside

#: Sources are collected with their sizes; more than this many are refused. So are more blocks than fit in 256 MB of slot numbers.
SOURCES, BLOCKS = 2048, 1 << 26
#: Rows that one task ranks at once, on average.
RANKED = 10_000


def integer_weights(weights: list[float], period: int | None = None) -> list[int]:
    """Positive integers in the exact ratio of the weights; with a period, such that sum to it, close to the weights' shares (largest remainders)."""
    if any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    if period is None:
        exact = [Fraction(w) for w in weights]
        whole = [int(x * lcm(*(x.denominator for x in exact))) for x in exact]
        return [n // gcd(*whole) for n in whole]
    total = sum(weights)
    exact = [w / total * period for w in weights]
    q = [max(1, int(x)) for x in exact]
    order = sorted(range(len(q)), key=lambda i: (q[i] - exact[i], i))
    k = 0
    while sum(q) < period:
        q[order[k % len(q)]] += 1
        k += 1
    while sum(q) > period:
        i = max(range(len(q)), key=lambda i: (q[i] - exact[i] if q[i] > 1 else -period, -i))
        q[i] -= 1
    return q


def serve(shares: list[int], blocks: list[float], slots: float = inf) -> array:
    """The source of slot after slot, by earliest deadline first among released blocks, until a source has had its blocks or the slots are full."""
    total, done, order = sum(shares), [0] * len(shares), array("i")
    # a source's next block waits for its release, then for its turn
    later, ready = [], [(-(-total // n), i) for i, n in enumerate(shares)]
    heapq.heapify(ready)
    t = 0
    while t < slots:
        while later and later[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(later)[1:])
        deadline, i = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline is missed")
        order.append(i)
        t += 1
        done[i] = j = done[i] + 1
        if j >= blocks[i]:
            break
        release, deadline = j * total // shares[i], -(-(j + 1) * total // shares[i])
        if release <= t:
            heapq.heappush(ready, (deadline, i))
        else:
            heapq.heappush(later, (release, deadline, i))
    return order


def split(order: array, n: int) -> list[np.ndarray]:
    """Per source, its slots."""
    order = np.frombuffer(order, np.intc) if len(order) else np.zeros(0, np.intc)
    return np.split(np.argsort(order, kind="stable"), np.cumsum(np.bincount(order, minlength=n))[:-1])


def schedule(q: list[int], slots: int) -> list[np.ndarray]:
    """Per source of weight q / sum(q), the slots of its blocks within the first slots."""
    return split(serve(q, [inf] * len(q), slots), len(q))


def epochs(blocks: list[int], weights: list[float]) -> list[np.ndarray]:
    """Per source, the slot of each of its blocks; a new epoch as sources run out."""
    left, slot, out = [i for i, n in enumerate(blocks) if n > 0], 0, [[] for _ in blocks]
    done, kind = [0] * len(blocks), np.uint32 if sum(blocks) < 1 << 32 else np.int64
    while left:
        if len(left) == 1:
            i = left[0]
            out[i].append(np.arange(slot, slot + blocks[i] - done[i], dtype=kind))
            break
        order = serve(integer_weights([weights[i] for i in left]), [blocks[i] - done[i] for i in left])
        for i, p in zip(left, split(order, len(left))):
            out[i].append((p + slot).astype(kind))
            done[i] += len(p)
        slot, left = slot + len(order), [i for i in left if done[i] < blocks[i]]
    return [np.concatenate(x) if x else np.zeros(0, kind) for x in out]


def mix(
    docs: DataFrame, weights: dict[str, float] | Callable[[str | None, int], float] | None = None, block_rows: int = 16, source_col: str = "source", id_col: str = "doc_id", seed: int = 0, power: float = 0.5,
    text_col: str | None = None, out: tuple[str, str, str] = ("block", "slot", "position"),
) -> DataFrame:
    """docs with block, slot and position: reading by position gives the mixture.

    weights: by source, or a function of the source and its rows; by default a source's share of the rows to the given power.
    Position is slot * block_rows + place in the block; a source's last block may be short, which leaves a gap. A source's rows are in
    the order of the MD5 of seed, id (and text)."""
    spark = docs.sparkSession
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), plain(id_col), *([plain(text_col)] if text_col else [])).cast("binary"))
    named = docs.withColumn("__tessera_s", F.col(source_col).cast("string")).withColumn("__tessera_i", F.col(id_col)).withColumn("__tessera_u", key)
    named = set_aside(named, *out)
    sizes = named.groupBy(F.col("__tessera_s").alias("s")).agg(F.count("*").alias("n")).limit(SOURCES + 1).collect()
    if len(sizes) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    sizes = sorted(((r["s"], r["n"]) for r in sizes), key=lambda x: (x[0] is None, str(x[0])))
    if callable(weights):
        w = [weights(s, n) for s, n in sizes]
    else:
        least = min(weights.values()) if weights else None
        w = [weights.get(s, least) if weights else float(n) ** power for s, n in sizes]
    if any(not x > 0 for x in [*w, *(weights.values() if isinstance(weights, dict) else [])]):
        raise ValueError("weights must be positive")
    blocks = [-(-n // block_rows) for _, n in sizes]
    if sum(blocks) > BLOCKS:
        raise ValueError(f"more than {BLOCKS} blocks: take blocks of more rows")
    told = spark.sparkContext.broadcast(dict(zip([s for s, _ in sizes], epochs(blocks, w))))

    @F.arrow_udf("long")
    def slot_of(sources: pa.Array, blocks: pa.Array) -> pa.Array:
        names, block = sources.dictionary_encode(null_encoding="encode"), blocks.to_numpy()
        kind, out = names.indices.to_numpy(), np.zeros(len(block), np.int64)
        for k, name in enumerate(names.dictionary.to_pylist()):
            mine = kind == k
            out[mine] = told.value[name][block[mine]]
        return pa.array(out)

    # ranks within the source, a hot one split over many groups: buckets of the hash in order, then places in them
    bits = max(1, int(max([n for _, n in sizes], default=1) / RANKED).bit_length())
    top = F.shiftrightunsigned(F.conv(F.substring("__tessera_u", 1, 8), 16, 10).cast("long"), 32 - min(bits, 32))
    named = named.withColumn("__tessera_b", top)
    before = Window.partitionBy("__tessera_s2").orderBy("__tessera_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = named.groupBy(F.col("__tessera_s").alias("__tessera_s2"), F.col("__tessera_b").alias("__tessera_c")).agg(F.count("*").alias("__tessera_n")).withColumn("__tessera_before", F.coalesce(F.sum("__tessera_n").over(before), F.lit(0)))
    inside = Window.partitionBy("__tessera_s", "__tessera_b").orderBy("__tessera_u", "__tessera_i")
    ranked = named.withColumn("__tessera_r", F.row_number().over(inside) - 1)
    ranked = ranked.join(counts, F.col("__tessera_s").eqNullSafe(F.col("__tessera_s2")) & (F.col("__tessera_b") == F.col("__tessera_c"))).withColumn("__tessera_r", F.col("__tessera_r") + F.col("__tessera_before"))
    block, slot, position = out
    ranked = ranked.withColumn(block, F.floor(F.col("__tessera_r") / block_rows))
    ranked = ranked.withColumn(slot, slot_of(F.col("__tessera_s"), F.col(block))).withColumn(position, F.col(slot) * block_rows + F.col("__tessera_r") % block_rows)
    return ranked.drop(*(c for c in ranked.columns if c.startswith("__tessera_")))


def target(source: str | None, rows: int = 0) -> int:
    """The target weight of a source in op1_mixing: 1 to 8, by its name."""
    return 1 + hashlib.md5((source or "").encode()).digest()[0] % 8


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All of documents, mixed to target weights of 1 to 8 by source, in blocks of 16 rows."""
    from tessera.llm.common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, target).select("doc_id", "source", "block", "slot", "position")


#: Slot after slot by the definition: of the live sources' next blocks that are released, the one of the earliest deadline.
SQL = """
with recursive s as (select source, row_number() over (order by source nulls last) as i, ceil(count(*) / 16.0)::bigint as blocks, 1 + ('0x' || substr(md5(coalesce(source, '')), 1, 2))::bigint % 8 as w from documents group by source),
l as (select list(w order by i) as w, list(blocks order by i) as b, count(*)::bigint as n, sum(blocks)::bigint as slots from s),
r as (
  select 0::bigint as slot, 0::bigint as epoch, list_transform(b, lambda x: 0::bigint) as done, list_transform(b, lambda x: 0::bigint) as base, null::bigint as i, null::bigint as block from l
  union all
  select slot + 1, case when done[p] + 1 = b[p] then slot + 1 else epoch end, next, case when done[p] + 1 = b[p] then next else base end, p, done[p]
  from (
    select *, list_transform(done, lambda x, k: case when k = p then x + 1 else x end) as next from (
      select *, list_min(list_transform(list_filter(range(1, n + 1), lambda k: done[k] < b[k] and (done[k] - base[k]) * total // w[k] <= slot - epoch),
        lambda k: ((done[k] - base[k] + 1) * total + w[k] - 1) // w[k] * 100000 + k)) % 100000 as p
      from (select r.*, l.*, list_sum(list_transform(range(1, n + 1), lambda k: case when done[k] < b[k] then w[k] else 0 end))::bigint as total from r, l where slot < slots))
  )
),
placed as (select slot - 1 as slot, i, block from r where i is not null),
d as (select doc_id, source, row_number() over (partition by source order by md5('0:' || coalesce(doc_id::varchar, '')), doc_id) - 1 as k from documents)
select doc_id, d.source, (k // 16)::bigint as block, slot, (slot * 16 + k % 16)::bigint as position
from d join s on d.source is not distinct from s.source join placed p on p.i = s.i and p.block = k // 16"""
