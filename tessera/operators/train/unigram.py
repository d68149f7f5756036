"""Unigram language model: seed from frequent substrings, EM over distinct words, pruning by loss."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Characters of words whose expectations are computed at once.
LETTERS = 1 << 17


def seed(counts: DataFrame, size: int = 100_000, max_length: int = 16, least: int = 2) -> DataFrame:
    """(type, score): substrings of words by count times length, all single characters first."""
    n = F.length("word")
    starts = F.explode(F.sequence(F.lit(1), n)).alias("i")
    subs = counts.where(n > 0).select("word", "count", starts).select("count", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(max_length), F.length("word") - F.col("i") + 1)), lambda k: F.substring("word", F.col("i"), k))).alias("type"))
    scored = subs.groupBy("type").agg(F.sum("count").alias("n")).where((F.col("n") >= least) | (F.length("type") == 1))
    return scored.withColumn("score", F.col("n") * F.length("type")).orderBy((F.length("type") == 1).desc(), F.desc("score"), "type").limit(size)


def expectations(word: str, logp: dict[str, float], most: int) -> tuple[float, dict[str, float]]:
    """(log likelihood, expected uses of each type) over all segmentations."""
    n, neg = len(word), float("-inf")
    add = lambda a, b: b if a == neg else a if b == neg else max(a, b) + math.log1p(math.exp(-abs(a - b)))
    alpha, beta, edges = [0.0] + [neg] * n, [neg] * n + [0.0], []
    for i in range(n):
        if alpha[i] == neg:
            continue
        for j in range(i + 1, min(n, i + most) + 1):
            p = logp.get(word[i:j])
            if p is not None:
                edges.append((i, j, p))
                alpha[j] = add(alpha[j], alpha[i] + p)
    if alpha[n] == neg:
        return neg, {}
    for i, j, p in reversed(edges):
        beta[i] = add(beta[i], beta[j] + p)
    out: dict[str, float] = {}
    for i, j, p in edges:
        x = alpha[i] + p + beta[j] - alpha[n]
        if x > -60:
            out[word[i:j]] = out.get(word[i:j], 0.0) + math.exp(x)
    return alpha[n], out


def _digamma(x: float) -> float:
    r = 0.0
    while x < 7:
        r -= 1 / x
        x += 1
    x -= 0.5
    y = 1 / (x * x)
    return r + math.log(x) + y / 24 - 7 * y * y / 960 + 31 * y**3 / 8064


class _Types:
    """Types as a tree of characters in arrays: a node's children are found by a search among (node, character) keys."""

    def __init__(self, logp: dict[str, float]):
        self.names, self.most = list(logp), max(map(len, logp), default=0)
        nodes, of = {"": 0}, {}
        for k, t in enumerate(self.names):
            for i in range(1, len(t) + 1):
                nodes.setdefault(t[:i], len(nodes))
            of[nodes[t]] = k
        edges = sorted((nodes[t[:-1]] << 21 | ord(t[-1]), n) for t, n in nodes.items() if t)
        self.keys, self.to = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        self.type = np.full(len(nodes), -1)
        self.type[list(of)] = list(of.values())
        self.logp = np.array([logp[t] for t in self.names])
        low = min(len(nodes), 1 << 22 >> 7)  # children by an ASCII character, for as many nodes as 32 MB hold
        self.ascii = np.full((low, 128), -1)
        few = (self.keys >> 21 < low) & (self.keys & (1 << 21) - 1 < 128)
        self.ascii[self.keys[few] >> 21, self.keys[few] & 127] = self.to[few]

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child, or -1."""
        out, low = np.full(len(node), -1), (node < len(self.ascii)) & (char < 128)
        out[low] = self.ascii[node[low], char[low]]
        if len(self.keys) and not low.all():
            want = node[~low] << 21 | char[~low]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            out[~low] = np.where(self.keys[at] == want, self.to[at], -1)
        return out

    def uses(self, words: Sequence[str], n: np.ndarray) -> np.ndarray:
        """Expected uses of each type in words of one length, times their counts: `expectations` for all words at once."""
        size, rows = len(words[0]), len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(rows, size).astype(np.int64)
        alpha, beta = np.full((size + 1, rows), -np.inf), np.full((size + 1, rows), -np.inf)
        alpha[0], beta[size] = 0.0, 0.0
        edges = []
        for i in range(size):
            row = np.flatnonzero(alpha[i] > -np.inf)
            node = np.zeros(len(row), np.int64)
            for j in range(i, min(size, i + self.most)):
                node = self.step(node, chars[row, j])
                row, node = row[node >= 0], node[node >= 0]
                if not len(row):
                    break
                kind = self.type[node]
                hit, kind = row[kind >= 0], kind[kind >= 0]
                alpha[j + 1, hit] = np.logaddexp(alpha[j + 1, hit], alpha[i, hit] + self.logp[kind])
                edges.append((i, j + 1, hit, kind))
        for i, j, hit, kind in reversed(edges):
            beta[i, hit] = np.logaddexp(beta[i, hit], beta[j, hit] + self.logp[kind])
        out = np.zeros(len(self.names))
        for i, j, hit, kind in edges:
            whole = alpha[size, hit]
            ok = whole > -np.inf
            x = alpha[i, hit[ok]] + self.logp[kind[ok]] + beta[j, hit[ok]] - whole[ok]
            likely = x > -60
            out += np.bincount(kind[ok][likely], np.exp(x[likely]) * n[hit[ok][likely]], len(out))
        return out


def em_step(counts: DataFrame, logp: dict[str, float]) -> dict[str, float]:
    """Expected uses by type over all words; combined per task before the shuffle, at most one row per type comes back.

    Words of one length are done together, as many at once as about LETTERS characters; 16 times as many wait at most."""
    told = counts.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = _Types(told.value)
        total, held, waiting = np.zeros(len(types.names)), defaultdict(list), 0

        def done(size: int) -> None:
            words, n = zip(*held.pop(size))
            total[:] += types.uses(words, np.array(n, float))

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word:
                    size = len(word)
                    held[size].append((word, n))
                    waiting += size
                    if len(held[size]) * size >= LETTERS:
                        waiting -= len(held[size]) * size
                        done(size)
                    elif waiting >= 16 * LETTERS:
                        for size in list(held):
                            done(size)
                        waiting = 0
        for size in list(held):
            done(size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([types.names[i] for i in used], pa.string()), pa.array(total[used])], names=["type", "x"])

    rows = counts.select("word", "count").mapInArrow(run, "type string, x double").groupBy("type").agg(F.sum("x").alias("x")).toArrow()
    return dict(zip(rows["type"].to_pylist(), rows["x"].to_pylist()))


def fit(counts: DataFrame, size: int, seed_size: int = 100_000, max_length: int = 16, shrink: float = 0.75, rounds: int = 2) -> dict[str, float]:
    """Type → log probability; single characters always stay."""
    from tessera.operators.segment.lattice import unigram
    from tessera.session import spread
    from tessera.sources.artifacts import checkpoint

    counts = spread(checkpoint(counts))  # counted once for all rounds
    start = {r["type"]: float(r["score"]) for r in seed(counts, seed_size, max_length).collect()}
    total = sum(start.values())
    logp = {t: math.log(s / total) for t, s in start.items()}
    while True:
        for _ in range(rounds):
            x = em_step(counts, logp)
            x = {t: n for t, n in x.items() if n >= 0.5 or len(t) == 1} | {t: 1e-3 for t in logp if len(t) == 1 and t not in x}
            z = _digamma(sum(x.values()))
            logp = {t: _digamma(max(n, 1e-3)) - z for t, n in x.items()}
        if len(logp) <= size:
            return logp
        # loss of a type: its uses times what its best other segmentation costs more
        keep = max(size, int(len(logp) * shrink))
        loss = {}
        for t, n in x.items():
            if len(t) == 1:
                loss[t] = float("inf")
                continue
            rest = {s: p for s, p in ((t[i:j], logp.get(t[i:j])) for i in range(len(t)) for j in range(i + 1, len(t) + 1)) if p is not None and s != t}
            parts = unigram(rest)(t) if rest else list(t)
            loss[t] = n * (logp[t] - sum(rest.get(s, -30.0) for s in parts))
        kept = sorted(loss, key=lambda t: (-loss[t], t))[:keep]
        logp = {t: logp[t] for t in kept}
