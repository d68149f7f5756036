"""Byte-pair training over distinct pretokens, with the objectives and prunings of its relatives.

Counting is distributed. The loop itself is sequential by nature (each merge changes all later counts): up to `driver_words`
distinct words it runs on the driver with incremental counts; beyond, words stay in the cluster, and a round is one job that
rewrites them and tells how the sums of pairs and tokens moved. Both ways take the same steps (`_steps`) from the same sums, so they
give the same merges, for every objective. Plain merges that can't touch each other share a round.
"""

from __future__ import annotations

import heapq
from array import array
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.segment import column
from tessera.operators.segment.bpe import atoms as default_atoms
from tessera.operators.segment.bpe import decomposing

#: Words on the driver take about a kilobyte each, with the pairs that they are in.
DRIVER_WORDS = 100_000


@dataclass
class Result:
    alphabet: list[str]
    merges: list[tuple[str, ...]]
    events: list[tuple[bool, tuple[str, ...]]] = field(default_factory=list)
    removed: set[str] = field(default_factory=set)

    def types(self) -> list[str]:
        made = dict.fromkeys("".join(m) for m in self.merges)
        return [t for t in [*self.alphabet, *(m for m in made if m not in self.alphabet)] if t not in self.removed]


def word_counts(df: DataFrame, word: str = "word", count: str = "count") -> DataFrame:
    return df.where(F.col(word).isNotNull() & (F.col(word) != "")).groupBy(F.col(word).alias("word")).agg(F.sum(count).cast("long").alias("count"))


def pairs_of(tokens: list[str]) -> list[tuple[str, str]]:
    """Neighbours that can merge: of three equal tokens in a row, one pair can."""
    pairs = list(zip(tokens, tokens[1:]))
    if len(set(tokens)) == len(tokens):
        return pairs
    out, overlap = [], False
    for k, p in enumerate(pairs):
        overlap = not overlap and k > 0 and tokens[k - 1] == p[0] == p[1]
        if not overlap:
            out.append(p)
    return out


class Corpus:
    """Words as token lists, with pair and token counts that follow every change."""

    def __init__(self, words: list[tuple[list[str], int]]):
        self.words = words
        self.pairs: defaultdict[tuple[str, str], int] = defaultdict(int)
        self.tokens: defaultdict[str, int] = defaultdict(int)
        self.where: dict[tuple[str, str], set[int]] = defaultdict(set)
        self.total = self.size = 0
        for i, (tokens, n) in enumerate(words):
            for t in tokens:
                self.tokens[t] += n
            for p in pairs_of(tokens):
                self.pairs[p] += n
                self.where[p].add(i)
        self.total, self.size = sum(self.tokens.values()), len(self.tokens)

    def _token(self, t: str, by: int) -> None:
        was = self.tokens[t]
        self.tokens[t] = was + by
        self.size += (was + by > 0) - (was > 0)
        self.total += by

    def rewrite(self, touched: set[int], change: Callable[[list[str]], list[str]]) -> set[tuple[str, str]]:
        """The pairs whose counts moved. What a word keeps at its ends isn't counted anew."""
        changed: set[tuple[str, str]] = set()
        moved: defaultdict[str, int] = defaultdict(int)
        words, pairs, where = self.words, self.pairs, self.where
        for i in touched:
            old, n = words[i]
            new = change(old)
            if len(new) == len(old):
                continue
            words[i] = (new, n)
            p, q = pairs_of(old), pairs_of(new)
            a, most = 0, min(len(p), len(q))
            while a < most and p[a] == q[a]:
                a += 1
            b = 0
            while b < most - a and p[-1 - b] == q[-1 - b]:
                b += 1
            for x in p[a : len(p) - b]:
                pairs[x] -= n
                changed.add(x)
            for x in q[a : len(q) - b]:
                pairs[x] += n
                where[x].add(i)
                changed.add(x)
            for t in old:
                moved[t] -= n
            for t in new:
                moved[t] += n
        for t, by in moved.items():
            if by:
                self._token(t, by)
        return changed


def frequency(n: int, a: int, b: int, both: int, same: bool, total: int, size: int) -> float:
    return n


def pmi(n: int, a: int, b: int, both: int, same: bool, total: int, size: int) -> float:
    """count(xy) / (count(x) count(y)), as in WordPiece."""
    return n / (a * b)


def smoothed_gain(n: int, a: int, b: int, both: int, same: bool, total: int, size: int) -> float:
    """Laplace-smoothed count times pointwise information."""
    left = [a - 2 * n] * 2 if same else [a - n, b - n]
    return n * (log(n + 1) + log(total - n + size + 1) - sum(log(max(x + 1, 1e-9)) for x in left))


def description_gain(n: int, a: int, b: int, both: int, same: bool, total: int, size: int) -> float:
    """Change of description length: the corpus with the pair as one token, and the pair as a new entry."""
    xlog = lambda x: x * log2(x) if x > 0 else 0.0
    gain = xlog(n) + xlog(both + 1) - (xlog(total + (n + 1) + (2 - 2 * n)) - xlog(total))
    for t, m in [(a, 2)] if same else [(a, 1), (b, 1)]:
        gain += xlog(t + m - m * n) - xlog(t)
    return gain


#: score(pair's count, its tokens' counts, the joined type's, whether the tokens are equal, all tokens, types that occur)
OBJECTIVES = {"frequency": frequency, "pmi": pmi, "smoothed": smoothed_gain, "description": description_gain}
LOCAL = {"frequency"}


def merge_pair(tokens: list[str], pair: tuple[str, str]) -> list[str]:
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and tokens[i] == pair[0] and tokens[i + 1] == pair[1]:
            out.append(pair[0] + pair[1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


class _Local:
    """The sums of words on the driver."""

    def __init__(self, words: list[tuple[list[str], int]], objective: str, least: int, max_length: int):
        self.corpus, self.objective, self.least, self.max_length = Corpus(words), objective, least, max_length
        self.heap: list = []
        if objective in LOCAL:
            self._push(list(self.corpus.pairs))

    def _push(self, pairs) -> None:
        for p in pairs:
            if self.corpus.pairs[p] >= self.least and len(p[0]) + len(p[1]) <= self.max_length:
                heapq.heappush(self.heap, (-self.corpus.pairs[p], p))

    def alphabet(self) -> list[str]:
        return list(self.corpus.tokens)

    def best(self) -> tuple[float, tuple[str, str]] | None:
        c = self.corpus
        if self.objective in LOCAL:
            while self.heap:
                s, p = self.heap[0]
                if c.pairs[p] >= self.least and -s == c.pairs[p]:
                    return -s, p
                heapq.heappop(self.heap)
            return None
        f, tokens = OBJECTIVES[self.objective], c.tokens
        ok = [(-f(n, tokens[p[0]], tokens[p[1]], tokens["".join(p)], p[0] == p[1], c.total, c.size), p) for p, n in c.pairs.items() if n >= self.least and n > 0 and len(p[0]) + len(p[1]) <= self.max_length]
        return (lambda x: (-x[0], x[1]))(min(ok)) if ok else None

    def count(self, pair: tuple[str, str]) -> int:
        return self.corpus.pairs[pair]

    def token(self, t: str) -> int:
        return self.corpus.tokens[t]

    def merge(self, pair: tuple[str, str]) -> None:
        self._changed(set(self.corpus.where[pair]), lambda t: merge_pair(t, pair))

    def split(self, t: str, parts: tuple[str, ...]) -> None:
        at = {i for p, ws in self.corpus.where.items() if t in p for i in ws} | {i for i, (x, _) in enumerate(self.corpus.words) if t in x}
        self._changed(at, lambda x: [y for z in x for y in (parts if z == t else (z,))])

    def _changed(self, at: set[int], change: Callable[[list[str]], list[str]]) -> None:
        changed = self.corpus.rewrite(at, change)
        if self.objective in LOCAL:
            self._push(changed)


def _rank(at: np.ndarray) -> np.ndarray:
    """Of rising positions: the place of each in its stretch of neighbours."""
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))


def _found(t: np.ndarray, step: tuple[int, int, tuple[int, ...]]) -> np.ndarray:
    """Where a step changes a text of numbers: at the left number of a pair, or at what is split."""
    kind, made, parts = step
    if not kind:
        return np.flatnonzero(t == made)
    at = np.flatnonzero((t[:-1] == parts[0]) & (t[1:] == parts[1]))
    return at[_rank(at) % 2 == 0] if parts[0] == parts[1] and len(at) else at


def _applied(t: np.ndarray, step: tuple[int, int, tuple[int, ...]], at: np.ndarray) -> np.ndarray:
    kind, made, parts = step
    if not len(at):
        return t
    most = max(made, *parts)
    t = t.astype(np.int32) if most > np.iinfo(t.dtype).max else t.copy()
    if kind:
        t[at] = made
        keep = np.ones(len(t), bool)
        keep[at + 1] = False
        return t[keep]
    sizes = np.ones(len(t), np.int64)
    sizes[at] = len(parts)
    out, first = np.repeat(t, sizes), at + np.arange(len(at)) * (len(parts) - 1)
    for j, x in enumerate(parts):
        out[first + j] = x
    return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, where = np.unique(keys, return_inverse=True)
    out = np.zeros(len(known), np.int64)
    np.add.at(out, where, n)
    return known, out


def _counted(t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of pairs (left << 32 | right) and of tokens (token << 32), as `pairs_of` tells pairs. Zero ends a word; n: its count."""
    end = t == 0
    w = n[np.cumsum(end) - end]
    ok = ~end[:-1] & ~end[1:]
    same = np.flatnonzero(ok & (t[:-1] == t[1:]))
    ok[same[_rank(same) % 2 == 1]] = False
    wide = t.astype(np.int64) << 32
    return _summed(np.concatenate([wide[:-1][ok] | t[1:][ok], wide[~end]]), np.concatenate([w[:-1][ok], w[~end]]))


def _moved(t: np.ndarray, n: np.ndarray, step) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text after a step, and what the sums of the words that it changes gain."""
    at = _found(t, step)
    if not len(at):
        return t, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(t == 0)
    words = np.unique(np.searchsorted(ends, at))
    stops = ends[words] + 1
    starts = np.where(words > 0, ends[words - 1] + 1, 0)
    sizes = stops - starts
    old = t[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    (a, x), (b, y) = _counted(old, n[words]), _counted(_applied(old, step, _found(old, step)), n[words])
    keys, by = _summed(np.concatenate([a, b]), np.concatenate([-x, y]))
    return _applied(t, step, at), keys[by != 0], by[by != 0]


class _Cluster:
    """Words stay in the cluster, as blocks of numbered tokens in files. A round is a job: every task takes the blocks as they were last
    written, does the steps since then, and tells what the sums gain by the newest ones. The driver has the sums of pairs and tokens
    (16 bytes a pair) and nothing of the words.

    Every EVERY steps the blocks are written anew."""

    EVERY, BLOCK = 16, 1 << 18

    def __init__(self, counts: DataFrame, objective: str, least: int, max_length: int, atomise):
        from tessera.session import spread
        from tessera.sources.artifacts import checkpoint

        self.objective, self.least, self.max_length, size = objective, max(least, 1), max_length, self.BLOCK

        def letters(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(list({a for w in batch.column(0).to_pylist() for a in atomise(w)}), pa.string())], names=["a"])

        def blocks(batches):
            text, n = array("i"), array("q")

            def block():
                t = np.frombuffer(text, np.int32)
                t = t.astype(np.uint16) if t.max() < 1 << 16 else t
                return pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([t.itemsize], pa.int32())], names=["t", "n", "width"])

            for batch in batches:
                for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if tokens := [ids[a] for a in atomise(w)]:
                        text.extend(tokens)
                        text.append(0)
                        n.append(c)
                        if len(text) >= size:
                            yield block()
                            text, n = array("i"), array("q")
            if n:
                yield block()

        counts = spread(counts.select("word", F.col("count").cast("long").alias("count")))
        self.names = ["", *sorted(r[0] for r in counts.mapInArrow(letters, "a string").distinct().collect())]
        self.ids = ids = {a: i for i, a in enumerate(self.names)}
        self.blocks = checkpoint(counts.mapInArrow(blocks, "t binary, n binary, width int"))
        self.steps: list[tuple[int, int, tuple[int, ...]]] = []
        self.new = 0
        self.dirty: set[str] = set()
        self.alone = True
        self.keys, self.n, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.names), np.int64)
        self._add(self._job(None))

    def _job(self, new: int | None) -> tuple[np.ndarray, np.ndarray]:
        """What the sums gain by the last `new` steps; without a number: all sums."""
        steps, before = list(self.steps), len(self.steps) - (new or 0)

        def run(batches):
            keys, by = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for batch in batches:
                for t, n, width in zip(*(c.to_pylist() for c in batch.columns)):
                    t, n = np.frombuffer(t, np.uint16 if width == 2 else np.int32), np.frombuffer(n, np.int64)
                    for s in steps[:before]:
                        t = _applied(t, s, _found(t, s))
                    found = [_counted(t, n)] if new is None else []
                    for s in steps[before:]:
                        t, k, x = _moved(t, n, s)
                        found.append((k, x))
                    keys += [k for k, _ in found]
                    by += [x for _, x in found]
                    if sum(map(len, keys)) > 1 << 20:
                        keys, by = ([z] for z in _summed(np.concatenate(keys), np.concatenate(by)))
            k, x = _summed(np.concatenate(keys), np.concatenate(by))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(x)], names=["k", "x"])

        told = self.blocks.mapInArrow(run, "k long, x long")
        told = (told.groupBy("k").agg(F.sum("x").alias("x")) if new is None else told).toArrow()
        return _summed(told["k"].to_numpy(), told["x"].to_numpy())

    def _add(self, gained: tuple[np.ndarray, np.ndarray]) -> None:
        keys, by = gained
        token = keys & 0xFFFFFFFF == 0
        self.uses = np.concatenate([self.uses, np.zeros(len(self.names) - len(self.uses), np.int64)])
        self.uses[keys[token] >> 32] += by[token]
        self.keys, self.n = _summed(np.concatenate([self.keys, keys[~token]]), np.concatenate([self.n, by[~token]]))
        self.keys, self.n = self.keys[self.n != 0], self.n[self.n != 0]
        self.lengths = np.array([len(x) for x in self.names])
        self.new, self.dirty, self.alone, self.taken = 0, set(), True, set()

    def _sum(self) -> None:
        from tessera.sources.artifacts import checkpoint

        self._add(self._job(self.new))
        if len(self.steps) >= self.EVERY:
            steps = list(self.steps)

            def run(batches):
                for batch in batches:
                    for t, n, width in zip(*(c.to_pylist() for c in batch.columns)):
                        t = np.frombuffer(t, np.uint16 if width == 2 else np.int32)
                        for s in steps:
                            t = _applied(t, s, _found(t, s))
                        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary()), pa.array([n], pa.binary()), pa.array([t.itemsize], pa.int32())], names=["t", "n", "width"])

            self.blocks, self.steps = checkpoint(self.blocks.mapInArrow(run, "t binary, n binary, width int")), []

    def alphabet(self) -> list[str]:
        return self.names[1:]

    def _key(self, pair: tuple[str, str]) -> int:
        return self.ids[pair[0]] << 32 | self.ids[pair[1]]

    def _at(self, keys: list[int] | np.ndarray) -> np.ndarray:
        """Places of those keys that there are."""
        at = np.searchsorted(self.keys, k := np.asarray(keys, np.int64))
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == k[there]
        return at[there]

    def _joined(self) -> np.ndarray:
        """Per pair, how often the type that it makes occurs already."""
        out = np.zeros(len(self.keys), np.int64)
        for s in self.names[1:]:
            if len(s) > 1:
                halves = [(s[:i], s[i:]) for i in range(1, len(s)) if s[:i] in self.ids and s[i:] in self.ids]
                out[self._at([self._key(h) for h in halves])] = self.uses[self.ids[s]]
        return out

    def _best(self, n: np.ndarray) -> tuple[float, list[tuple[str, str]]] | None:
        """The best score and the pairs that have it. Vectors find those that may be best, exact numbers decide."""
        a, b = self.keys >> 32, self.keys & 0xFFFFFFFF
        ok = np.flatnonzero((n >= self.least) & (self.lengths[a] + self.lengths[b] <= self.max_length))
        if not len(ok):
            return None
        named = lambda i: (self.names[a[i]], self.names[b[i]])
        if self.objective == "frequency":
            top = n[ok].max()
            return int(top), [named(i) for i in ok[n[ok] == top]]
        total, size = int(self.uses.sum()), int((self.uses > 0).sum())
        both = self._joined() if self.objective == "description" else np.zeros(len(n), np.int64)
        x, ca, cb, same = n[ok].astype(float), self.uses[a[ok]].astype(float), self.uses[b[ok]].astype(float), a[ok] == b[ok]
        xlog = lambda v: v * np.log2(np.where(v > 0, v, 1.0))
        slack = 1e-12 * total * log2(total + 2)
        if self.objective == "pmi":
            near, slack = x / (ca * cb), 0.0
        elif self.objective == "smoothed":
            left = [np.log(np.maximum(np.where(same, ca - 2 * x, c - x) + 1, 1e-9)) for c in (ca, cb)]
            near = x * (np.log(x + 1) + np.log(total - x + size + 1) - left[0] - left[1])
        else:
            near = xlog(x) + xlog(both[ok] + 1.0) - (xlog(total + (x + 1) + (2 - 2 * x)) - xlog(np.float64(total)))
            one, two = xlog(ca + 1 - x) - xlog(ca) + xlog(cb + 1 - x) - xlog(cb), xlog(ca + 2 - 2 * x) - xlog(ca)
            near = near + np.where(same, two, one)
        f, some = OBJECTIVES[self.objective], ok[near >= near.max() - slack - 1e-9 * abs(near.max())]
        scores = [f(int(n[i]), int(self.uses[a[i]]), int(self.uses[b[i]]), int(both[i]), bool(a[i] == b[i]), total, size) for i in some]
        top = max(scores)
        return top, [named(i) for i, s in zip(some, scores) if s == top]

    def best(self) -> tuple[float, tuple[str, str]] | None:
        """Without a round, if the merges since the last one can't have changed what is best: no pair of at least its count shares a
        token with them (which also bounds every pair that they made)."""
        if self.new:
            if self.objective in LOCAL and self.alone:
                n = self.n.copy()
                n[self._at([self._key(p) for p in self.taken])] = 0
                found = self._best(n)
                if found and not any(self.dirty & set(p) for p in found[1]):
                    return found[0], min(found[1])
            self._sum()
        found = self._best(self.n)
        return found and (found[0], min(found[1]))

    def count(self, pair: tuple[str, str]) -> int:
        at = self._at([self._key(pair)])
        return int(self.n[at[0]]) if len(at) else 0

    def token(self, t: str) -> int:
        if self.new:
            self._sum()
        return int(self.uses[self.ids[t]])

    def _step(self, kind: int, t: str, parts: tuple[str, ...]) -> None:
        if t not in self.ids:
            self.ids[t] = len(self.names)
            self.names.append(t)
        self.steps.append((kind, self.ids[t], tuple(self.ids[x] for x in parts)))
        self.new += 1

    def merge(self, pair: tuple[str, str]) -> None:
        made = "".join(pair)
        # what a pair makes of itself, or adds to a type that there is, isn't bounded by another pair
        self.alone = self.alone and pair[0] != pair[1] and made not in self.ids
        self.dirty |= {*pair, made}
        self.taken.add(pair)
        self._step(1, made, pair)

    def split(self, t: str, parts: tuple[str, ...]) -> None:
        self.alone = False
        self._step(0, t, parts)


def _steps(
    sums: _Local | _Cluster, size: int, required: tuple[str, ...], picky: float | None, scaffold: bool, stop_ratio: float | None,
) -> Result:
    alphabet = sorted(set(required) | set(sums.alphabet()))
    result, letters = Result(alphabet, []), set(alphabet)
    history, first = [], None
    while len(result.types()) < size if picky or scaffold else len(alphabet) + len(result.merges) < size:
        found = sums.best()
        if found is None:
            break
        score, pair = found
        if stop_ratio is not None:
            history.append(score)
            if len(history) > 200:
                delta = abs(sum(history[-100:]) - sum(history[-200:-100])) / 100
                first = first or delta or 1.0
                if delta < stop_ratio * first:
                    break
        whole = []
        if picky is not None:
            n = sums.count(pair)
            whole = [t for t in dict.fromkeys(pair) if len(t) > 1 and t not in letters and (c := sums.token(t)) and n / c >= picky]
        result.merges.append(pair)
        result.events.append((True, pair))
        result.removed.discard("".join(pair))
        sums.merge(pair)
        for t in whole:
            parts = next(m for m in reversed(result.merges) if "".join(m) == t)
            result.events.append((False, parts))
            result.removed.add(t)
            sums.split(t, parts)
        if scaffold and (nxt := sums.best()):
            n = sums.count(nxt[1])
            result.removed.update(t for t in dict.fromkeys(pair) if len(t) > 1 and sums.token(t) < n)
    return result


def fit_words(
    words: list[tuple[str, int]], size: int, objective: str = "frequency", atomise=default_atoms, max_length: int = 64, required: tuple[str, ...] = (),
    picky: float | None = None, scaffold: bool = False, stop_ratio: float | None = None, least: int = 1,
) -> Result:
    """size: types wanted, alphabet included. Ties: larger score, then the smaller pair.

    picky: after a merge, a part is removed if the merge took at least this share of it. scaffold: a part left rarer than the next
    best pair is disabled in the result and doesn't count. stop_ratio: end when the best score's moving average changes by less
    than this share of its first change."""
    return _steps(_Local([(atomise(w), n) for w, n in words], objective, least, max_length), size, required, picky, scaffold, stop_ratio)


def fit(
    counts: DataFrame, size: int, driver_words: int = DRIVER_WORDS, atomise=default_atoms, max_length: int = 64, objective: str = "frequency", required: tuple[str, ...] = (),
    picky: float | None = None, scaffold: bool = False, stop_ratio: float | None = None, least: int = 1,
) -> Result:
    """counts (word, count) → merges, as fit_words. The number of distinct words is checked before anything is collected."""
    from tessera.sources.artifacts import checkpoint

    counts = checkpoint(counts.select("word", "count"))  # counted once for all that follows
    if counts.count() <= driver_words:
        words = sorted((r["word"], int(r["count"])) for r in counts.collect())
        return fit_words(words, size, objective, atomise, max_length, required, picky, scaffold, stop_ratio, least)
    return _steps(_Cluster(counts, objective, least, max_length, atomise), size, required, picky, scaffold, stop_ratio)


def merges_of_types(types: list[str], atomise=default_atoms) -> list[tuple[str, ...]]:
    """Merges that make the types in their order: each from what the earlier ones leave of it."""
    from tessera.operators.segment.bpe import classic

    merges: list[tuple[str, ...]] = []
    for t in types:
        if len(atomise(t)) > 1:
            parts = tuple(classic(merges, atomise)(t)) if merges else tuple(atomise(t))
            if len(parts) > 1:
                merges.append(parts)
    return merges


def trimmed(counts: DataFrame, result: Result, threshold: int, atomise=default_atoms) -> set[str]:
    """Merged types that occur at most `threshold` times when the words are segmented; never the alphabet."""
    used = counts.select(F.explode(column(decomposing(result.merges, frozenset(), atomise))(F.col("word"))).alias("type"), "count").groupBy("type").agg(F.sum("count").alias("n"))
    made = counts.sparkSession.createDataFrame([(t,) for t in result.types()[len(result.alphabet) :]], "type string")
    return {r[0] for r in made.join(used, "type", "left").where(F.coalesce("n", F.lit(0)) <= threshold).select("type").collect()}


def random_drop(counts: DataFrame, result: Result, top: int, k: int, seed: int = 0) -> set[str]:
    """k of the `top` commonest merged types, chosen by hash."""
    used = counts.select(F.explode(column(decomposing(result.merges, frozenset()))(F.col("word"))).alias("type"), "count").groupBy("type").agg(F.sum("count").alias("n"))
    some = used.where(~F.col("type").isin(result.alphabet)).orderBy(F.desc("n"), "type").limit(top)
    return {r[0] for r in some.orderBy(F.xxhash64(F.lit(seed), "type")).limit(k).select("type").collect()}
