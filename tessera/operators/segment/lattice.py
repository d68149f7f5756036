"""Segmentation lattices: Viterbi with several objectives, unigram scores, trees, and random segmentations."""

from __future__ import annotations

import math

NEVER = float("-inf")


def viterbi(score, max_step: int, n_objectives: int, accumulate):
    """Best path; score(word, i, j) gives a tuple per step or None where it isn't allowed, accumulate joins it to the path's.

    Larger tuples are better; of equal ones the earliest predecessor stays. A word without a path falls into characters."""

    def run(word: str) -> list[str]:
        n = len(word)
        best: list = [None] * (n + 1)
        back = [-1] * (n + 1)
        for i in range(n):
            if i and best[i] is None:
                continue
            for j in range(i + 1, min(n, i + max_step) + 1):
                s = score(word, i, j)
                if s is None:
                    continue
                new = s if best[i] is None else accumulate(best[i], s)
                if best[j] is None or new > best[j]:
                    best[j], back[j] = new, i
        if n and best[n] is None:
            return list(word)
        out, j = [], n
        while j:
            out.append(word[back[j] : j])
            j = back[j]
        return out[::-1]

    return run


def _longest(types) -> int:
    return max(map(len, types), default=1)


def least_tokens(vocab: frozenset[str], max_step: int | None = None):
    """Fewest tokens; of these, the one with the longest token. Steps reach as far as the longest type, unless said otherwise."""
    return viterbi(lambda w, i, j: (-1, j - i) if w[i:j] in vocab else None, max_step or _longest(vocab), 2, lambda a, b: (a[0] + b[0], max(a[1], b[1])))


def longest_product(vocab: frozenset[str], max_step: int | None = None):
    """The largest product of token lengths."""
    return viterbi(lambda w, i, j: (j - i,) if w[i:j] in vocab else None, max_step or _longest(vocab), 1, lambda a, b: (a[0] * b[0],))


def unigram(logp: dict[str, float], max_step: int | None = None):
    """The largest sum of log probabilities."""
    return viterbi(lambda w, i, j: (logp[w[i:j]],) if w[i:j] in logp else None, max_step or max(map(len, logp), default=1), 1, lambda a, b: (a[0] + b[0],))


def k_best(word: str, logp: dict[str, float], k: int) -> list[tuple[float, list[str]]]:
    """The k likeliest segmentations with their log probabilities, likeliest first; earlier cuts first on ties."""
    most = _longest(logp)
    ways: list[list[tuple[float, tuple[int, ...]]]] = [[(0.0, ())]] + [[] for _ in word]
    for j in range(1, len(word) + 1):
        new = [(s + p, cuts + (j,)) for i in range(max(0, j - most), j) if (p := logp.get(word[i:j])) is not None for s, cuts in ways[i]]
        ways[j] = sorted(new, key=lambda x: (-x[0], x[1]))[:k]
    return [(s, [word[a:b] for a, b in zip((0, *cuts), cuts)]) for s, cuts in ways[-1]]


def unigram_sampled(logp: dict[str, float], k: int = 16, power: float = 1.0):
    """One of the k likeliest segmentations, drawn by its probability to the power; without any, characters."""

    def run(word: str, rng) -> list[str]:
        best = k_best(word, logp, k)
        if not best:
            return list(word)
        weight = [math.exp(power * (s - best[0][0])) for s, _ in best]
        u = rng.random() * sum(weight)
        for w, (_, tokens) in zip(weight, best):
            u -= w
            if u <= 0:
                return tokens
        return best[-1][1]

    return run


def grid(score, word: str, most: int) -> list[list]:
    """score(word, i, j) of every step: row i, column j - i - 1, None where it isn't allowed."""
    return [[score(word, i, j) for j in range(i + 1, min(len(word), i + most) + 1)] for i in range(len(word))]


def to_probabilities(cells: list[list]) -> list[list]:
    return [[None if s is None else math.exp(s) for s in row] for row in cells]


def with_strings(cells: list[list], word: str) -> list[list]:
    """Each step's score with its string."""
    return [[None if s is None else (s, word[i : i + k + 1]) for k, s in enumerate(row)] for i, row in enumerate(cells)]


def discretised(cells: list[list], low: float, high: float, levels: int) -> list[list]:
    """Scores in [low, high) on so many equally spaced values from low to high, by buckets of equal width; others stay."""
    def one(s):
        if s is None or not low <= s < high:
            return s
        return low + (high - low) / (levels - 1) * min(levels - 1, int((s - low) / (high - low) * levels))

    return [[one(s) for s in row] for row in cells]


def of_grid(build, most: int):
    """A segmenter over a grid: build(word) gives the cells; the largest sum wins."""
    memo: dict = {}

    def score(w: str, i: int, j: int):
        if memo.get("w") != w:
            memo.clear()
            memo.update(w=w, g=build(w))
        s = memo["g"][i][j - i - 1]
        return None if s is None else (s,)

    return viterbi(score, most, 1, lambda a, b: (a[0] + b[0],))


def gold_boundary(gold: dict[str, list[str]], shift: int = 0):
    """A classifier of characters that knows the answer: 1 at the last character of each morph but the last, moved by the mark's length."""

    def run(word: str) -> list[float]:
        p, at = [0.0] * len(word), shift - 1
        for t in gold.get(word[shift:], [])[:-1]:
            at += len(t)
            p[at] = 1.0
        return p

    return run


def least_then_probable(logp: dict[str, float], max_step: int | None = None):
    return viterbi(lambda w, i, j: (-1, logp[w[i:j]]) if w[i:j] in logp else None, max_step or _longest(logp), 2, lambda a, b: (a[0] + b[0], a[1] + b[1]))


def probable_then_least(logp: dict[str, float], levels: int = 10, max_step: int | None = None):
    """Log probabilities in so many equal steps, then the fewest tokens."""
    low, high = min(logp.values()), max(logp.values())
    step = (high - low) / levels or 1.0
    level = {t: -int((high - p) / step) for t, p in logp.items()}
    return viterbi(lambda w, i, j: (level[w[i:j]], -1) if w[i:j] in level else None, max_step or _longest(logp), 2, lambda a, b: (a[0] + b[0], a[1] + b[1]))


def boundary_sum(vocab: frozenset[str] | None, boundary, transform=lambda p: 2 * p - 1, inner: bool = False, product: bool = False, at_least: bool = False, max_step: int | None = None):
    """Maximises the transformed boundary probabilities at chosen cuts (inner: and of the complements inside the tokens).

    boundary(word) gives a probability after each character. vocab None allows any token; at_least allows prefixes of types."""
    prefixes = {t[:k] for t in vocab for k in range(1, len(t) + 1)} if at_least and vocab is not None else vocab
    memo: dict = {}

    def score(w: str, i: int, j: int):
        if prefixes is not None and w[i:j] not in prefixes:
            return None
        if memo.get("w") != w:
            memo.clear()
            memo.update(w=w, p=boundary(w))
        p = memo["p"]
        s = transform(p[j - 1]) if j < len(w) else (1.0 if product else 0.0)
        if inner:
            for k in range(i, j - 1):
                s = s * transform(1 - p[k]) if product else s + transform(1 - p[k])
        return (s,)

    most = max_step or (_longest(vocab) if vocab is not None else 1 << 30)
    return viterbi(score, most, 1, (lambda a, b: (a[0] * b[0],)) if product else (lambda a, b: (a[0] + b[0],)))


def top_down(vocab: frozenset[str], boundary):
    """Split at the likeliest boundary until every part is a type or one character."""

    def run(word: str) -> list[str]:
        p, out, todo = boundary(word), [], [(0, len(word))]
        while todo:
            i, j = todo.pop()
            if j - i <= 1 or word[i:j] in vocab:
                out.append((i, j))
                continue
            k = max(range(i + 1, j), key=lambda x: (p[x - 1], -x))
            todo += [(k, j), (i, k)]
        return [word[i:j] for i, j in out if j > i]

    return run


def path_counts(word: str, allowed) -> list[int]:
    """Ways to reach every offset from the left."""
    ways = [1] + [0] * len(word)
    for j in range(1, len(word) + 1):
        ways[j] = sum(ways[i] for i in range(j) if ways[i] and allowed(word[i:j]))
    return ways


def all_segmentations(word: str, vocab: frozenset[str]):
    """Every way to write the word as types."""
    if not word:
        yield []
    for j in range(1, len(word) + 1):
        if word[:j] in vocab:
            for rest in all_segmentations(word[j:], vocab):
                yield [word[:j], *rest]


def uniform(word: str, rng) -> list[str]:
    """Every position is a cut with probability a half: uniform over all segmentations."""
    if not word:
        return []
    cuts = [0, *(i for i, u in enumerate(rng.random(max(0, len(word) - 1)), 1) if u < 0.5), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def by_path_counts(vocab: frozenset[str], temperature: float = 1.0, least: int = 1):
    """Random path, backwards by the number of paths that reach each predecessor, raised to 1 / temperature.

    At temperature 1 every segmentation is equally likely. Without a path the word falls into characters."""

    def run(word: str, rng) -> list[str]:
        ways = path_counts(word, lambda t: t in vocab and len(t) >= least)
        if not ways[-1]:
            ways = path_counts(word, vocab.__contains__)
        if not ways[-1]:
            return list(word)
        out, j = [], len(word)
        while j:
            steps = [i for i in range(j) if ways[i] and word[i:j] in vocab and (len(word[i:j]) >= least or least == 1 or ways[-1])]
            logs = [math.log(ways[i]) / temperature for i in steps]
            top = max(logs)
            weight = [math.exp(x - top) for x in logs]
            u = rng.random() * sum(weight)
            for i, w in zip(steps, weight):
                u -= w
                if u <= 0:
                    break
            out.append(word[i:j])
            j = i
        return out[::-1]

    return run


def joint_probability(word: str, tokens: list[str], vocab: frozenset[str]) -> float:
    """Of a segmentation under by_path_counts at temperature 1."""
    ways = path_counts(word, vocab.__contains__)
    p, j = 1.0, len(word)
    for t in reversed(tokens):
        total = sum(ways[i] for i in range(j) if word[i:j] in vocab)
        p *= ways[j - len(t)] / total
        j -= len(t)
    return p


def rejection(vocab: frozenset[str], backoff: tuple[float, ...] = (0.05, 0.1, 0.25), tries: int = 5000):
    """Cuts at random, kept if every part is a type; rarer cuts first; characters if nothing is found."""

    def run(word: str, rng) -> list[str]:
        for p in backoff:
            for u in rng.random((max(1, tries // 16), 16, max(0, len(word) - 1))):
                for row in u:
                    cuts = [0, *(i for i, x in enumerate(row, 1) if x < p), len(word)]
                    parts = [word[a:b] for a, b in zip(cuts, cuts[1:])]
                    if all(t in vocab for t in parts):
                        return parts
        return list(word)

    return run


def uniform_by_enumeration(vocab: frozenset[str]):
    """Counts all segmentations and takes one of them by its number."""

    def run(word: str, rng) -> list[str]:
        ways = path_counts(word, vocab.__contains__)
        if not ways[-1]:
            return list(word)
        k, out, j = int(rng.random() * ways[-1]), [], len(word)
        while j:
            for i in range(j):
                if ways[i] and word[i:j] in vocab:
                    if k < ways[i]:
                        break
                    k -= ways[i]
            out.append(word[i:j])
            j = i
        return out[::-1]

    return run


def random_splits(base, vocab: frozenset[str], proportion: float):
    """As many draws of a token as the proportion of tokens; a token that can be cut into two types is, anywhere it can."""

    def run(word: str, rng) -> list[str]:
        tokens = list(base(word))
        for _ in range(int(len(tokens) * proportion)):
            i = int(rng.integers(len(tokens)))
            t = tokens[i]
            ways = [k for k in range(1, len(t)) if t[:k] in vocab and t[k:] in vocab]
            if ways:
                k = ways[int(rng.integers(len(ways)))]
                tokens[i : i + 1] = [t[:k], t[k:]]
        return tokens

    return run


class Graph:
    """A segmentation graph: for each node the nodes it leads to (later ones), with scores."""

    def __init__(self, pointers: list[list[int]], scores: list[list[float]] | None = None):
        self.pointers = pointers
        self.scores = scores or [[1.0] * len(p) for p in pointers]

    def total_paths(self) -> int:
        ways = [0] * len(self.pointers)
        ways[-1] = 1
        for i in range(len(ways) - 2, -1, -1):
            ways[i] = sum(ways[j] for j in self.pointers[i])
        return ways[0]

    def sample(self, rng) -> tuple[list[int], float]:
        """(path, its probability)."""
        path, p, i = [0], 1.0, 0
        while self.pointers[i]:
            s = self.scores[i]
            k = int(rng.choice(len(s), p=[x / sum(s) for x in s]))
            p *= s[k] / sum(s)
            i = self.pointers[i][k]
            path.append(i)
        return path, p

    def probability(self, path: list[int]) -> float:
        p = 1.0
        for a, b in zip(path, path[1:]):
            p *= self.scores[a][self.pointers[a].index(b)] / sum(self.scores[a])
        return p

    def adjacency(self) -> list[list[int]]:
        n = len(self.pointers)
        return [[int(j in self.pointers[i]) for j in range(n)] for i in range(n)]
