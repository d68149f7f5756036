"""Byte-pair inference and its variants over a merge list."""

from __future__ import annotations

import heapq


def atoms(word: str, marker: str = "", at_end: bool = True) -> list[str]:
    """Characters, a marker glued to the edge's character."""
    if marker and at_end and word.endswith(marker) and len(word) > len(marker):
        root = word[: -len(marker)]
        return [*root[:-1], root[-1] + marker]
    if marker and not at_end and word.startswith(marker) and len(word) > len(marker):
        root = word[len(marker) :]
        return [marker + root[0], *root[1:]]
    return list(word)


def ranks(merges: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    return {m: i for i, m in reversed(list(enumerate(merges)))}


def _apply(tokens: list[str], parts: tuple[str, ...]) -> list[str]:
    out, i, k = [], 0, len(parts)
    while i < len(tokens):
        if tuple(tokens[i : i + k]) == parts:
            out.append("".join(parts))
            i += k
        else:
            out.append(tokens[i])
            i += 1
    return out


def classic(merges: list[tuple[str, ...]], atomise=atoms):
    """The earliest applicable merge on all its places, left to right, until none applies. Merges may have more than two parts."""
    rank, sizes = ranks(merges), sorted({len(m) for m in merges})

    def run(word: str) -> list[str]:
        tokens = atomise(word)
        if sizes == [2] and len(tokens) > 32:
            return _long(tokens, rank)
        while len(tokens) > 1:
            found = [rank[t] for k in sizes for i in range(len(tokens) - k + 1) if (t := tuple(tokens[i : i + k])) in rank]
            if not found:
                break
            tokens = _apply(tokens, merges[min(found)])
        return tokens

    return run


def _long(tokens: list[str], rank: dict[tuple[str, ...], int]) -> list[str]:
    """As classic for pairs, with a heap over a linked list."""
    n = len(tokens)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := rank.get((tokens[i], tokens[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if not alive[i] or j >= n or tokens[i] != a or tokens[j] != b:
            continue
        tokens[i], alive[j], nxt[i] = a + b, False, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for x in (prv[i], i):
            y = nxt[x] if x >= 0 else n
            if x >= 0 and y < n and (r := rank.get((tokens[x], tokens[y]))) is not None:
                heapq.heappush(heap, (r, x, tokens[x], tokens[y]))
    return [t for t, a in zip(tokens, alive) if a]


def dropout(merges: list[tuple[str, ...]], p: float, atomise=atoms):
    """In every round each token but the last is passed over with probability p; the best merge that starts at another is
    applied once; the end is a round without any."""
    return guided(merges, lambda word, end: p, atomise=atomise)


def guided(merges: list[tuple[str, ...]], boundary, threshold: float | None = None, always_above: float = 1.0, atomise=atoms):
    """Dropout by the boundary probability at a token's last character: boundary(word, end offset). With a threshold, a token
    is passed over exactly if its probability reaches it."""
    rank = ranks(merges)

    def run(word: str, rng=None) -> list[str]:
        tokens = atomise(word)
        while len(tokens) > 1:
            best, end = None, 0
            for i in range(len(tokens) - 1):
                end += len(tokens[i])
                p = boundary(word, end)
                u = threshold if threshold is not None else rng.random()
                if u <= p or p > always_above:
                    continue
                r = rank.get((tokens[i], tokens[i + 1]))
                if r is not None and (best is None or r < best[0]):
                    best = (r, i)
            if best is None:
                break
            i = best[1]
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
        return tokens

    return run


def uniform_merges(merges: list[tuple[str, ...]], p: float, atomise=atoms):
    """Not the best but any applicable merge at random; stop with probability p before each."""
    rank = ranks(merges)

    def run(word: str, rng) -> list[str]:
        tokens = atomise(word)
        while True:
            places = [i for i in range(len(tokens) - 1) if (tokens[i], tokens[i + 1]) in rank]
            if not places or rng.random() < p:
                return tokens
            i = places[int(rng.integers(len(places)))]
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]

    return run


def first_parts(merges: list[tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for m in merges:
        out.setdefault("".join(m), m)
    return out


def breakdown(merges: list[tuple[str, ...]], p: float = 0.33, vocab: frozenset[str] | None = None, atomise=atoms):
    """Merges undone at random after BPE: by the type's own merge, or, given a vocabulary, at any split into two types."""
    whole, parts = classic(merges, atomise), first_parts(merges)

    def run(word: str, rng) -> list[str]:
        todo, out = whole(word)[::-1], []
        while todo:
            t = todo.pop()
            ways = [parts[t]] if vocab is None and t in parts else [(t[:i], t[i:]) for i in range(1, len(t)) if t[:i] in vocab and t[i:] in vocab] if vocab else []
            if ways and rng.random() < p:
                todo += reversed(ways[int(rng.integers(len(ways)))])
            else:
                out.append(t)
        return out

    return run


def decomposing(merges: list[tuple[str, ...]], disabled: frozenset[str], atomise=atoms):
    """BPE, then disabled types fall into the parts of their first merge, again and again (scaffold and trimmed BPE)."""
    whole, parts = classic(merges, atomise), first_parts(merges)

    def run(word: str) -> list[str]:
        todo, out = whole(word)[::-1], []
        while todo:
            t = todo.pop()
            if t in disabled and t in parts:
                todo += reversed(parts[t])
            else:
                out.append(t)
        return out

    return run


def events(log: list[tuple[bool, tuple[str, ...]]], atomise=atoms):
    """Replay of a log of merges (True, parts) and splits (False, parts), in order, on the tokens that the word has by then."""
    merge_at: dict[tuple[str, ...], list[int]] = {}
    split_at: dict[str, list[int]] = {}
    for i, (is_merge, parts) in enumerate(log):
        if is_merge:
            merge_at.setdefault(parts, []).append(i)
        else:
            split_at.setdefault("".join(parts), []).append(i)

    def run(word: str) -> list[str]:
        tokens, now = atomise(word), -1
        while True:
            soon = [i for a, b in zip(tokens, tokens[1:]) for i in merge_at.get((a, b), ()) if i > now] + [i for t in set(tokens) for i in split_at.get(t, ()) if i > now]
            if not soon:
                return tokens
            now = min(soon)
            is_merge, parts = log[now]
            tokens = _apply(tokens, parts) if is_merge else [x for t in tokens for x in (parts if t == "".join(parts) else (t,))]

    return run


def mergeless(ids: dict[str, int], atomise=atoms):
    """Without merges: join the neighbours whose concatenation is the type of the smallest id, the leftmost on ties."""

    def run(word: str) -> list[str]:
        tokens = atomise(word)
        while len(tokens) > 1:
            best = min(((ids[t], i) for i in range(len(tokens) - 1) if (t := tokens[i] + tokens[i + 1]) in ids), default=None)
            if best is None:
                break
            i = best[1]
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
        return tokens

    return run


def truncated(merges: list[tuple[str, ...]], delta: int) -> list[tuple[str, ...]]:
    return merges[: max(0, len(merges) - delta)]


def shuffled(merges: list[tuple[str, ...]], seed: int = 0, constrained: bool = True) -> list[tuple[str, ...]]:
    """Another order of the merges; constrained: parts that are themselves merged come first."""
    import numpy as np

    rng = np.random.default_rng(seed)
    order = [merges[i] for i in rng.permutation(len(merges))]
    if not constrained:
        return order
    made, out, rest = {"".join(m) for m in merges}, [], order
    done: set[str] = set()
    while rest:
        later = []
        for m in rest:
            if all(p not in made or p in done or len(p) == 1 for p in m):
                out.append(m)
                done.add("".join(m))
            else:
                later.append(m)
        rest = later
    return out


def bypassed(merges: list[tuple[str, ...]], remove: set[str]) -> list[tuple[str, ...]]:
    """Without the merges that form the given types; what used them takes their parts instead, so merges may get more parts."""
    parts = first_parts(merges)

    def flat(t: str) -> list[str]:
        return [x for p in parts[t] for x in flat(p)] if t in remove and t in parts else [t]

    return [tuple(x for p in m for x in flat(p)) for m in merges if "".join(m) not in remove]


def ensured(merges: list[tuple[str, ...]], wanted: list[str], forbidden: frozenset[str] = frozenset(), atomise=atoms) -> list[tuple[str, ...]]:
    """Merges grafted so that every wanted string becomes one token; as many of the latest unprotected ones go; forbidden types are bypassed."""
    merges = bypassed(merges, set(forbidden))
    n, kept = len(merges), set(wanted)
    for w in wanted:
        tokens = classic(merges, atomise)(w)
        while len(tokens) > 1:
            merges = [*merges, (tokens[0], tokens[1])]
            kept.add(tokens[0] + tokens[1])
            tokens[:2] = [tokens[0] + tokens[1]]
    used: set[str] = set()
    for m in merges:
        if "".join(m) in kept:
            used.update(m)
    while len(merges) > n:
        needed = {p for m in merges for p in m}
        at = next((i for i in range(len(merges) - 1, -1, -1) if "".join(merges[i]) not in kept | used and "".join(merges[i]) not in needed), None)
        if at is None:
            break
        merges = merges[:at] + merges[at + 1 :]
    return merges
