"""Greedy segmenters over a set of types. An unknown character is a token of its own, unless said otherwise."""

from __future__ import annotations


def left_greedy(vocab: frozenset[str]):
    """Longest prefix first (also the inference of an LZW vocabulary)."""
    most = max(map(len, vocab), default=1)

    def run(word: str) -> list[str]:
        out, i, n = [], 0, len(word)
        while i < n:
            for k in range(min(most, n - i), 0, -1):
                if word[i : i + k] in vocab:
                    break
            else:
                k = 1
            out.append(word[i : i + k])
            i += k
        return out

    return run


def left_lazy(vocab: frozenset[str]):
    """Grow a token while it stays a type one character further on."""

    def run(word: str) -> list[str]:
        out, i, n = [], 0, len(word)
        while i < n:
            k = 0
            while i + k < n and word[i : i + k + 1] in vocab:
                k += 1
            k = max(k, 1)
            out.append(word[i : i + k])
            i += k
        return out

    return run


def mirrored(kernel, vocab: frozenset[str]):
    """The kernel from right to left: on reversed words over reversed types."""
    inner = kernel(frozenset(v[::-1] for v in vocab))
    return lambda word: [t[::-1] for t in reversed(inner(word[::-1]))]


def right_greedy(vocab: frozenset[str]):
    return mirrored(left_greedy, vocab)


def right_lazy(vocab: frozenset[str]):
    return mirrored(left_lazy, vocab)


def _prefix(word: str, a: int, b: int, vocab: frozenset[str]) -> int:
    for e in range(b, a, -1):
        if word[a:e] in vocab:
            return e
    raise ValueError(f"character not in the vocabulary: {word[a]!r}")


def _suffix(word: str, a: int, b: int, vocab: frozenset[str]) -> int:
    for s in range(a, b):
        if word[s:b] in vocab:
            return s
    raise ValueError(f"character not in the vocabulary: {word[b - 1]!r}")


def alternating(vocab: frozenset[str], start_left: bool = True):
    """Longest prefix, then longest suffix of the rest, in turns; an unknown character is an error."""

    def run(word: str) -> list[str]:
        a, b, left, head, tail = 0, len(word), start_left, [], []
        while a < b:
            if left:
                e = _prefix(word, a, b, vocab)
                head.append(word[a:e])
                a = e
            else:
                s = _suffix(word, a, b, vocab)
                tail.append(word[s:b])
                b = s
            left = not left
        return head + tail[::-1]

    return run


def both_ends(vocab: frozenset[str], prefer_left: bool = True):
    """The longer of the longest prefix and the longest suffix, again and again; an unknown character is an error."""

    def run(word: str) -> list[str]:
        a, b, head, tail = 0, len(word), [], []
        while a < b:
            e, s = _prefix(word, a, b, vocab), _suffix(word, a, b, vocab)
            if e - a > b - s or (e - a == b - s and prefer_left):
                head.append(word[a:e])
                a = e
            else:
                tail.append(word[s:b])
                b = s
        return head + tail[::-1]

    return run


def pair_passes(vocab: frozenset[str]):
    """Passes from the left that merge a token with the next wherever the result is a type, until none does."""

    def run(word: str) -> list[str]:
        tokens = list(word)
        while True:
            out = []
            for t in tokens:
                if out and out[-1] + t in vocab:
                    out[-1] += t
                else:
                    out.append(t)
            if len(out) == len(tokens):
                return out
            tokens = out

    return run


def best_first(scores: dict[str, float]):
    """The substring of the highest score anywhere in the word, then the same on both sides; longer, then left, on ties."""
    most = max(map(len, scores), default=1)
    top = [float("-inf")] * (most + 1)
    for t, s in scores.items():
        top[len(t)] = max(top[len(t)], s)
    for k in range(1, most + 1):
        top[k] = max(top[k], top[k - 1])

    def run(word: str) -> list[str]:
        out, todo = [], [word]
        while todo:
            w = todo.pop()
            if not w:
                continue
            best, where = float("-inf"), None
            for k in range(min(len(w), most), 0, -1):
                for i in range(len(w) - k + 1):
                    s = scores.get(w[i : i + k])
                    if s is not None and s > best:
                        best, where = s, (i, k)
                if where and top[k - 1] < best:
                    break
            if where is None:
                out.extend(w)
                continue
            i, k = where
            if i == 0:
                out.append(w[:k])
                todo.append(w[k:])
            else:
                todo += [w[i + k :], w[i : i + k], w[:i]]
        return out

    return run


def longest_first(vocab: frozenset[str]):
    return best_first({t: len(t) for t in vocab})


def youngest_first(merges: list[tuple[str, ...]], alphabet: frozenset[str]):
    """The type made by the latest merge first; characters last."""
    return best_first({a: -1.0 for a in alphabet} | {"".join(m): float(i) for i, m in enumerate(merges)})


def lookup(table: dict[str, list[str]], default_unk: bool = True):
    return lambda word: table.get(word, [""] if default_unk else [word])


def syllables(vowels: str = "aeıioöuüâîû"):
    """Turkish syllables from the right: the first of CVCC, VCC, CVC, VC, CV, V that fits, else a lone consonant."""
    shapes = ("CVCC", "VCC", "CVC", "VC", "CV", "V")

    def run(word: str) -> list[str]:
        kinds, out, b = "".join("V" if c in vowels else "C" for c in word), [], len(word)
        while b > 0:
            k = next((len(s) for s in shapes if b >= len(s) and kinds[b - len(s) : b] == s), 1)
            out.append(word[b - k : b])
            b -= k
        return out[::-1]

    return run


def derivations(stems: frozenset[str], prefixes: tuple[str, ...], suffixes: tuple[str, ...]):
    """English derivation: strip suffixes, then prefixes, until what is left is a stem, undoing e-drop, doubling and y to i."""

    def repaired(w: str) -> list[str]:
        out = [w, w + "e"]
        if len(w) > 2 and w[-1] == w[-2]:
            out.append(w[:-1])
        if w.endswith("i"):
            out.append(w[:-1] + "y")
        if w.endswith("abil"):
            out.append(w[:-2] + "le")
        if w.endswith("ific"):
            out.append(w[:-2] + "y")
        return out

    def stem(w: str) -> bool:
        return any(x in stems for x in repaired(w))

    def run(word: str) -> list[str]:
        head, tail, w = [], [], word
        while w and not stem(w):
            s = next((s for s in sorted(suffixes, key=len, reverse=True) if w.endswith(s) and len(w) > len(s) + 1), None)
            p = next((p for p in sorted(prefixes, key=len, reverse=True) if w.startswith(p) and len(w) > len(p) + 1), None)
            if s:
                w = w[: -len(s)]
                tail.append(s)
            elif p:
                w = w[len(p) :]
                head.append(p)
            else:
                return [word]
        return head + ([w] if w else []) + tail[::-1]

    return run
