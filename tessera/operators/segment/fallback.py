"""Byte fallback for what a vocabulary can't write."""

from __future__ import annotations


def byte_fallback(base, vocab: frozenset[str]):
    """Tokens of the base segmenter; those that aren't types become their bytes' tokens."""

    def run(word: str) -> list[str]:
        return [x for t in base(word) for x in ([t] if t in vocab else [f"[BYTE {b}]" for b in t.encode()])]

    return run


def aligned_unknowns(word: str, tokens: list[str | None]) -> list[str]:
    """Tokens with None for unknown stretches → the strings that those cover: each at least one character, earlier ones as short
    as the known tokens allow. Neighbouring unknowns are one."""
    parts: list[str | None] = []
    for t in tokens:
        if t is not None or not parts or parts[-1] is not None:
            parts.append(t)
    reach: dict[tuple[int, int], int] = {}

    def fits(k: int, at: int) -> bool:
        if k == len(parts):
            return at == len(word)
        t = parts[k]
        if t is not None:
            ok = word.startswith(t, at) and fits(k + 1, at + len(t))
            reach[k, at] = len(t) if ok else 0
            return ok
        for n in range(1, len(word) - at + 1):
            if fits(k + 1, at + n):
                reach[k, at] = n
                return True
        return False

    if not fits(0, 0):
        raise ValueError("the tokens don't fit the word")
    out, at = [], 0
    for k in range(len(parts)):
        n = reach[k, at]
        out.append(word[at : at + n])
        at += n
    return out
