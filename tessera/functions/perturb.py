"""Seeded perturbations of text. Draws are keyed by the text, so they don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import Map, compose

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ROWS = (("qwertyuiop", 0.0), ("asdfghjkl", 0.25), ("zxcvbnm", 0.75))
PLACE = {c: (r, x + shift) for r, (row, shift) in enumerate(ROWS) for x, c in enumerate(row)}


def fixed_uniform(low: int, high: int):
    return lambda n, rng: rng.choice(n, size=min(n, int(rng.integers(low, high + 1))), replace=False) if n else np.zeros(0, int)


def constant(k: int):
    return lambda n, rng: rng.choice(n, size=min(n, k), replace=False) if n else np.zeros(0, int)


def proportional(p: float):
    return lambda n, rng: np.flatnonzero(rng.random(n) < p)


def geometric(p: float, most: int):
    return lambda n, rng: rng.choice(n, size=min(n, most, int(rng.geometric(p)) - 1), replace=False) if n else np.zeros(0, int)


def gobble(p: float, key: str, seed: int = 0) -> Map:
    from tessera.operators.tokens import by_hash

    return lambda c: F.when(by_hash(F.col(key), seed) < p, F.lit("")).otherwise(c)


def fixed_truncate(start: int, end: int) -> Map:
    return lambda c: F.substring(c, F.lit(start + 1), F.greatest(F.lit(0), F.length(c) - start - end))


def _kernel(p: float, sampler, edit: Callable[[list[str], np.ndarray, np.random.Generator], list[str]], seed: int, extra: int = 0) -> Map:
    def run(texts: pa.Array) -> pa.Array:
        import zlib

        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            rng = np.random.Generator(np.random.PCG64([seed, zlib.crc32(t.encode()), len(t)]))
            out.append("".join(edit(list(t), np.sort(sampler(len(t) + extra, rng)), rng)) if rng.random() < p else t)
        return pa.array(out, pa.string())

    return lambda c: F.arrow_udf(run, "string")(c)


def _sampler(rate):
    return proportional(rate) if isinstance(rate, float) else rate


def pop(p: float, rate, seed: int = 1) -> Map:
    """Sampled characters go."""

    def edit(s: list[str], at: np.ndarray, rng: np.random.Generator) -> list[str]:
        keep = np.ones(len(s), bool)
        keep[at] = False
        return [c for c, k in zip(s, keep.tolist()) if k]

    return _kernel(p, _sampler(rate), edit, seed)


def _insert(s: list[str], at: np.ndarray, rng: np.random.Generator) -> list[str]:
    new = dict(zip(at.tolist(), rng.integers(26, size=len(at)).tolist()))
    return [x for i in range(len(s) + 1) for x in ([LETTERS[new[i]]] if i in new else []) + s[i : i + 1]]


def insert(p: float, rate, seed: int = 2) -> Map:
    """A random letter before sampled characters, or at the end."""
    return _kernel(p, _sampler(rate), _insert, seed, 1)


def _substitute(s: list[str], at: np.ndarray, rng: np.random.Generator) -> list[str]:
    for i, k in zip(at.tolist(), rng.integers(26, size=len(at)).tolist()):
        s[i] = LETTERS[k]
    return s


def substitute(p: float, rate, seed: int = 3) -> Map:
    return _kernel(p, _sampler(rate), _substitute, seed)


def keyboard_typos(p: float, rate, temperature: float = 1.0, seed: int = 4) -> Map:
    """Sampled letters become others, near keys likelier (softmax of minus the distance); case stays."""
    keys = sorted(PLACE)
    near = {}
    for c in keys:
        d = np.array([np.hypot(PLACE[c][0] - PLACE[k][0], PLACE[c][1] - PLACE[k][1]) for k in keys])
        w = np.where(d > 0, np.exp(-d / temperature), 0)
        near[c] = w / w.sum()

    def edit(s: list[str], at: np.ndarray, rng: np.random.Generator) -> list[str]:
        for i in at.tolist():
            low = s[i].lower()
            if low in near:
                new = keys[int(rng.choice(len(keys), p=near[low]))]
                s[i] = new.upper() if s[i].isupper() else new
        return s

    return _kernel(p, _sampler(rate), edit, seed)


def series(*maps: Map) -> Map:
    return compose(*maps)


def one_of(key: str, *maps: Map, seed: int = 5) -> Map:
    """Exactly one of the maps, by the key's hash."""

    def run(c: Column) -> Column:
        k = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(maps)))
        out = maps[-1](c)
        for i, m in enumerate(maps[:-1]):
            out = F.when(k == i, m(c)).otherwise(out)
        return out

    return run
