"""Segmenters: kernels over one pretoken, and `column`, which runs a kernel over a string column in Arrow batches.

A deterministic kernel is `kernel(word) -> list of tokens`. A stochastic one is `kernel(word, rng)`; its generator is seeded by
the row's key, so that a result depends neither on partitioning nor on order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def column(kernel: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """Column -> array<string>; each distinct word of a batch is segmented once. Null gives null."""

    @F.arrow_udf("array<string>")
    def run(words: pa.Array) -> pa.Array:
        d = words.dictionary_encode()
        done = [None if w is None else kernel(w) for w in d.dictionary.to_pylist()]
        return pa.array([None if i is None else done[i] for i in d.indices.to_pylist()], pa.list_(pa.string()))

    return run


def stochastic_column(kernel: Callable[[str, np.random.Generator], list[str]], seed: int = 0) -> Callable[[Column, Column], Column]:
    """(word, key) -> array<string>; key is a whole number that names the draw."""

    @F.arrow_udf("array<string>")
    def run(words: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for w, k in zip(words.to_pylist(), keys.to_pylist()):
            rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, (k or 0) & (2**64 - 1)])))
            out.append(None if w is None else kernel(w, rng))
        return pa.array(out, pa.list_(pa.string()))

    return lambda word, key: run(word, key.cast("long"))
