"""Preprocessors that can be undone, and tokenisers: a preprocessor, a segmenter and a vocabulary under one name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import splitters as S
from tessera.functions import text as T
from tessera.functions.bytes import pseudo_table
from tessera.operators.segment import bpe, column, greedy, lattice, native
from tessera.operators.tokens import explode_tokens
from tessera.operators.vocab import to_ids


@dataclass(frozen=True)
class Preprocessor:
    """An irreversible mapper, a reversible one, and a splitter with its inverse. The alphabet is what pieces are written in, if that is
    known; the marker is what shows a word's edge in them."""

    irreversible: T.Map = T.identity
    reversible: T.Mapper = T.identity
    splitter: S.Split = S.whole
    unsplit: Callable[[Column], Column] = S.unsplit
    alphabet: tuple[str, ...] = ()
    marker: T.Marker | None = None

    def do(self, c: Column) -> Column:
        return self.splitter(self.reversible(self.irreversible(c)))

    def undo(self, tokens: Column) -> Column:
        """The text of the tokens, as the irreversible mapper left it."""
        return self.reversible.invert(self.unsplit(tokens))

    def undo_per_token(self, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: self.reversible.invert(self.unsplit(F.array(t))))


def alphabet_of(*parts: Preprocessor) -> tuple[str, ...]:
    """Of preprocessors one after the other: the last alphabet that one of them declares."""
    return next((p.alphabet for p in reversed(parts) if p.alphabet), ())


def marker_of(*parts: Preprocessor) -> T.Marker | None:
    return next((p.marker for p in reversed(parts) if p.marker), None)


PSEUDO_BYTES = tuple(pseudo_table())


@dataclass(frozen=True)
class Tokeniser:
    """name, preprocessor, and segment: a column of pretokens to a column of token lists."""

    name: str
    segment: Callable[[Column], Column]
    preprocessor: Preprocessor = field(default_factory=Preprocessor)

    def prepare_and_tokenise(self, c: Column) -> Column:
        """Text to tokens, row by row. For kernels in Python, `tokens` segments each distinct pretoken only once."""
        return F.flatten(F.transform(self.preprocessor.do(c), self.segment))

    def tokens(self, docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
        """(keep, pos, token): pretokens are segmented once each and joined back."""
        pieces = explode_tokens(docs, self.preprocessor.do(F.col(text)), *keep).withColumnRenamed("token", "pretoken")
        known = pieces.select("pretoken").distinct().withColumn("tokens", self.segment(F.col("pretoken")))
        both = pieces.join(known, "pretoken").select(*keep, F.col("pos").alias("word"), F.posexplode("tokens").alias("pos", "token"))
        return both

    def ids(self, docs: DataFrame, vocab: DataFrame, unk: int | None, text: str = "text", *keep: str) -> DataFrame:
        return to_ids(self.tokens(docs, text, *keep), vocab, unk)


def _kernel(kernel):
    return column(kernel)


#: Tokenisers by name, from what they need: merges, a set of types, or log probabilities.
FACTORIES: dict[str, Callable[..., Callable[[Column], Column]]] = {
    "bpe": lambda merges: _kernel(bpe.classic(merges)),
    "bpe_truncated": lambda merges, delta: _kernel(bpe.classic(bpe.truncated(merges, delta))),
    "bpe_bypassed": lambda merges, remove: _kernel(bpe.classic(bpe.bypassed(merges, remove))),
    "bpe_ensured": lambda merges, wanted: _kernel(bpe.classic(bpe.ensured(merges, wanted))),
    "left_greedy": lambda vocab: _kernel(greedy.left_greedy(vocab)),
    "right_greedy": lambda vocab: _kernel(greedy.right_greedy(vocab)),
    "longest_first": lambda vocab: _kernel(greedy.longest_first(vocab)),
    "least_tokens": lambda vocab: _kernel(lattice.least_tokens(vocab)),
    "unigram": lambda logp: _kernel(lattice.unigram(logp)),
    "characters": lambda: native.characters,
    "ngrams": lambda n: native.ngrams(n),
    "identity": lambda: lambda c: F.array(c),
}


def tokeniser(name: str, preprocessor: Preprocessor | None = None, **needs) -> Tokeniser:
    if name not in FACTORIES:
        raise ValueError(f"unknown tokeniser {name!r}: one of {', '.join(sorted(FACTORIES))}")
    return Tokeniser(name, FACTORIES[name](**needs), preprocessor or Preprocessor(splitter=S.on_whitespace()))
