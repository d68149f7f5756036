"""Ready-made preprocessing pipelines, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from tessera.functions import splitters as S
from tessera.functions import text as T
from tessera.functions.bytes import latin_bytes, pseudo_bytes


def prefab(name: str, marker: T.Marker = T.ROBERTA, limit: int = 1_000_000) -> Callable[[Column], Column]:
    """String column → array<string>: truncation and normalisation, then the splitters in order."""
    before = T.compose(T.truncate_at_blank(limit), T.normalise())
    excluded = S.isolate_punctuation("excluded")
    steps = {
        "traditional": [S.on_whitespace(), S.isolate_punctuation("excluded")],
        "modern_english": [excluded, S.on_whitespace(), S.isolate_contractions(), S.mapped(pseudo_bytes()), S.add_word_boundary(marker), S.isolate_digits, S.isolate_punctuation("only")],
        "prefab2": [excluded, S.on_whitespace(), S.isolate_contractions(), S.polarise_apostrophes(), S.add_word_boundary(marker), S.group_digits(3), S.isolate_connecting_hyphens, S.add_capital_marker(marker)],
        "sentencepiece": [excluded, S.on_whitespace(), S.isolate_contractions(), S.add_word_boundary(T.PREFIX_SPACE), S.isolate_punctuation("only"), S.isolate_digits, S.mapped(latin_bytes()), S.mapped(T.replace("Ġ", " "))],
        "roberta": [S.isolate_punctuation("included", True, T.Side.START), S.into_space_prefixed(), S.mapped(pseudo_bytes())],
        "whitespace": [S.on_whitespace_marked(marker)],
    }[name]
    return lambda c: S.sequence(*steps)(before(c))
