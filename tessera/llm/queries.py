"""The queries that __spark_entry__ registers for this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = {
    "op1_mixing": "mixing",
    "op2_chat": "chat",
    "op3_sentencepiece": "pieces",
    "op4_sharding": "sharding",
    "op5_media": "media",
    "op6_suffix_dedup": "suffix",
    "op7_html": "html",
    "op8_quality": "quality",
    "op9_simhash": "simhash",
    "op10_embeddings": "embeddings",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tessera.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from tessera.llm import chat, embeddings, mixing, sharding

    return {"op1_mixing": mixing.SQL, "op2_chat": chat.SQL, "op4_sharding": sharding.sql(), "op10_embeddings": embeddings.SQL}
