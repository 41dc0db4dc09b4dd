"""Queries of this subpackage and their DuckDB texts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, embeddings, secrets
from .alignment import op11_alignment
from .byte_bpe import op1_byte_bpe
from .embeddings import op5_embeddings
from .fingerprints import op7_fingerprints
from .language_id import op10_language_id
from .language_model import op6_language_model
from .mixing import op9_mixing
from .near_dup import op4_minhash
from .secrets import op2_secrets
from .token_counts import op12_token_counts
from .toxicity import op8_toxicity
from .whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_secrets": op2_secrets,
    "op3_chat": chat.op3_chat,
    "op4_minhash": op4_minhash,
    "op5_embeddings": op5_embeddings,
    "op6_language_model": op6_language_model,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_alignment": op11_alignment,
    "op12_token_counts": op12_token_counts,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op2_secrets": secrets.ORACLE,
    "op3_chat": chat.ORACLE,
    "op5_embeddings": embeddings.ORACLE,
}
