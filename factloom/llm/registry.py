"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from factloom.llm import bpe, embeddings, language, lines, media, minhash, oracle, packing, quality, token_file, toxicity
from factloom.llm._common import reachable

_QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_lines": lines.op2_lines,
    "op3_minhash": minhash.op3_minhash,
    "op4_language": language.op4_language,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_media": media.op6_media,
    "op7_token_file": token_file.op7_token_file,
    "op8_bpe": bpe.op8_bpe,
    "op9_quality": quality.op9_quality,
    "op10_embeddings": embeddings.op10_embeddings,
    "pipeline": corpus_pipeline.run,
}


def queries() -> dict:
    return {name: _ready(query) for name, query in _QUERIES.items()}


def _ready(query):
    return lambda spark, sf_dir: query(reachable(spark), sf_dir)


def oracle_sql() -> dict[str, str]:
    found = {"op3_minhash": oracle.OP3, "op10_embeddings": oracle.OP10}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
