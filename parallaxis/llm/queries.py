"""The queries of this subpackage, by the names under which the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parallaxis.llm.bpe import op3_bpe
from parallaxis.llm.collocations import op13_collocations
from parallaxis.llm.embeddings import op7_embeddings
from parallaxis.llm.fingerprints import op4_fingerprints
from parallaxis.llm.language_model import op9_language_model
from parallaxis.llm.licenses import op12_licenses
from parallaxis.llm.minhash import op1_minhash
from parallaxis.llm.packing import op6_packing
from parallaxis.llm.secrets import op10_secrets
from parallaxis.llm.sharding import op2_sharding
from parallaxis.llm.token_counts import op8_token_counts
from parallaxis.llm.toxicity import op5_toxicity
from parallaxis.llm.trie import op11_prefix_trie


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's result; its module stands at the top of the repository."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_minhash": op1_minhash,
        "op2_sharding": op2_sharding,
        "op3_bpe": op3_bpe,
        "op4_fingerprints": op4_fingerprints,
        "op5_toxicity": op5_toxicity,
        "op6_packing": op6_packing,
        "op7_embeddings": op7_embeddings,
        "op8_token_counts": op8_token_counts,
        "op9_language_model": op9_language_model,
        "op10_secrets": op10_secrets,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_licenses": op12_licenses,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    """No query here has an oracle: see the README for what each is tested against instead."""
    return {}
