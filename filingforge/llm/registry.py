"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, merkle, packing, pieces, secrets, sharding, simhash, substring, topk, trie, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Queries by name."""
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_secrets": secrets.op1_secrets,
        "op2_packing": packing.op2_packing,
        "op3_simhash": simhash.op3_simhash,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_language": language.op5_language,
        "op6_topk": topk.op6_topk,
        "op7_sharding": sharding.op7_sharding,
        "op8_substring": substring.op8_substring,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_warc": warc.op10_warc,
        "op11_trie": trie.op11_trie,
        "op12_sentencepiece": pieces.op12_sentencepiece,
        "op13_merkle": merkle.op13_merkle,
    }


def oracles() -> dict[str, str]:
    """DuckDB SQL by query name, the pipeline's where it has one."""
    import corpus_pipeline

    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return own | {
        "op4_decontamination": decontaminate.ORACLE_SQL,
        "op6_topk": topk.ORACLE_SQL,
        "op8_substring": substring.ORACLE_SQL,
        "op9_url_filter": url_filter.ORACLE_SQL,
        "op10_warc": warc.ORACLE_SQL,
        "op11_trie": trie.ORACLE_SQL,
        "op13_merkle": merkle.ORACLE_SQL,
    }
