"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ladle.llm import op1_warc, op2_rules, op3_licenses, op4_jaccard, op5_mixing, op6_quality, op7_tokens, op8_decontaminate, op9_urls, op10_token_ids, op11_syncmers, op12_divergence, op13_centroids, pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc.op1_warc,
        "op2_quality_rules": op2_rules.op2_quality_rules,
        "op3_license_scan": op3_licenses.op3_license_scan,
        "op4_jaccard_join": op4_jaccard.op4_jaccard_join,
        "op5_mixing": op5_mixing.op5_mixing,
        "op6_quality": op6_quality.op6_quality,
        "op7_token_counts": op7_tokens.op7_token_counts,
        "op8_decontaminate": op8_decontaminate.op8_decontaminate,
        "op9_url_filter": op9_urls.op9_url_filter,
        "op10_token_ids": op10_token_ids.op10_token_ids,
        "op11_syncmers": op11_syncmers.op11_syncmers,
        "op12_divergence": op12_divergence.op12_divergence,
        "op13_centroids": op13_centroids.op13_centroids,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": op1_warc.SQL, "op3_license_scan": op3_licenses.SQL, "op5_mixing": op5_mixing.SQL, "op9_url_filter": op9_urls.SQL, "op11_syncmers": op11_syncmers.SQL,
        "op12_divergence": op12_divergence.SQL, "op13_centroids": op13_centroids.SQL,
    }
