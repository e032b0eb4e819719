"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import ann, bpe, centroids, decontaminate, divergence, jaccard, langid, lm, pii, quality, suffix, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_ann": ann.op2_ann,
        "op3_pii": pii.op3_pii,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_bpe": bpe.op5_bpe,
        "op6_langid": langid.op6_langid,
        "op7_warc": warc.op7_warc,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_suffix_dedup": suffix.op9_suffix_dedup,
        "op10_jaccard": jaccard.op10_jaccard,
        "op11_centroids": centroids.op11_centroids,
        "op12_divergence": divergence.op12_divergence,
        "op13_lm": lm.op13_lm,
    }


def oracle_sql() -> dict[str, str]:
    """The other queries are tested against brute force, round trips or held-out labels in tests/llm."""
    return {"op2_ann": ann.OP2_SQL, "op7_warc": warc.OP7_SQL, "op9_suffix_dedup": suffix.OP9_SQL, "op10_jaccard": jaccard.OP10_SQL, "op11_centroids": centroids.OP11_SQL, "op12_divergence": divergence.OP12_SQL}
