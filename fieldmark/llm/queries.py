"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldmark.llm import alignment, ann, decontam, divergence, jaccard, langid, lm, mixing, pii, quality, sharding, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_ann": ann.op2_ann,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_warc": warc.op4_warc,
    "op5_decontam": decontam.op5_decontam,
    "op6_quality": quality.op6_quality,
    "op7_lm": lm.op7_lm,
    "op8_sharding": sharding.op8_sharding,
    "op9_pii": pii.op9_pii,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_alignment": alignment.op11_alignment,
    "op12_langid": langid.op12_langid,
    "op13_divergence": divergence.op13_divergence,
}

ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.ORACLE_SQL, "op3_jaccard": jaccard.ORACLE_SQL, "op4_warc": warc.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL}
