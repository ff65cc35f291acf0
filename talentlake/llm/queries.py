"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentlake.llm.bpe import op4_bpe_codec
from talentlake.llm.centroids import op13_centroids
from talentlake.llm.chat import op10_chat_formatting
from talentlake.llm.decontaminate import op9_decontamination
from talentlake.llm.gam import op5_quality_classifier
from talentlake.llm.langid import op6_language_id
from talentlake.llm.lattice_lm import op8_lm_scoring
from talentlake.llm.line_dedup import op3_line_dedup
from talentlake.llm.near_dup import op1_near_dup
from talentlake.llm.oracle import ORACLE_SQL
from talentlake.llm.quality_rules import op2_quality_rules
from talentlake.llm.sharding import op11_sharding
from talentlake.llm.spelling import op12_spelling
from talentlake.llm.token_counts import op7_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dup": op1_near_dup,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontamination": op9_decontamination,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_sharding": op11_sharding,
    "op12_spelling": op12_spelling,
    "op13_centroids": op13_centroids,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
