"""The queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP9_SQL, op9_benchmark_decontamination
from .flac import op4_flac_media
from .histogram_sort import OP2_SQL, op2_histogram_sort
from .language_id import op8_language_id
from .periodic import OP11_SQL, op11_periodic_runs
from .pii import op5_pii_pseudonyms
from .quality import op13_quality_rules
from .quotes import OP1_SQL, op1_quotation_linking
from .rans_tokens import op7_rans_tokens
from .sentencepiece_wfst import op3_sentencepiece_wfst
from .simhash import op10_simhash_near_dedup
from .token_alignment import op12_cross_tokenizer_alignment
from .toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotation_linking": op1_quotation_linking,
    "op2_histogram_sort": op2_histogram_sort,
    "op3_sentencepiece_wfst": op3_sentencepiece_wfst,
    "op4_flac_media": op4_flac_media,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_toxicity": op6_toxicity,
    "op7_rans_tokens": op7_rans_tokens,
    "op8_language_id": op8_language_id,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_quality_rules": op13_quality_rules,
}

ORACLES: dict[str, str] = {"op1_quotation_linking": OP1_SQL, "op2_histogram_sort": OP2_SQL, "op9_benchmark_decontamination": OP9_SQL, "op11_periodic_runs": OP11_SQL}
