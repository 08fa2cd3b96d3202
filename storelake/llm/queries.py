"""Registered queries of this folder and their SQL, where SQL can express them."""

from __future__ import annotations

from storelake.llm import (codebooks, decontaminate, jaccard, linededup, lm, negatives, neighbours, packing, quality, secrets,
                           sharding, simhash, toxicity)

QUERIES = {
    "op1_toxicity": toxicity.toxicity_query,
    "op2_line_dedup": linededup.linededup_query,
    "op3_jaccard_join": jaccard.jaccard_query,
    "op4_lm_scoring": lm.lm_query,
    "op5_sharding": sharding.sharding_query,
    "op6_benchmark_decontamination": decontaminate.decontaminate_query,
    "op7_quality_classifier": quality.quality_query,
    "op8_packing": packing.packing_query,
    "op9_secret_scan": secrets.secrets_query,
    "op10_nearest_neighbours": neighbours.neighbours_query,
    "op11_simhash": simhash.simhash_query,
    "op12_hard_negatives": negatives.negatives_query,
    "op13_vector_codes": codebooks.codebooks_query,
}

SQL = {
    "op3_jaccard_join": jaccard.SQL,
    "op6_benchmark_decontamination": decontaminate.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_vector_codes": codebooks.SQL,
}
