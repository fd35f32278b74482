"""Named queries of the corpus operators and the pipeline, and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from loreweave.llm import bytebpe, licenses, media, packing, pii, quality, resample, simhash, spelling, sstable, token_counts, topk, toxicity


def queries() -> dict:
    return {
        "op1_sorted_string_tables": sstable.op1,
        "op2_byte_bpe_rank_queue": bytebpe.op2,
        "op3_bounded_best_fit": packing.op3,
        "op4_factorization_toxicity": toxicity.op4,
        "op5_covering_simhash": simhash.op5,
        "op6_columnar_top_k": topk.op6,
        "op7_weak_label_quality": quality.op7,
        "op8_license_notices": licenses.op8,
        "op9_wav_fingerprints": media.op9,
        "op10_pii_surrogates": pii.op10,
        "op11_spelling_variants": spelling.op11,
        "op12_token_counts": token_counts.op12,
        "op13_importance_resampling": resample.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op6_columnar_top_k": topk.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op13_importance_resampling": resample.ORACLE}
