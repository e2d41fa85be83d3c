"""The corpus operators' registered queries and what SQL can say of them."""

from . import decontamination, importance, late_arrivals, licenses, near_dedup, packing, pii, quality, secrets, suffix_dedup, token_counts, vector_dedup, word_bpe

QUERIES = {
    f.__name__: f
    for f in (
        suffix_dedup.op1_substring_dedup,
        token_counts.op2_token_counts,
        licenses.op3_license_scan,
        decontamination.op4_decontamination,
        vector_dedup.op5_vector_dedup,
        secrets.op6_secret_scan,
        packing.op7_packing,
        near_dedup.op8_near_dedup,
        quality.op9_quality,
        pii.op10_personal_data,
        importance.op11_importance_resampling,
        late_arrivals.op12_late_arrivals,
        word_bpe.op13_word_bpe,
    )
}
ORACLES = {"op4_decontamination": decontamination.SQL, "op5_vector_dedup": vector_dedup.SQL, "op8_near_dedup": near_dedup.SQL, "op11_importance_resampling": importance.SQL}
