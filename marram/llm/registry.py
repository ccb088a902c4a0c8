"""The subpackage's queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, decontaminate, filter_audit, hard_negatives, langid, licenses, neardup, packing, secret_scan, sharding, token_files, toxicity, urls

QUERIES = {
    "op1_min_max_hash": neardup.op1_min_max_hash,
    "op2_bloom_cascade": urls.op2_bloom_cascade,
    "op3_kneser_ney": langid.op3_kneser_ney,
    "op4_bounded_ring": sharding.op4_bounded_ring,
    "op5_markov_secrets": secret_scan.op5_markov_secrets,
    "op6_one_bit_codes": ann.op6_one_bit_codes,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_suffix_arrays": decontaminate.op8_suffix_arrays,
    "op9_license_windows": licenses.op9_license_windows,
    "op10_token_files": token_files.op10_token_files,
    "op11_residual_norms": hard_negatives.op11_residual_norms,
    "op12_filter_windows": filter_audit.op12_filter_windows,
    "op13_noisy_channel": toxicity.op13_noisy_channel,
}

SQL = {
    "op1_min_max_hash": neardup.OP1_SQL,
    "op2_bloom_cascade": urls.OP2_SQL,
    "op8_suffix_arrays": decontaminate.OP8_SQL,
    "op9_license_windows": licenses.OP9_SQL,
    "op11_residual_norms": hard_negatives.OP11_SQL,
    "op12_filter_windows": filter_audit.OP12_SQL,
}
