"""The queries of this subpackage and their SQL."""

from stridex.llm import host_rules, language, lm_score, minhash, mixing, neighbours, packing, quality, substrings, url_filter

QUERIES = {
    "op1_pu_quality": quality.query,
    "op2_host_quality_rules": host_rules.query,
    "op3_bbit_minhash": minhash.query,
    "op4_ppm_language": language.query,
    "op5_sum_of_squares_packing": packing.query,
    "op6_temperature_mixing": mixing.query,
    "op7_backoff_automaton": lm_score.query,
    "op8_url_vocabulary": url_filter.query,
    "op9_suffix_tree_dedup": substrings.query,
    "op10_nn_descent": neighbours.query,
}
ORACLES = {
    "op2_host_quality_rules": host_rules.ORACLE,
    "op3_bbit_minhash": minhash.ORACLE,
    "op8_url_vocabulary": url_filter.ORACLE,
    "op9_suffix_tree_dedup": substrings.ORACLE,
}
