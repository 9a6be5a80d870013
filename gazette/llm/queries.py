"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from gazette.llm import decontaminate, host_rules, line_dedup, lm_scoring, packing, passages, periodic_runs, pii, progressive_jpeg, quality, simhash, spelling, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_substring_dedup": passages.op5_substring_dedup,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_host_rules": host_rules.op8_host_rules,
    "op9_pii": pii.op9_pii,
    "op10_warc": warc.op10_warc,
    "op11_progressive_jpeg": progressive_jpeg.op11_progressive_jpeg,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

SQL = {k: v for m in (decontaminate, host_rules, line_dedup, lm_scoring, packing, passages, periodic_runs, pii, progressive_jpeg, quality, simhash, spelling, warc) for k, v in m.SQL.items()}
