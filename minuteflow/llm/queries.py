"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from minuteflow.llm import op1_html, op2_simhash, op3_pii, op4_licenses, op5_quality, op6_urls, op7_suffix_dedup, op8_chat, op9_decontaminate, op10_mix, op11_manifest, op12_quality_model, op13_divergence, pipeline

QUERIES = {
    "op1_html_main_text": op1_html.op1_html_main_text,
    "op2_simhash_near_dedup": op2_simhash.op2_simhash_near_dedup,
    "op3_pii_spans": op3_pii.op3_pii_spans,
    "op4_license_scan": op4_licenses.op4_license_scan,
    "op5_quality_rules": op5_quality.op5_quality_rules,
    "op6_url_filter": op6_urls.op6_url_filter,
    "op7_suffix_array_dedup": op7_suffix_dedup.op7_suffix_array_dedup,
    "op8_chat_format": op8_chat.op8_chat_format,
    "op9_benchmark_decontamination": op9_decontaminate.op9_benchmark_decontamination,
    "op10_mix_sources": op10_mix.op10_mix_sources,
    "op11_merkle_manifest": op11_manifest.op11_merkle_manifest,
    "op12_quality_classifier": op12_quality_model.op12_quality_classifier,
    "op13_source_divergence": op13_divergence.op13_source_divergence,
    "pipeline": pipeline.run,
}

ORACLES = {
    "op4_license_scan": op4_licenses.ORACLE_SQL,
    "op5_quality_rules": op5_quality.ORACLE_SQL,
    "op6_url_filter": op6_urls.ORACLE_SQL,
    "op9_benchmark_decontamination": op9_decontaminate.ORACLE_SQL,
    "op10_mix_sources": op10_mix.ORACLE_SQL,
    "op11_merkle_manifest": op11_manifest.ORACLE_SQL,
    "op13_source_divergence": op13_divergence.ORACLE_SQL,
}
if pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = pipeline.ORACLE_SQL
