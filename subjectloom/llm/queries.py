"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from . import crf_quality, divergence, host_quality, language_id, license_scan, periodic_runs, pfair_mix, reply_trees, semicrf_pii, spaced_seeds, warc_archive
from .chosen_path import op10_chosen_path
from .debruijn import op5_debruijn

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_semicrf_pii": semicrf_pii.op2_semicrf_pii,
    "op3_pfair_mix": pfair_mix.op3_pfair_mix,
    "op4_gzip_normaliser": warc_archive.op4_gzip_normaliser,
    "op5_debruijn": op5_debruijn,
    "op6_host_rules": host_quality.op6_host_rules,
    "op7_spaced_seeds": spaced_seeds.op7_spaced_seeds,
    "op8_reply_trees": reply_trees.op8_reply_trees,
    "op9_evidence_fusion": language_id.op9_evidence_fusion,
    "pages_evidence_fusion": language_id.pages_evidence_fusion,
    "op10_chosen_path": op10_chosen_path,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_crf_quality": crf_quality.op12_crf_quality,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.oracle(),
    "op3_pfair_mix": pfair_mix.ORACLE,
    "op4_gzip_normaliser": warc_archive.ORACLE,
    "op6_host_rules": host_quality.ORACLE,
    "op8_reply_trees": reply_trees.oracle(),
    "op11_source_divergence": divergence.ORACLE,
}
