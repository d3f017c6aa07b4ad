"""The registered queries of this subpackage, each over a whole table, and their SQL."""

from __future__ import annotations

from pagemill.llm import chat, collocations, exact_dedup, licenses, line_dedup, merkle, mixing, near_dedup, packing, pii, quality_model, quality_rules, secret_scan
from pagemill.llm.common import load

QUERIES = {
    "op1_exact_dedup": lambda spark, d: exact_dedup.find_copies(load(spark, d, "documents")),
    "op2_pii": lambda spark, d: pii.find_private(load(spark, d, "documents")),
    "op3_mixing": lambda spark, d: mixing.plan_mix(load(spark, d, "documents")),
    "op4_near_dedup": lambda spark, d: near_dedup.find_near(load(spark, d, "documents")),
    "op5_secret_scan": lambda spark, d: secret_scan.scan(load(spark, d, "documents")),
    "op6_quality_rules": lambda spark, d: quality_rules.judge(load(spark, d, "documents")),
    "op7_quality_model": lambda spark, d: quality_model.score_quality(load(spark, d, "documents"), load(spark, d, "labels")),
    "op8_chat": lambda spark, d: chat.format_table(load(spark, d, "conversations")),
    "op9_packing": lambda spark, d: packing.pack(load(spark, d, "documents")),
    "op10_licenses": lambda spark, d: licenses.scan(load(spark, d, "documents")),
    "op11_collocations": lambda spark, d: collocations.collocations(load(spark, d, "documents")),
    "op12_merkle": lambda spark, d: merkle.manifest(load(spark, d, "documents")),
    "op13_line_dedup": lambda spark, d: line_dedup.digest_lines(load(spark, d, "documents")),
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op4_near_dedup": near_dedup.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op10_licenses": licenses.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_line_dedup": line_dedup.ORACLE,
}
