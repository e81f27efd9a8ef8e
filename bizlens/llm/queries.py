"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from bizlens.llm import (chat, decontam, langid, license, merkle, packing, ppm, prefixtrie, quality, sharding,
                         simhash, substring, warc)

QUERIES = {
    "op1_license_scan": license.query,
    "op2_language_id": langid.query,
    "op3_decontamination": decontam.query,
    "op4_warc_index": warc.query,
    "op5_best_fit_packing": packing.query,
    "op6_simhash_dedup": simhash.query,
    "op7_quality_rules": quality.query,
    "op8_quotation_linking": chat.query,
    "op9_sharding": sharding.query,
    "op10_ppm_scoring": ppm.query,
    "op11_merkle_manifest": merkle.query,
    "op12_prefix_trie": prefixtrie.query,
    "op13_substring_dedup": substring.query,
}

SQL = {
    "op1_license_scan": license.ORACLE,
    "op3_decontamination": decontam.ORACLE,
    "op4_warc_index": warc.ORACLE,
    "op8_quotation_linking": chat.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_prefix_trie": prefixtrie.ORACLE,
    "op13_substring_dedup": substring.ORACLE,
}
