"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import audit, idfiles, mainpage, neardup, packing, passages, phrases, pieces, pseudonyms, quality, sharding, tokens, vectors

QUERIES = {
    "op1_bag_minhash": neardup.op1_bag_minhash,
    "op2_histogram_shards": sharding.op2_histogram_shards,
    "op3_linear_grouping": packing.op3_linear_grouping,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_piece_codec": pieces.op5_piece_codec,
    "op6_collinear_chains": passages.op6_collinear_chains,
    "op7_section_tokens": tokens.op7_section_tokens,
    "op8_subspace_pigeonhole": vectors.op8_subspace_pigeonhole,
    "op9_tag_path_ratios": mainpage.op9_tag_path_ratios,
    "op10_feistel_pseudonyms": pseudonyms.op10_feistel_pseudonyms,
    "op11_phrase_stripes": phrases.op11_phrase_stripes,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_patched_blocks": idfiles.op13_patched_blocks,
}

ORACLE_SQL: dict[str, str] = {"op11_phrase_stripes": phrases.OP11_SQL, "op12_filter_audit": audit.OP12_SQL}
