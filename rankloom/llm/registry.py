"""The queries of this subpackage and the SQL that some of them are held against."""

from rankloom.llm import contamination, context_tree, licenses, line_index, passage_classifier, personal_data, phrases, quality_rules, ranked_search, repeats, simhash, token_counts, token_ids

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_classifier": passage_classifier.op2_quality_classifier,
    "op3_repeated_passages": repeats.op3_repeated_passages,
    "op4_simhash": simhash.op4_simhash,
    "op5_lm_scores": context_tree.op5_lm_scores,
    "op6_licences": licenses.op6_licences,
    "op7_decontamination": contamination.op7_decontamination,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_line_dedup": line_index.op9_line_dedup,
    "op10_byte_bpe": token_ids.op10_byte_bpe,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_personal_data": personal_data.op12_personal_data,
    "op13_phrases": phrases.op13_phrases,
}
ORACLE_SQL = {
    "op7_decontamination": contamination.OP7_SQL,
    "op9_line_dedup": line_index.OP9_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
