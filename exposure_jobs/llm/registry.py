"""The registered corpus queries and, where SQL can say the same, their SQL."""

from exposure_jobs.llm import bpe, compression_quality, conversations, decontaminate, language_model, minhash, prefix_trie, quality_rules, repeated_phrases, resampling, sanitise, simhash, toxicity

QUERIES = {
    "op1_simhash_dedup": simhash.op1_simhash_dedup,
    "op2_language_model": language_model.op2_language_model,
    "op3_repeated_phrases": repeated_phrases.op3_repeated_phrases,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_conversations": conversations.op6_conversations,
    "op7_bpe": bpe.op7_bpe,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "rule_ablations": quality_rules.rule_ablations,
    "op9_sanitise": sanitise.op9_sanitise,
    "op10_compression_quality": compression_quality.op10_compression_quality,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_conversation_trie": prefix_trie.op12_conversation_trie,
    "op13_minhash_dedup": minhash.op13_minhash_dedup,
}
ORACLE_SQL = {
    "op2_language_model": language_model.OP2_SQL,
    "op3_repeated_phrases": repeated_phrases.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op6_conversations": conversations.OP6_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "rule_ablations": quality_rules.ABLATIONS_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
    "op12_conversation_trie": prefix_trie.OP12_SQL,
}
