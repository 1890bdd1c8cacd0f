"""The queries of this package, by name, and their DuckDB SQL where SQL can express them."""

from leaguelens.llm import cws, htmlmain, langid, merkle, mixing, packing, pii, ptolemy, sentencepieces, simhash, suffixdedup, topk, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_simhash_golay": simhash.op2_simhash_golay,
    "op3_sentencepiece": sentencepieces.op3_sentencepiece,
    "op4_pivot_topk": topk.op4_pivot_topk,
    "op5_weighted_sampling": cws.op5_weighted_sampling,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_language_id": langid.op8_language_id,
    "op9_suffix_dedup": suffixdedup.op9_suffix_dedup,
    "op10_html_main_text": htmlmain.op10_html_main_text,
    "op11_fair_mixing": mixing.op11_fair_mixing,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_ptolemaic_clusters": ptolemy.op13_ptolemaic_clusters,
}

ORACLES: dict[str, str] = {
    "op4_pivot_topk": topk.OP4_SQL,
    "op11_fair_mixing": mixing.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_ptolemaic_clusters": ptolemy.OP13_SQL,
}
