"""The queries of this subpackage and, where SQL can express them, their SQL."""

from tidewrack.llm import bpe, exact_dedup, fingerprints, html_main, licenses, minhash, packing, quality, substring, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_licenses": licenses.op2_licenses,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_minhash": minhash.op4_minhash,
    "op5_html": html_main.op5_html,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_substring": substring.op9_substring,
    "op10_quality": quality.op10_quality,
}
SQL = {"op2_licenses": licenses.OP2_SQL, "op4_minhash": minhash.OP4_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL}
