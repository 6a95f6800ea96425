"""The registered queries of this subpackage and their SQL."""

from . import bpe, divergence, exact_dedup, language, licenses, lm, near_dedup, search, toxicity, vector_dedup
from .packing import op10_packing
from .token_files import op4_token_files
from .warc import op9_warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_vector_dedup": vector_dedup.op2_vector_dedup,
    "op3_licenses": licenses.op3_licenses,
    "op4_token_files": op4_token_files,
    "op5_bpe": bpe.op5_bpe,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_lm": lm.op8_lm,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_divergence": divergence.op11_divergence,
    "op12_language": language.op12_language,
    "op13_search": search.op13_search,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_licenses": licenses.SQL,
    "op11_divergence": divergence.SQL,
    "op13_search": search.SQL,
}
