"""The queries of this subpackage and their SQL, for the entry module.

No SQL: op1 (its cutoffs), op3, op6, op7 (spans of code points and models), op5 (rolling
hashes), op9 (the seeded order), op10 (the dynamic programme), op13 (its model); tests hold them
against brute force, op13 against held-out languages.
"""

from __future__ import annotations

from . import op2_neardup, op4_topk, op8_substring, op11_resample, op12_search
from .op1_quality import op1_quality
from .op3_pii import op3_pii
from .op5_lines import op5_lines
from .op6_tokens import op6_tokens
from .op7_secrets import op7_secrets
from .op9_mixing import op9_mixing
from .op10_packing import op10_packing
from .op13_language import op13_language

QUERIES = {
    "op1_quality": op1_quality,
    "op2_near_duplicates": op2_neardup.op2_near_duplicates,
    "op3_pii": op3_pii,
    "op4_topk": op4_topk.op4_topk,
    "op5_lines": op5_lines,
    "op6_tokens": op6_tokens,
    "op7_secrets": op7_secrets,
    "op8_substring": op8_substring.op8_substring,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_resample": op11_resample.op11_resample,
    "op12_search": op12_search.op12_search,
    "op13_language": op13_language,
}
ORACLES = {
    "op2_near_duplicates": op2_neardup.ORACLE,
    "op4_topk": op4_topk.ORACLE,
    "op8_substring": op8_substring.ORACLE,
    "op11_resample": op11_resample.ORACLE,
    "op12_search": op12_search.ORACLE,
}
