"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from corpusloom.llm import licenses, quality, secrets, topk
from corpusloom.llm.langid import op7_language
from corpusloom.llm.packing import op9_packing
from corpusloom.llm.pii import op3_pii
from corpusloom.llm.sentencepieces import op1_sentencepiece
from corpusloom.llm.simhash import op4_simhash
from corpusloom.llm.tokencount import op10_token_counts

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_licenses": licenses.op2_licenses,
    "op3_pii": op3_pii,
    "op4_simhash": op4_simhash,
    "op5_secrets": secrets.op5_secrets,
    "op6_quality": quality.op6_quality,
    "op7_language": op7_language,
    "op8_top_k": topk.op8_top_k,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
}

SQL: dict[str, str] = {
    "op2_licenses": licenses.SQL,
    "op5_secrets": secrets.SQL,
    "op6_quality": quality.SQL,
    "op8_top_k": topk.SQL,
}
