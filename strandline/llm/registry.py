"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from strandline.llm.chat import OP1_SQL, op1_chat_format
from strandline.llm.divergence import OP11_SQL, op11_source_divergence
from strandline.llm.lang_id import op12_language
from strandline.llm.near_docs import OP7_SQL, op7_near_documents
from strandline.llm.near_vectors import OP3_SQL, op3_near_vectors
from strandline.llm.packing import op8_best_fit
from strandline.llm.quality import op9_quality
from strandline.llm.ranked import OP13_SQL, op13_ranked_search
from strandline.llm.repeats import OP5_SQL, op5_repeats
from strandline.llm.revisits import OP10_SQL, op10_revisits
from strandline.llm.secrets import op6_secrets
from strandline.llm.tiling import op2_decontamination
from strandline.llm.token_records import op4_token_records


def queries() -> dict:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_decontamination": op2_decontamination,
        "op3_near_vectors": op3_near_vectors,
        "op4_token_records": op4_token_records,
        "op5_repeats": op5_repeats,
        "op6_secrets": op6_secrets,
        "op7_near_documents": op7_near_documents,
        "op8_best_fit": op8_best_fit,
        "op9_quality": op9_quality,
        "op10_revisits": op10_revisits,
        "op11_source_divergence": op11_source_divergence,
        "op12_language": op12_language,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": OP1_SQL,
        "op3_near_vectors": OP3_SQL,
        "op5_repeats": OP5_SQL,
        "op7_near_documents": OP7_SQL,
        "op10_revisits": OP10_SQL,
        "op11_source_divergence": OP11_SQL,
        "op13_ranked_search": OP13_SQL,
    }
