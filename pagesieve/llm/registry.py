"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pagesieve.llm.decontamination import OP8_SQL, op8_decontamination
from pagesieve.llm.embedding_dedup import OP6_SQL, op6_embedding_dedup
from pagesieve.llm.language_id import op9_language_id
from pagesieve.llm.lm_scoring import OP3_SQL, op3_lm_scores
from pagesieve.llm.near_dedup import op10_near_duplicates
from pagesieve.llm.packing import op4_packing
from pagesieve.llm.token_counts import op7_token_counts
from pagesieve.llm.token_files import op1_token_files
from pagesieve.llm.toxicity import op2_toxicity
from pagesieve.llm.warc import OP5_SQL, op5_warc_transactions


def queries() -> dict:
    return {
        "op1_token_files": op1_token_files,
        "op2_toxicity": op2_toxicity,
        "op3_lm_scores": op3_lm_scores,
        "op4_packing": op4_packing,
        "op5_warc_transactions": op5_warc_transactions,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_decontamination": op8_decontamination,
        "op9_language_id": op9_language_id,
        "op10_near_duplicates": op10_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_lm_scores": OP3_SQL, "op5_warc_transactions": OP5_SQL, "op6_embedding_dedup": OP6_SQL, "op8_decontamination": OP8_SQL}
