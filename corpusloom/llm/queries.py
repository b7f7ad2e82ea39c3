"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from corpusloom.llm import chat, decontamination, html, langid, linededup, neardup, packing, sharding, topk, urls


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            chat.op3_chat_formatting,
            decontamination.op1_decontamination,
            langid.op2_language_id,
            neardup.op4_minhash_near_dedup,
            linededup.op5_line_dedup,
            html.op6_html_extraction,
            urls.op8_url_filters,
            topk.op9_exact_topk,
            packing.op7_packing,
            sharding.op10_sharding,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": chat.SQL, "op9_exact_topk": topk.SQL, "op10_sharding": sharding.SQL}
