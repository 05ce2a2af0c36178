"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, chat, impact, mixing, neardup, packing, quality, simhash, token_counts, toxicity, tput, warc


def queries() -> dict:
    return {
        "op1_source_mixing": mixing.op1_source_mixing,
        "op2_block_ann": ann.op2_block_ann,
        "op3_impact_topk": impact.op3_impact_topk,
        "op4_ftrl_toxicity": toxicity.op4_ftrl_toxicity,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_arc_to_warc": warc.op6_arc_to_warc,
        "op7_chosen_path_dedup": neardup.op7_chosen_path_dedup,
        "op8_preference_formatting": chat.op8_preference_formatting,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_site_quality": quality.op10_site_quality,
        "op11_bk_simhash": simhash.op11_bk_simhash,
        "op12_tput_search": tput.op12_tput_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mixing": mixing.oracle(),
        "op2_block_ann": ann.ORACLE,
        "op3_impact_topk": impact.ORACLE,
        "op6_arc_to_warc": warc.ORACLE,
        "op7_chosen_path_dedup": neardup.ORACLE,
        "op8_preference_formatting": chat.ORACLE,
        "op12_tput_search": tput.ORACLE,
    }
