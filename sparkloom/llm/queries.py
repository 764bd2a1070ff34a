"""The queries of the training-data operators, and SQL for those that have any."""

from __future__ import annotations

from sparkloom.llm.chat_format import op2_budgeted_chat
from sparkloom.llm.decontaminate import op7_simhash_decontamination
from sparkloom.llm.exact_dedup import ORACLE as EXACT_SQL
from sparkloom.llm.exact_dedup import op6_exact_dedup
from sparkloom.llm.html_extract import op8_consensus_html
from sparkloom.llm.jaccard import op10_jaccard_join
from sparkloom.llm.packing import op5_best_fit_packing
from sparkloom.llm.pii import op4_surrogates
from sparkloom.llm.sharding import op1_kd_sharding
from sparkloom.llm.substring_dedup import op3_chained_substrings
from sparkloom.llm.toxicity import op9_weak_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_kd_sharding,
        op2_budgeted_chat,
        op3_chained_substrings,
        op4_surrogates,
        op5_best_fit_packing,
        op6_exact_dedup,
        op7_simhash_decontamination,
        op8_consensus_html,
        op9_weak_toxicity,
        op10_jaccard_join,
    )
}

ORACLES = {"op6_exact_dedup": EXACT_SQL}
