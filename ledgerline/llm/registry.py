"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from ledgerline.llm import op2_stream_dedup as op2
from ledgerline.llm import op3_line_templates as op3
from ledgerline.llm import op4_warc as op4
from ledgerline.llm import op7_parity_join as op7
from ledgerline.llm import op8_substring_dedup as op8
from ledgerline.llm import op9_mixing as op9
from ledgerline.llm import op11_cover_tree as op11
from ledgerline.llm import op12_itemset_counting as op12
from ledgerline.llm.op1_language_id import op1_language_id
from ledgerline.llm.op5_quality import op5_quality
from ledgerline.llm.op6_packing import op6_packing
from ledgerline.llm.op10_winnowing import op10_winnowing
from ledgerline.llm.op13_arrow_tokens import op13_arrow_tokens

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_stream_dedup": op2.op2_stream_dedup,
    "op3_line_templates": op3.op3_line_templates,
    "op4_warc": op4.op4_warc,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_parity_join": op7.op7_parity_join,
    "op8_substring_dedup": op8.op8_substring_dedup,
    "op9_mixing": op9.op9_mixing,
    "op10_winnowing": op10_winnowing,
    "op11_cover_tree": op11.op11_cover_tree,
    "op12_itemset_counting": op12.op12_itemset_counting,
    "op13_arrow_tokens": op13_arrow_tokens,
}

SQL: dict[str, str] = {
    "op2_stream_dedup": op2.SQL,
    "op3_line_templates": op3.SQL,
    "op4_warc": op4.SQL,
    "op7_parity_join": op7.SQL,
    "op8_substring_dedup": op8.SQL,
    "op9_mixing": op9.SQL,
    "op11_cover_tree": op11.SQL,
    "op12_itemset_counting": op12.SQL,
}
