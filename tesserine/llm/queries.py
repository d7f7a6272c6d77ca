"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op4_tokens
from .fim import OP13_SQL, op13_fill_in_middle
from .lines import OP5_SQL, op5_line_dedup
from .neardup import OP6_SQL, op6_near_dedup
from .packing import op3_packing
from .phrases import OP12_SQL, op12_collocations
from .pieces import op7_pieces
from .quality import OP2_SQL, op2_quality
from .secrets import OP9_SQL, op9_secrets
from .shards import OP1_SQL, op1_shards
from .topk import OP8_SQL, op8_topk
from .urls import OP10_SQL, op10_urls
from .warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_shards": op1_shards,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_tokens": op4_tokens,
    "op5_line_dedup": op5_line_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_pieces": op7_pieces,
    "op8_topk": op8_topk,
    "op9_secrets": op9_secrets,
    "op10_urls": op10_urls,
    "op11_warc": op11_warc,
    "op12_collocations": op12_collocations,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_shards": OP1_SQL,
    "op2_quality": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_near_dedup": OP6_SQL,
    "op8_topk": OP8_SQL,
    "op9_secrets": OP9_SQL,
    "op10_urls": OP10_SQL,
    "op11_warc": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
