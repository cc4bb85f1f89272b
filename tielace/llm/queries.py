"""The queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

from .align import op11_tokenizer_alignment
from .dac import op5_dac_tokens
from .itq import OP10_SQL, op10_itq_near_dups
from .langid import op6_language_id
from .lines import OP12_SQL, op12_line_dedup
from .mixing import OP2_SQL, op2_poisson_mix
from .packing import op3_pattern_packing
from .pii import op1_pii_feistel
from .repeats import op9_prefix_free_repeats
from .simhash import op7_simhash_pivots
from .topk import OP8_SQL, op8_kdtree_topk
from .turns import OP13_SQL, op13_conversation_repair
from .urlfilter import OP4_SQL, op4_link_graph_filter

QUERIES = {
    "op1_pii_feistel": op1_pii_feistel,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_pattern_packing": op3_pattern_packing,
    "op4_link_graph_filter": op4_link_graph_filter,
    "op5_dac_tokens": op5_dac_tokens,
    "op6_language_id": op6_language_id,
    "op7_simhash_pivots": op7_simhash_pivots,
    "op8_kdtree_topk": op8_kdtree_topk,
    "op9_prefix_free_repeats": op9_prefix_free_repeats,
    "op10_itq_near_dups": op10_itq_near_dups,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_line_dedup": op12_line_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {"op4_link_graph_filter": OP4_SQL, "op2_poisson_mix": OP2_SQL, "op8_kdtree_topk": OP8_SQL, "op10_itq_near_dups": OP10_SQL, "op12_line_dedup": OP12_SQL, "op13_conversation_repair": OP13_SQL}
