"""The corpus queries by name, with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from weftgraph.llm.line_dedup import ORACLE_SQL as LINE_DEDUP_SQL
from weftgraph.llm.line_dedup import op4_line_dedup
from weftgraph.llm.packing import op10_best_fit_packing
from weftgraph.llm.quality_classifier import op8_quality_classifier
from weftgraph.llm.quality_rules import ORACLE_SQL as QUALITY_RULES_SQL
from weftgraph.llm.quality_rules import op3_quality_rules
from weftgraph.llm.resharding import op7_flow_resharding
from weftgraph.llm.simhash_dedup import op5_simhash_dedup
from weftgraph.llm.source_mixing import ORACLE_SQL as SOURCE_MIXING_SQL
from weftgraph.llm.source_mixing import op2_source_mixing
from weftgraph.llm.substring_dedup import op9_sentence_span_dedup
from weftgraph.llm.topk_search import ORACLE_SQL as TOPK_SEARCH_SQL
from weftgraph.llm.topk_search import op1_topk_search
from weftgraph.llm.url_filter import op6_url_filters

QUERIES = {f.__name__: f for f in (op1_topk_search, op2_source_mixing, op3_quality_rules, op4_line_dedup, op5_simhash_dedup, op6_url_filters, op7_flow_resharding, op8_quality_classifier, op9_sentence_span_dedup, op10_best_fit_packing)}
ORACLE_SQL = {"op1_topk_search": TOPK_SEARCH_SQL, "op2_source_mixing": SOURCE_MIXING_SQL, "op3_quality_rules": QUALITY_RULES_SQL, "op4_line_dedup": LINE_DEDUP_SQL}
