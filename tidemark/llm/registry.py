"""Queries of this subpackage."""

from __future__ import annotations

from tidemark.llm import oracles
from tidemark.llm.collocations import op13_collocations
from tidemark.llm.decontamination import op9_decontamination
from tidemark.llm.language_id import op4_language_id
from tidemark.llm.license_scan import op11_license_scan
from tidemark.llm.line_dedup import op7_line_dedup
from tidemark.llm.lm_scoring import op10_lm_scoring
from tidemark.llm.ngram_join import op6_ngram_join
from tidemark.llm.packing import op3_best_fit_packing
from tidemark.llm.span_dedup import op8_span_dedup
from tidemark.llm.spelling import op12_spelling_variants
from tidemark.llm.token_counts import op1_token_counts
from tidemark.llm.vector_search import op2_vector_search
from tidemark.llm.warc import op5_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_vector_search, op3_best_fit_packing, op4_language_id, op5_warc, op6_ngram_join, op7_line_dedup, op8_span_dedup,
        op9_decontamination, op10_lm_scoring, op11_license_scan, op12_spelling_variants, op13_collocations,
    )
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
