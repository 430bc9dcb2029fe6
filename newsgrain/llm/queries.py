"""Registered queries of the corpus operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import corpus_pipeline

from .fingerprints import op7_document_fingerprints
from .lexical_search import OP11_SQL, op11_lexical_search
from .lm_scoring import op3_lm_scoring
from .mixing import OP10_SQL, op10_mixing
from .ngram_join import OP1_SQL, op1_ngram_jaccard_join
from .packing import op8_best_fit_packing
from .quality_classifier import op4_quality_classifier
from .quality_rules import op6_quality_rules
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .suffix_dedup import op5_suffix_array_dedup
from .token_counts import op2_token_counts
from .toxicity import op12_toxicity
from .whitening import op13_embedding_whitening

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
    "op11_lexical_search": op11_lexical_search,
    "op12_toxicity": op12_toxicity,
    "op13_embedding_whitening": op13_embedding_whitening,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op10_mixing": OP10_SQL,
    "op11_lexical_search": OP11_SQL,
}
