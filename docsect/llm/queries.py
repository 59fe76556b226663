"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from docsect.llm.centroids import OP13_SQL, op13_centroid_clustering
from docsect.llm.chat import OP2_SQL, op2_chat_formatting
from docsect.llm.media import op1_media_columns
from docsect.llm.minhash import op8_minhash_near_dedup
from docsect.llm.packing import op3_best_fit_packing
from docsect.llm.phrases import OP12_SQL, op12_phrase_mining
from docsect.llm.pieces import op10_sentencepiece
from docsect.llm.pii import op4_pii
from docsect.llm.quality import op7_quality_rules
from docsect.llm.substrings import op6_substring_dedup
from docsect.llm.suffix_tree import op11_lm_scoring
from docsect.llm.toxicity import op5_toxicity
from docsect.llm.urls import OP9_SQL, op9_url_filters

QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLES: dict[str, str] = {
    "op2_chat_formatting": OP2_SQL,
    "op9_url_filters": OP9_SQL,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_phrase_mining": OP12_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
