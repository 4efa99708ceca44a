"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .boosting import op6_quality_classifier
from .byte_pairs import op13_byte_pair_encoding
from .centroids import OP11_SQL, op11_centroid_clustering
from .chat import OP2_SQL, op2_chat_format
from .jaccard_join import op7_ngram_jaccard_join
from .line_dedup import OP1_SQL, op1_line_dedup
from .metric_join import OP3_SQL, op3_embedding_near_dedup
from .packing import op5_best_fit_packing
from .quality_rules import OP4_SQL, op4_quality_rules
from .resampling import OP12_SQL, op12_importance_resampling
from .secrets import op10_secret_scan
from .sentence_pieces import op9_sentence_pieces
from .suffix_dedup import op8_suffix_array_dedup

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_secret_scan": op10_secret_scan,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_byte_pair_encoding": op13_byte_pair_encoding,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op2_chat_format": OP2_SQL,
    "op3_embedding_near_dedup": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}
