"""The queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from .bpe import op2_bpe_round_trip
from .fingerprints import op8_weighted_sampling
from .html_extract import OP4_SQL, op4_consensus_paths
from .jaccard import OP7_SQL, op7_ngram_jaccard
from .line_dedup import OP6_SQL, op6_line_dedup
from .lm import op9_recurrent_model
from .mixing import OP13_SQL, op13_water_filling
from .negatives import OP12_SQL, op12_rtree_negatives
from .packing import op3_best_fit_packing
from .repair import OP11_SQL, op11_run_length_repair
from .topk import OP5_SQL, op5_dual_cover_trees
from .suffix_dedup import op1_suffix_dedup
from .toxicity import op10_nearest_examples

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_consensus_paths": op4_consensus_paths,
    "op5_dual_cover_trees": op5_dual_cover_trees,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_weighted_sampling": op8_weighted_sampling,
    "op9_recurrent_model": op9_recurrent_model,
    "op10_nearest_examples": op10_nearest_examples,
    "op11_run_length_repair": op11_run_length_repair,
    "op12_rtree_negatives": op12_rtree_negatives,
    "op13_water_filling": op13_water_filling,
}

ORACLES: dict[str, str] = {
    "op4_consensus_paths": OP4_SQL,
    "op5_dual_cover_trees": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_ngram_jaccard": OP7_SQL,
    "op11_run_length_repair": OP11_SQL,
    "op12_rtree_negatives": OP12_SQL,
    "op13_water_filling": OP13_SQL,
}
