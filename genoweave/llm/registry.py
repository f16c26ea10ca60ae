"""Names of this subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

from . import oracles
from .decontam import op6_pigeonhole_decontamination
from .divergence import op13_source_divergence
from .html import op12_site_style_tree
from .language import op7_script_viterbi_language
from .neardup import op8_superminhash_neardup
from .packing import op1_min_bin_slack_packing
from .pii import op10_pattern_checksum_context
from .ppm import op2_ppm_scores
from .resampling import op11_importance_resampling
from .sharding import op9_prefix_sum_shards
from .topk import op3_impact_ordered_topk
from .substrings import op4_de_bruijn_substrings
from .wavelet import op5_wavelet_matrix


def queries():
    return {
        "op1_min_bin_slack_packing": op1_min_bin_slack_packing,
        "op2_ppm_scores": op2_ppm_scores,
        "op3_impact_ordered_topk": op3_impact_ordered_topk,
        "op4_de_bruijn_substrings": op4_de_bruijn_substrings,
        "op5_wavelet_matrix": op5_wavelet_matrix,
        "op6_pigeonhole_decontamination": op6_pigeonhole_decontamination,
        "op7_script_viterbi_language": op7_script_viterbi_language,
        "op8_superminhash_neardup": op8_superminhash_neardup,
        "op9_prefix_sum_shards": op9_prefix_sum_shards,
        "op10_pattern_checksum_context": op10_pattern_checksum_context,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_site_style_tree": op12_site_style_tree,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql():
    """SQL of the queries that SQL can express; tests hold the others against brute force."""
    return {
        "op3_impact_ordered_topk": oracles.OP3,
        "op4_de_bruijn_substrings": oracles.OP4,
        "op8_superminhash_neardup": oracles.OP8,
        "op9_prefix_sum_shards": oracles.OP9,
        "op10_pattern_checksum_context": oracles.OP10,
        "op11_importance_resampling": oracles.OP11,
        "op13_source_divergence": oracles.OP13,
    }
