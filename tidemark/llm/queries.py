"""The queries of this subpackage and their SQL."""

from . import quality_sql, text_sql
from .contamination import op12_inverted_index_contamination
from .fill_middle import op13_wavelet_fill_middle
from .importance import op11_target_resampling
from .kmeans_tree import op7_kmeans_tree_search
from .mixing import op2_soft_membership_mixing
from .packing import op1_mixture_packing
from .quality_knn import op9_quality_neighbour_vote
from .quality_rules import op5_adaptive_quality_rules
from .records import op4_binary_records
from .secrets import op6_markov_secret_scan
from .simhash import op10_simhash_near_dedup
from .token_counts import op8_digest_cache_counts
from .toxicity import op3_toxicity_network

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixture_packing,
        op2_soft_membership_mixing,
        op3_toxicity_network,
        op4_binary_records,
        op5_adaptive_quality_rules,
        op6_markov_secret_scan,
        op7_kmeans_tree_search,
        op8_digest_cache_counts,
        op9_quality_neighbour_vote,
        op10_simhash_near_dedup,
        op11_target_resampling,
        op12_inverted_index_contamination,
        op13_wavelet_fill_middle,
    )
}
#: The other operators train models, tokenize, hash with seeds or search by approximation, which SQL cannot express.
ORACLE_SQL = {
    "op5_adaptive_quality_rules": quality_sql.SQL,
    "op11_target_resampling": text_sql.RESAMPLING,
    "op12_inverted_index_contamination": text_sql.CONTAMINATION,
    "op13_wavelet_fill_middle": text_sql.FILL_MIDDLE,
}
