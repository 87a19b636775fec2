"""The queries that __spark_entry__ adds, each an operator over its whole table."""

from __future__ import annotations

from . import alignment, centroids, jaccard, language, lyndon, mixing, neighbours, packing, quality, secrets, suffix, urls, wavelet

QUERIES = {
    "op1_cube_mix": mixing.op1,
    "op2_learned_partitions": neighbours.op2,
    "op3_line_crf": quality.op3,
    "op4_prefix_doubling": suffix.op4,
    "op5_sum_of_squares": packing.op5,
    "op6_secret_lexer": secrets.op6,
    "op7_temporal_urls": urls.op7,
    "op8_wavelet_shards": wavelet.op8,
    "op9_banded_tiles": jaccard.op9,
    "op10_attention_scores": language.op10,
    "op11_nearest_centroids": centroids.op11,
    "op12_lyndon_runs": lyndon.op12,
    "op13_segment_alignment": alignment.op13,
}

#: DuckDB SQL of those that SQL can express.
ORACLES: dict[str, str] = {"op7_temporal_urls": urls.OP7_SQL}
