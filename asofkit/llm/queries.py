"""The operators' queries, by name, and their SQL where it can express them."""

from __future__ import annotations

from . import collocations, jaccard, katz, langid, mixing, negatives, packing, secrets, sharding, topk, toxicity, ts, urlgraph

QUERIES = {
    "op1_vector_sharding": sharding.op1_vector_sharding,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_poisson_mixing": mixing.op3_poisson_mixing,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_threshold_topk": topk.op5_threshold_topk,
    "op6_randomness_battery": secrets.op6_randomness_battery,
    "op7_transport_streams": ts.op7_transport_streams,
    "op8_katz_backoff": katz.op8_katz_backoff,
    "op9_nearest_centroid": langid.op9_nearest_centroid,
    "op10_link_graph": urlgraph.op10_link_graph,
    "op11_radix_negatives": negatives.op11_radix_negatives,
    "op12_toxic_segments": toxicity.op12_toxic_segments,
    "op13_collocations": collocations.op13_collocations,
}

SQL = {
    "op2_jaccard_join": jaccard.OP2_SQL,
    "op3_poisson_mixing": mixing.OP3_SQL,
    "op5_threshold_topk": topk.OP5_SQL,
    "op11_radix_negatives": negatives.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
