"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from . import importance, langid, packing, pieces, pii, quality, runs, sharding, simhash, spotsigs, substrings, toxicity, urlfilter

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_packing": packing.op2_packing,
    "op3_langid": langid.op3_langid,
    "op4_urlfilter": urlfilter.op4_urlfilter,
    "op5_pieces": pieces.op5_pieces,
    "op6_pii": pii.op6_pii,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_spotsigs": spotsigs.op10_spotsigs,
    "op11_substrings": substrings.op11_substrings,
    "op12_runs": runs.op12_runs,
    "op13_importance": importance.op13_importance,
}

ORACLES = {"op4_urlfilter": urlfilter.OP4_SQL, "op11_substrings": substrings.OP11_SQL, "op12_runs": runs.OP12_SQL, "op13_importance": importance.OP13_SQL}
