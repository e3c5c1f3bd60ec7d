"""Queries of the training-data operators over the whole tables, and their DuckDB oracles."""

from __future__ import annotations

from spanloom.llm import alignment, ann, decontaminate, embed_dedup, jaccard, langid, licenses, mixing, packing, sharding, spelling, token_counts, warc

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_packing": packing.op2,
    "op3_jaccard_join": jaccard.op3,
    "op4_warc": warc.op4,
    "op5_sharding": sharding.op5,
    "op6_license_scan": licenses.op6,
    "op7_token_counts": token_counts.op7,
    "op8_nearest": ann.op8,
    "op9_embedding_dedup": embed_dedup.op9,
    "op10_language_id": langid.op10,
    "op11_decontaminate": decontaminate.op11,
    "op12_spelling": spelling.op12,
    "op13_alignment": alignment.op13,
}

ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_jaccard_join": jaccard.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_sharding": sharding.OP5_SQL,
    "op8_nearest": ann.OP8_SQL,
    "op9_embedding_dedup": embed_dedup.OP9_SQL,
    "op11_decontaminate": decontaminate.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
}
