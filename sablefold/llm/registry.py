"""Queries of the training-data operators and the SQL that says the same, where SQL can."""

from __future__ import annotations

from . import ans, bpe, fingerprints, language, mixing, neardup, neighbours, secrets_ledger, sharding, warc

QUERIES = {
    "op1_neardup": neardup.op1_neardup,
    "op2_mixing": mixing.op2_mixing,
    "op3_sharding": sharding.op3_sharding,
    "op4_warc": warc.op4_warc,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_secret_scans": secrets_ledger.op6_secret_scans,
    "op7_language_id": language.op7_language_id,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_bpe": bpe.op9_bpe,
    "op10_token_ids": ans.op10_token_ids,
}

#: The others (signatures, hashes, curves, models, tokenizers) are tested against brute force.
ORACLE = {
    "op2_mixing": mixing.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op6_secret_scans": secrets_ledger.OP6_SQL,
    "op8_neighbours": neighbours.OP8_SQL,
}
