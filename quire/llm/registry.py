"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, embeddings, extract, licences, mixture, passages, pii, simhash, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_embeddings": embeddings.op3_embeddings,
    "op4_pii": pii.op4_pii,
    "op5_licences": licences.op5_licences,
    "op6_mixture": mixture.op6_mixture,
    "op7_extract": extract.op7_extract,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_passages": passages.op9_passages,
    "op10_simhash": simhash.op10_simhash,
}
#: The others (4, 7, 8, 10) have no SQL; tests/llm holds them against brute force, labelled pages or held-out labels.
ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op3_embeddings": embeddings.OP3_SQL,
    "op5_licences": licences.OP5_SQL,
    "op6_mixture": mixture.OP6_SQL,
    "op9_passages": passages.OP9_SQL,
}
