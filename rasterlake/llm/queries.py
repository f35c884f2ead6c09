"""The queries of this subpackage, and SQL for those that SQL can express."""

from rasterlake.llm import bpe, chat, decontaminate, embeddings, html_extract, jaccard, licenses, quality, repair, resample, sanitise, sharding, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_html": html_extract.op2_html,
    "op3_warc": warc.op3_warc,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_hilbert": sharding.op5_hilbert,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality": quality.op7_quality,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_licenses": licenses.op9_licenses,
    "op10_chat": chat.op10_chat,
    "op11_resample": resample.op11_resample,
    "op12_sanitise": sanitise.op12_sanitise,
    "op13_repair": repair.op13_repair,
}
ORACLE_SQL = {
    "op3_warc": warc.OP3_SQL,
    "op4_jaccard": jaccard.OP4_SQL,
    "op5_hilbert": sharding.OP5_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op8_embeddings": embeddings.OP8_SQL,
    "op9_licenses": licenses.OP9_SQL,
    "op10_chat": chat.OP10_SQL,
    "op11_resample": resample.OP11_SQL,
    "op12_sanitise": sanitise.OP12_SQL,
    "op13_repair": repair.OP13_SQL,
}
