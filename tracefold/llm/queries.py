"""Named queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    chat, embeddings, hardnegatives, linededup, mixing, neighbours, quality, repeats, secrets, sentencepiece_fst, simhash, spelling, warc,
)

QUERIES = {
    "op1_embedding_dedup": embeddings.op1_embedding_dedup,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op4_repeats": repeats.op4_repeats,
    "op5_secrets": secrets.op5_secrets,
    "op6_sentencepiece": sentencepiece_fst.op6_sentencepiece,
    "op7_simhash": simhash.op7_simhash,
    "op8_chat": chat.op8_chat,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_hard_negatives": hardnegatives.op11_hard_negatives,
    "op12_spelling": spelling.op12_spelling,
    "op13_warc": warc.op13_warc,
}

ORACLE = {
    "op3_mixing": mixing.OP3_SQL,
    "op8_chat": chat.OP8_SQL,
    "op11_hard_negatives": hardnegatives.OP11_SQL,
    "op13_warc": warc.OP13_SQL,
}
