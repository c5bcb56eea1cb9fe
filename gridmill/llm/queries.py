"""The queries of the training-data operators and, where SQL can express them, the same in DuckDB's SQL."""

from . import audio, bpe, chat, decontam, html, neardup, pii, quality, tokenfile, urls

QUERIES = {
    "op1_audio": audio.op1_audio,
    "op2_bpe": bpe.op2_bpe,
    "op3_tokenfile": tokenfile.op3_tokenfile,
    "op4_decontam": decontam.op4_decontam,
    "op5_chat": chat.op5_chat,
    "op6_pii": pii.op6_pii,
    "op7_neardup": neardup.op7_neardup,
    "op8_quality": quality.op8_quality,
    "op9_html": html.op9_html,
    "op10_urls": urls.op10_urls,
}

SQL = {"op5_chat": chat.OP5_SQL, "op7_neardup": neardup.OP7_SQL, "op10_urls": urls.OP10_SQL}
