"""The registered corpus queries and, where SQL expresses them, their DuckDB oracles."""

from . import bpe, chat, decontaminate, lm, pii, quality, rlz, simhash, suffix_levels, syncmers

QUERIES = {
    "op1_rlz_dedup": rlz.op1_rlz_dedup,
    "op2_suffix_levels": suffix_levels.op2_suffix_levels,
    "op3_syncmer_fingerprints": syncmers.op3_fingerprints,
    "op4_quality": quality.op4_quality,
    "op5_simhash": simhash.op5_simhash,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_gru_lm": lm.op7_gru_lm,
    "op8_bpe": bpe.op8_bpe,
    "op9_pii": pii.op9_pii,
    "op10_chat_windows": chat.op10_chat_windows,
}

SQL = {
    "op1_rlz_dedup": rlz.OP1_SQL,
    "op2_suffix_levels": suffix_levels.OP2_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op10_chat_windows": chat.OP10_SQL,
}
