"""The queries of this subpackage, each over its whole tables, and the SQL of those that SQL can express.

Left out of SQL: op2 (its lexer's spans), op5, op8 and op10 (trained models), op6 (XXH64) and op9 (byte-level BPE). They are
tested against brute force, exact round trips or held-out accuracy in tests/llm."""

from skiff.llm import bpe, chat, decontaminate, embeddings, language, secrets, simhash, suffix_tree, toxicity, warc


def queries():
    return {
        "op1_decontamination": decontaminate.query,
        "op2_secrets": secrets.query,
        "op3_embedding_dedup": embeddings.query,
        "op4_chat_format": chat.query,
        "op5_language_id": language.query,
        "op6_simhash_dedup": simhash.query,
        "op7_warc_convert": warc.query,
        "op8_toxicity": toxicity.query,
        "op9_bpe": bpe.query,
        "op10_lm_score": suffix_tree.query,
    }


def oracle_sql():
    return {"op1_decontamination": decontaminate.SQL, "op3_embedding_dedup": embeddings.SQL, "op4_chat_format": chat.SQL, "op7_warc_convert": warc.SQL}
