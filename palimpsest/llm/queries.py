"""The registered query of each operator, over whole tables with production parameters, and its SQL where there is one."""

from __future__ import annotations

from palimpsest.llm import (chat, decontaminate, hard_negatives, html_extract, line_dedup, minhash, mixing, quality_lm, quality_rules, secret_scan,
    simhash, warc, whitening)
from palimpsest.llm.common import table


def _over(name, digest):
    return lambda spark, sf_dir: digest(table(spark, sf_dir, name))


def queries():
    return {
        "op1_chat_formatting": chat.query,
        "op2_decontamination": decontaminate.query,
        "op3_mixing": _over("documents", mixing.digest),
        "op4_quality_classifier": quality_lm.query,
        "op5_html_extraction": _over("pages", html_extract.extract),
        "op6_quality_rules": _over("documents", quality_rules.digest),
        "op7_warc": warc.query,
        "op8_line_dedup": _over("documents", line_dedup.digest),
        "op9_secret_scan": _over("documents", secret_scan.digest),
        "op10_simhash": _over("documents", simhash.digest),
        "op11_minhash": _over("documents", minhash.digest),
        "op12_hard_negatives": _over("embeddings", hard_negatives.digest),
        "op13_whitening": _over("embeddings", whitening.digest),
    }


def oracle_sql():
    return {
        "op1_chat_formatting": chat.SQL,
        "op6_quality_rules": quality_rules.SQL,
        "op7_warc": warc.SQL,
        "op8_line_dedup": line_dedup.SQL,
        "op9_secret_scan": secret_scan.SQL,
        "op11_minhash": minhash.SQL,
        "op12_hard_negatives": hard_negatives.SQL,
    }
