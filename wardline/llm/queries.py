"""The queries of this package, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from wardline.llm import bpe, chat, decontaminate, divergence, html_text, jaccard, licence, merkle
from wardline.llm import piece_bpe, quality_crf, quality_rules, suffix_dedup, toxicity
from wardline.llm.common import table


def op1_licence_scan(spark, sf_dir):
    return licence.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_format(spark, sf_dir):
    turns = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_chats(turns))


def op5_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_piece_round_trip(spark, sf_dir):
    return piece_bpe.round_trip(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"), merkle.without_newlines())


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_licence_scan,
        op2_html_text,
        op3_decontamination,
        op4_chat_format,
        op5_bpe_round_trip,
        op6_quality_classifier,
        op7_ngram_jaccard,
        op8_quality_rules,
        op9_suffix_dedup,
        op10_toxicity,
        op11_piece_round_trip,
        op12_merkle_manifest,
        op13_source_divergence,
    )
}
ORACLES = {
    "op8_quality_rules": quality_rules.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
