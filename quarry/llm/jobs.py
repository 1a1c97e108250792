"""The registered queries of this package: ``opN_<name>`` and ``pipeline``."""

from __future__ import annotations

from quarry.llm import (
    chat, codes, exact_dedup, html_text, langid, lexical, licenses, mixing, near_dedup, packing, pii, quality, toxicity)
from quarry.sources.tables import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark, sf):
    return table(spark, sf, "documents")


def op1_probminhash(spark, sf):
    return near_dedup.classes(documents(spark, sf)).drop("text_key")


def op2_compression_bands(spark, sf):
    return quality.measure(documents(spark, sf))


def op3_license_digests(spark, sf):
    return licenses.scan(documents(spark, sf))


def op4_concat_and_cut(spark, sf):
    return packing.pack(documents(spark, sf), tokenizer_path("word_bpe_49k.json"), length=4096, end_id=2)


def op5_poisson_mixing(spark, sf):
    return mixing.query(documents(spark, sf))


def op7_digest_index(spark, sf):
    return exact_dedup.query(spark, documents(spark, sf))


def op8_offset_masks(spark, sf):
    return chat.query(table(spark, sf, "conversations"), tokenizer_path("byte_bpe_50k.json"))


def op6_lexicon_automaton(spark, sf):
    return toxicity.query(documents(spark, sf), table(spark, sf, "labels"))


def op9_wrapper_induction(spark, sf):
    return html_text.extract(table(spark, sf, "pages"))


def op10_crf_pii(spark, sf):
    return pii.detect(documents(spark, sf))


def op11_stratified_search(spark, sf):
    return lexical.query(documents(spark, sf), table(spark, sf, "benchmark"))


def op12_nearest_centroid(spark, sf):
    return langid.query(documents(spark, sf))


def op13_cover_tree_codes(spark, sf):
    return codes.quantise(table(spark, sf, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_probminhash, op2_compression_bands, op3_license_digests, op4_concat_and_cut, op5_poisson_mixing, op6_lexicon_automaton,
    op7_digest_index, op8_offset_masks, op9_wrapper_induction, op10_crf_pii, op11_stratified_search,
    op12_nearest_centroid, op13_cover_tree_codes)}

ORACLE = {"op3_license_digests": licenses.ORACLE, "op5_poisson_mixing": mixing.ORACLE, "op7_digest_index": exact_dedup.ORACLE,
          "op11_stratified_search": lexical.ORACLE, "op13_cover_tree_codes": codes.ORACLE}
