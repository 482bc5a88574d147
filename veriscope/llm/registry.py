"""The queries of this subpackage, with production parameters on whole tables."""

from __future__ import annotations

from ..session import table
from . import fill_middle, itq_dedup, license_scan, line_dedup, media_chunks, mixing, packing, pii, quality, simhash_dedup, suffix_dedup, token_alignment, toxicity
from .sql import EMBEDDING_SQL, FILL_MIDDLE_SQL, LICENSE_SQL, LINE_DEDUP_SQL, MIXING_SQL, PACKING_SQL, PII_SQL


def op1_toxicity_crf(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_itq_dedup(spark, sf_dir):
    return itq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_media_chunks(spark, sf_dir):
    return media_chunks.media_report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_pii_spans(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark, sf_dir):
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op7_source_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_quality_subword(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark, sf_dir):
    return license_scan.license_report(license_scan.document_paths(table(spark, sf_dir, "documents")))


def op10_packing(spark, sf_dir):
    return packing.pack_report(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_report(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark, sf_dir):
    return token_alignment.alignment_report(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark, sf_dir):
    return fill_middle.fim_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity_crf, op2_itq_dedup, op3_media_chunks, op4_line_dedup, op5_pii_spans, op6_simhash_dedup, op7_source_mixing, op8_quality_subword, op9_license_scan, op10_packing, op11_suffix_dedup, op12_token_alignment, op13_fill_middle)}
ORACLE_SQL = {"op2_itq_dedup": EMBEDDING_SQL, "op4_line_dedup": LINE_DEDUP_SQL, "op5_pii_spans": PII_SQL, "op7_source_mixing": MIXING_SQL, "op9_license_scan": LICENSE_SQL, "op10_packing": PACKING_SQL, "op13_fill_middle": FILL_MIDDLE_SQL}
