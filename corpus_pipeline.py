"""The corpus pipeline: stages that each read what the stage before them wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriscope.llm import line_dedup, mixing, packing, quality, simhash_dedup
from veriscope.session import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null or empty text is scored like any other; equal texts share a score, so ties and repeated rows go or stay together; long texts
    are scored whole; without labels of both classes, or without documents, nothing is rejected."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more documents repeat, but for the largest doc_id that holds one.

    No document goes: one whose lines all go keeps an empty text. A null text stays null, a null doc_id loses and counts
    nothing, rows that repeat a doc_id are one holder, and an empty table stays one."""
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles, the smallest doc_id.

    SimHash fingerprints within four bits lead documents to each other first; since four bits do not reach down to 0.8, an exact prefix filter over
    the shingles finds the other pairs, and exact sets decide on all of them (``shingle_links``).
    Texts without words (null, empty, white space) are one group; rows that repeat the kept doc_id all stay, as do rows with a
    null doc_id; long texts count whole."""
    return simhash_dedup.drop_near_duplicates(docs, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the curriculum draws them, repeats included.

    A document without words is never drawn; a null source is a source; equal rows each have their own draws, and ties in position
    go by doc_id. Documents are drawn whole, whatever their length: a copy that is taken by half or more."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their length bucket and batch.

    A text without words has length 0; no text is cut, and one beyond the budget is a batch of its own; drawn copies each take a
    place; columns named pack_* are replaced."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack),
]

#: The classifier is trained, so SQL cannot give the rows; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
