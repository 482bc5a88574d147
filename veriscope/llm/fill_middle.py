"""Fill-in-the-middle: texts rearranged around a middle cut out at token bounds, and their exact restoration.

``regexp_extract_all`` makes the array of a text's units (white space with the word after it; white space at the end is a unit of
its own). Four numbers of 32 bits, ``conv`` of substrings of a ``sha2`` of seed and doc_id, give two cuts among the n + 1 places
between units and choose the form. ``slice`` and ``array_join`` build the parts:

    psm    <P> prefix <S> suffix <M> middle
    spm    <S> suffix <P> prefix <M> middle
    plain  the text as it is

``restored`` parses the sentinels of an output back into the text; it reads output and form alone. A text that holds a sentinel stays
plain, and none can arise across a seam: a sentinel begins with < and ends with >, so the first one found in an output is the one
put there. Built-in functions only; every row is on its own, so nothing is shuffled, and sizes of groups do not matter.

Defined cases: a null text is an empty one, and an empty text is plain with 0 units; a null doc_id is hashed as an empty string;
rows that repeat a doc_id have the same cuts if they have the same number of units; both cuts at one place give an empty
middle; long texts are cut whole. Columns besides doc_id and text pass through ``arranged``, unless they have the name of one that it adds: then they are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Of 100 texts this many are rearranged, and of 100 of these this many as spm.
RATE = 50
SPM_RATE = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
ADDED = ["fim_text", "fim_units", "fim_n", "fim_digest", "fim_low", "fim_high", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output"]


def draw(digest: Column, k: int) -> Column:
    """The k-th number (from 1) of a hexadecimal digest: 8 digits, unsigned."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def arranged(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` with ``fim_n`` (units), ``fim_form``, ``fim_prefix``, ``fim_middle``, ``fim_suffix`` (null if plain) and ``fim_output``."""
    out = docs.select(*[c for c in docs.columns if c.lower() not in ADDED], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("fim_text"))
    out = out.withColumn("fim_units", F.regexp_extract_all("fim_text", F.lit(UNIT), F.lit(0)))
    out = out.withColumns({"fim_n": F.size("fim_units").cast("long"), "fim_digest": F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)})
    first, second = (F.pmod(draw(F.col("fim_digest"), k), F.col("fim_n") + 1).cast("int") for k in (1, 2))
    marked = F.contains("fim_text", F.lit(PREFIX)) | F.contains("fim_text", F.lit(SUFFIX)) | F.contains("fim_text", F.lit(MIDDLE))
    plain = (F.col("fim_n") == 0) | marked | (draw(F.col("fim_digest"), 3) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(F.col("fim_digest"), 4) % 100 < spm_rate, "spm").otherwise("psm")
    out = out.withColumns({"fim_low": F.least(first, second), "fim_high": F.greatest(first, second), "fim_form": form})
    part = lambda start, length: F.when(F.col("fim_form") != "plain", F.array_join(F.slice("fim_units", start, length), ""))
    low, high = F.col("fim_low"), F.col("fim_high")
    out = out.withColumns({"fim_prefix": part(F.lit(1), low), "fim_middle": part(low + 1, high - low), "fim_suffix": part(high + 1, F.col("fim_n").cast("int") - high)})
    psm = F.concat(F.lit(PREFIX), "fim_prefix", F.lit(SUFFIX), "fim_suffix", F.lit(MIDDLE), "fim_middle")
    spm = F.concat(F.lit(SUFFIX), "fim_suffix", F.lit(PREFIX), "fim_prefix", F.lit(MIDDLE), "fim_middle")
    out = out.withColumn("fim_output", F.when(F.col("fim_form") == "psm", psm).when(F.col("fim_form") == "spm", spm).otherwise(F.col("fim_text")))
    return out.drop("fim_text", "fim_units", "fim_digest", "fim_low", "fim_high")


def _two(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the first ``mark`` of a text and what stands after it."""
    before = F.substring_index(text, mark, 1)
    return before, F.substring(text, F.char_length(before) + len(mark) + 1, F.char_length(text))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    body = F.substring(output, len(PREFIX) + 1, F.char_length(output))
    prefix, rest = _two(body, SUFFIX)
    suffix, middle = _two(rest, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = _two(body, PREFIX)
    prefix, middle = _two(rest, MIDDLE)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def fim_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)`` for every row of ``docs``."""
    rows = arranged(docs.select("doc_id", "text"), seed)
    chars = lambda c: F.char_length(c).cast("long")
    return rows.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"),
        chars("fim_prefix").alias("prefix_chars"), chars("fim_middle").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(restored(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )
