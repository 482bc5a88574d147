r"""Personal data: patterns propose, checksums confirm, context words weigh.

Everything is built-in functions. A pattern's matches come from
``regexp_extract_all`` and the text between them from ``split``; running sums of
their lengths, by doubling, give code point offsets, and context is cut from pieces of the text, so a text with
very many matches takes n log n steps. Patterns are possessive and may begin only
at the edge of their character class or where the last match ended (``\G``), which
leaves the leftmost matches as they are but makes a scan linear in the text's
length and free of recursion, so very long texts without white space are safe.

Kinds: email, ip, card, phone are the base and always stay once their own test
passes (parts at most 255; Luhn; digit counts). The method adds iban (mod-97) and
national_id (three-two-four digits), each span with a score in percent: a prior for its kind,
more for a checksum, more or less for words within ``CONTEXT`` code points. Added
spans need ``KEEP`` percent.

Defined cases: a null text is empty and has no spans; base_sha256 is then the hash of
the empty string. Rows are independent, so repeated rows, ties and null ids need no
rule. Extra columns are ignored by the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:(?<![0-9])(?<![0-9][\x20-])|\G)[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])"
NATIONAL = r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])"
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id")
CONTEXT = 40
CHUNK = 512
KEEP = 60
#: Percent: the kind's prior, and what a passed checksum adds.
PRIOR = {"email": (80, 0), "ip": (60, 0), "card": (40, 40), "phone": (60, 0), "iban": (30, 50), "national_id": (40, 0)}
#: Words near a span that raise its score by 20, and words that lower it by 20.
FOR = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "national_id": "ssn|social security|national id|identity",
}
AGAINST = "version|isbn|order|serial|part no|example"
#: A cheap test that every match of the kind passes.
HINT = {
    "email": "contains(text, '@')",
    "ip": r"text rlike r'[0-9]\.[0-9]'",
    "card": r"text rlike r'[0-9](?:[\x20-]?[0-9]){12}'",
    "phone": "contains(text, '+')",
    "iban": r"text rlike r'[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}'",
    "national_id": r"text rlike r'[0-9]{3}-[0-9]{2}-[0-9]{4}'",
}
PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "national_id": NATIONAL}
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def running_totals(values: Column) -> Column:
    """Running sums of an array of longs by doubling: n log n steps, and no array grows element by element."""

    def double(acc: Column, shift: Column) -> Column:
        shifted = F.concat(F.array_repeat(F.lit(0).cast("long"), shift), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - shift, F.lit(0))))
        return F.when(shift < F.size(acc), F.zip_with(acc, shifted, lambda x, y: x + y)).otherwise(acc)

    return F.aggregate(F.lit([1 << k for k in range(31)]), values, double)


def matches(kind: str) -> Column:
    """All raw matches of a kind in ``text``: array of (start, end, found), code points from 0."""
    text, pattern = F.col("text"), PATTERN[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        found,
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)),
        lambda found, gap: F.struct((F.char_length(gap) + F.char_length(found)).cast("long").alias("step"), F.char_length(found).cast("long").alias("n"), found.alias("found")),
    )
    spans = F.zip_with(
        pairs,
        running_totals(F.transform(pairs, lambda p: p["step"])),
        lambda p, end: F.struct((end - p["n"]).alias("start"), end.alias("end"), p["found"].alias("found")),
    )
    return F.when(F.expr(HINT[kind]), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,found:string>>"))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1)))

    def add(acc: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).try_cast("int")
        twice = F.when(i % 2 == 0, digit * 2).otherwise(digit)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(found: Column) -> Column:
    packed = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(packed, F.lit(5), F.char_length(packed)), F.substring(packed, F.lit(1), F.lit(4)))

    def add(acc: Column, char: Column) -> Column:
        value = F.instr(F.lit(ALPHABET), char) - 1
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.char_length(packed).between(15, 34) & (F.aggregate(chars, F.lit(0), add) == 1)


def confirmed(kind: str, spans: Column) -> Column:
    """The spans that pass their kind's test."""
    tests = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.forall(F.split(s["found"], r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))) <= 3)
        & F.forall(F.split(s["found"], r"\."), lambda p: F.right(F.concat(F.lit("000"), p), F.lit(3)).try_cast("int") <= 255),
        "card": lambda s: F.char_length(_digits(s["found"])).between(13, 19) & luhn(_digits(s["found"])),
        "phone": lambda s: F.char_length(_digits(s["found"])).between(9, 15),
        "iban": lambda s: mod97(s["found"]),
        "national_id": lambda s: ~s["found"].rlike("^(000|666|9)|-00-|-0000$"),
    }
    return F.filter(spans, tests[kind])


def chunked() -> Column:
    """``text`` in pieces of CHUNK code points, so that a span's context is cut from at most two of them and not counted from the text's start."""
    return F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _window(chunks: Column, start: Column, length: Column) -> Column:
    """The ``length`` (at most CHUNK) code points from ``start`` on."""
    k = F.floor(start / CHUNK).cast("int")
    piece = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    return F.substring(F.concat(piece(k), piece(k + 1)), (start - k * CHUNK).cast("int") + 1, length.cast("int"))


def scored(kind: str, spans: Column, chunks: Column) -> Column:
    """Each span with its kind and its score in percent after its context."""
    prior, checksum = PRIOR[kind]

    def one(span: Column) -> Column:
        before = _window(chunks, F.greatest(span["start"] - CONTEXT, F.lit(0)), F.least(span["start"], F.lit(CONTEXT)))
        after = _window(chunks, span["end"], F.lit(CONTEXT))
        near = F.lower(F.concat(before, F.lit(" "), after))
        score = F.lit(prior + checksum) + F.when(near.rlike(rf"(?<![a-z0-9_])(?:{FOR[kind]})"), 20).otherwise(0) - F.when(near.rlike(rf"(?<![a-z0-9_])(?:{AGAINST})"), 20).otherwise(0)
        return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.least(F.lit(100), score).cast("int").alias("score"))

    return F.transform(spans, one)


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` and, by kind, an array of (kind, start, end, score): base spans, and added ones that reach KEEP."""
    raw = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    raw = raw.withColumns({kind: matches(kind) for kind in PATTERN})
    raw = raw.withColumns({kind: F.when(F.size(kind) > 0, confirmed(kind, F.col(kind))) for kind in PATTERN})
    some = F.coalesce(*[F.when(F.size(kind) > 0, F.lit(True)) for kind in PATTERN])
    raw = raw.withColumn("pii_chunks", F.when(some, chunked()))
    kept = raw.withColumns({kind: F.when(F.size(kind) > 0, scored(kind, F.col(kind), F.col("pii_chunks"))) for kind in PATTERN})
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:int>>")
    kept = kept.withColumns({kind: F.coalesce(kind, empty) for kind in PATTERN}).drop("pii_chunks")
    return kept.withColumns({kind: F.filter(kind, lambda s: s["score"] >= KEEP) for kind in ADDED})


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores)`` for every row."""
    found = find_spans(docs.select("doc_id", "text"))
    every = F.concat(*BASE, *ADDED)
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(F.concat(*BASE)), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.array_join(F.transform(every, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
