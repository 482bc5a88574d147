import hashlib
import re
import time

from pyspark.sql import functions as F

from veriscope.llm import pii

CARD, IBAN = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if ok(m)] for k, p, ok in kinds]
    return (*map(len, found), hashlib.sha256(",".join(x for f in found for x in f).encode()).hexdigest())


TEXTS = [
    None, "", "plain", "a@b.c_d@e.f x@y x@y.z. é@é.com a.b@c-d.e-f", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 0000001.1.1.1 9999999999999.1.1.1 10.0.0.1",
    f"ü card {CARD}, {CARD}1 4111-1111-1111-1111 4111  1111 5500005555555559 1 2 3", "+1 (555) 010-2030 +1 2 ++49 30 901820 +12345678901234567 +1(", f"bank {IBAN} and DE89 3704 0044 0532 0130 01",
    "x" * 30_000 + "@a.b " + "1" * 30_000 + " " + "1-" * 20_000 + "@" * 1000, "ssn 123-45-6789 and 123-45-6789", "a@b" + ".c" * 20_000, "1." * 20_000, "+" * 500 + "1 " * 5000,
    "😀 a@b.cd 😀 1.1.1.1",
]


def test_base_matches_brute_force(documents):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "a@b.c")]
    docs = documents(rows).withColumns({"email": F.lit("clash"), "spans": F.lit(1)})
    got = [tuple(r) for r in pii.pii_report(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_checksums_and_context(documents):
    got = {r["doc_id"]: r for r in pii.pii_report(documents(list(enumerate(TEXTS)))).collect()}
    assert got[7]["spans"].split(",")[-1] == "iban:5:32"
    assert got[9]["spans"].count("national_id") == 2
    alone = pii.pii_report(documents([(1, "123-45-6789"), (2, "credit card: " + CARD), (3, "order " + CARD)])).orderBy("doc_id").collect()
    assert alone[0]["spans"] == ""
    assert (alone[1]["scores"], alone[2]["scores"]) == ("100", "60")


def test_many_matches_take_linear_time(documents):
    """One text with 40,000 matches of three kinds: offsets are exact, and the time is of another order than with quadratic sums."""
    text = "".join(f"é u{i}@h{i}.org, 10.0.{i % 256}.7 +1 555 010 {i % 9000 + 1000};\n" for i in range(13_500))
    docs = documents([(1, text)])
    pii.pii_report(documents([(0, TEXTS[3])])).collect()
    began = time.perf_counter()
    got = [tuple(r) for r in pii.pii_report(docs).select("n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()]
    assert got == [brute(text)] and sum(got[0][:4]) > 40_000
    assert time.perf_counter() - began < 60


def test_context_next_to_chunk_edges(documents):
    """The words around a span count wherever the pieces of the text end."""
    rows = [(i, "é" * i + " visa " + CARD + " order") for i in range(470, 515)] + [(1000, "x" * 2000 + " visa" + " " * 34 + CARD), (1001, "visa" + " " * 41 + CARD)]
    got = {r["doc_id"]: r["scores"] for r in pii.pii_report(documents(rows)).collect()}
    assert {got[i] for i in range(470, 515)} == {"80"} and got[1000] == "100" and got[1001] == "80"


def test_no_python_in_the_plan(documents):
    plan = pii.pii_report(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.pii_report(documents([])).count() == 0
