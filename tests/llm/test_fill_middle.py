import hashlib
import re

from pyspark.sql import functions as F

from veriscope.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(i, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    d = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (i, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 80
    return (i, n, "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text))


def cases():
    texts = ["", None, " ", "one", "  two words \n", "a\x0bb\x0cc\r\n\td ", "thé naïve 𝒳𝒴 日本 x", "< <P <S> not", "<P>", "x<M>y", "<", "a <S", "<S <P <M", "P> a S> b M>", "\x85 nel", "w " * 40_000, "x" * 100_000, "\n" * 5_000]
    return [(i, texts[i % len(texts)]) for i in range(40 * len(texts))] + [(None, "no id at all"), (None, None), (-5, "minus five here"), (3, "one"), (3, "one")]


def test_matches_brute_force(spark):
    df = spark.createDataFrame(cases(), "doc_id long, text string").withColumns({"fim_n": F.lit("clash"), "form": F.lit(1), "units": F.lit(2)})
    rows = [tuple(r) for r in M.fim_report(df).collect()]
    assert sorted(rows, key=str) == sorted((brute(*c) for c in cases()), key=str)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}


def test_extra_columns_pass_and_texts_come_back(spark):
    df = spark.createDataFrame([(i, f"word{i} and more <S of it > here {i}\n") for i in range(200)], "doc_id long, text string").withColumns({"form": F.lit("mine"), "fim_text": F.lit("x"), "n": F.lit(7)})
    out = M.arranged(df)
    assert out.columns == ["doc_id", "text", "form", "n", "fim_n", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output"]
    got = out.select("text", "form", "n", M.restored(F.col("fim_output"), F.col("fim_form")).alias("back"), "fim_form").collect()
    assert all(r["text"] == r["back"] and r["form"] == "mine" and r["n"] == 7 for r in got) and {r["fim_form"] for r in got} == {"plain", "psm", "spm"}


def test_native_and_empty(spark):
    df = spark.createDataFrame(cases()[:2], "doc_id long, text string")
    plan = M.fim_report(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.rpartition("== Physical Plan ==")[2].count("regexp_extract_all") == 1
    assert M.fim_report(df.limit(0)).count() == 0
