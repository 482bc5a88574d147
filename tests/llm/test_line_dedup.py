import hashlib
import re

from pyspark.sql import functions as F

from veriscope.llm import line_dedup

LONG = "This is a Passage of over forty characters that repeats"


def brute(rows):
    space = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: space.sub("", line).translate(low)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 5 or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rows = [(i, f"own line of document {i} which is long enough to be a key\n  {LONG.upper()}\t\n{LONG}\nshort") for i in range(7)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "é" * 39 + "x"), (24, "é" * 40), (25, LONG + "\x0b\x0c\r"), (26, LONG + " ")]
    rows += [(30 + i, "é" * 40 + "\nÉ" + "é" * 39) for i in range(5)]
    rows += [(None, LONG), (6, LONG), (6, LONG)]  # repeated rows, and one without an id
    rows += [(50, "word " * 60_000 + "\n" + LONG)]
    return rows


def test_report_matches_brute_force(documents):
    rows = cases()
    got = [tuple(r) for r in line_dedup.line_report(documents(rows)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_batches_and_levels_do_not_matter(documents):
    docs = documents(cases())
    hashes = line_dedup.line_hashes(docs).cache()
    one = {tuple(r) for r in line_dedup.repeated_keys(hashes, 1).collect()}
    assert one and one == {tuple(r) for r in line_dedup.repeated_keys(hashes, 5).collect()}


def label(rows):
    return {(r["hi"], r["lo"]): (r["n_docs"], r["last_doc"]) for r in rows}


def test_runs_hold_a_key_once(spark):
    """Keys of earlier batches must not enter a new run: totals go wrong if the anti-join lets them through."""
    batches = [[(1, 10), (2, 11)], [(1, 20), (3, 21)], [(1, 5), (2, 30), (3, 31)], [(4, 40)], [(1, 50), (4, 41)]]
    runs = line_dedup.LineRuns(spark)
    for rows in batches:
        runs.add(spark.createDataFrame([(k, -k, 1, d) for k, d in rows], "hi long, lo long, n_docs long, last_doc long"))
    held = [r["hi"] for run in runs.runs() for r in run.collect()]
    assert sorted(held) == [1, 2, 3, 4] and [len(level) for level in runs.levels] == [1, 0, 1]
    assert label(runs.totals().collect()) == {(1, -1): (4, 50), (2, -2): (2, 30), (3, -3): (2, 31), (4, -4): (2, 41)}
    runs.forget()


def test_merging_runs_shuffles_nothing(spark):
    runs = line_dedup.LineRuns(spark)
    rows = spark.range(200).selectExpr("id as hi", "id as lo", "1L as n_docs", "id as last_doc")
    a, b = (runs._written(rows.groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))) for _ in range(2))
    plan = a.join(b.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.forget()


def test_drop_lines_keeps_columns(spark, documents):
    docs = documents(cases()).withColumns({"__extra": F.lit(1), "drops": F.lit("x"), "hi": F.lit(2)})
    out = line_dedup.drop_lines(docs)
    assert out.schema == docs.schema
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[0]["text"].count(LONG) == 0 and rows[50]["text"].endswith(LONG)
    assert rows[0]["n_chars"] == len(rows[0]["text"]) and rows[0]["drops"] == "x"


def test_empty_table(documents):
    assert line_dedup.line_report(documents([])).count() == 0
