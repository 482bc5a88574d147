import math
import re

from pyspark.sql import functions as F

from veriscope.llm import license_scan as L


def plain(pattern):
    return pattern.replace("*+", "*").replace("++", "+").replace("\\z", "\\Z")


def blocks_of(text):
    if not re.search(L.ANCHOR, text or ""):
        return []
    comment = re.search(plain(L.COMMENT), text)
    lead = comment.group(1) if comment else (m.group(1) if (m := re.search(plain(L.FIRST_LINES), text)) else "")
    return [b for b in dict.fromkeys([lead, text, *re.split(plain(L.BETWEEN), text)]) if re.search(L.ANCHOR, b)]


def brute(rows):
    tokens = lambda s: re.findall(L.TOKEN, s.lower())

    def matcher(candidates, templates):
        words = L.vocabulary(templates)
        n = len(candidates) + len(templates)
        idf = {w: math.log((1 + n) / (1 + sum(w in c for c in map(tokens, candidates)) + sum(w in tokens(t) for _, t in templates))) + 1 for w in words}
        unseen = math.log(1 + n) + 1

        def vector(ts):
            return {t: (ts.count(t) * idf[t] if t in idf else unseen) for t in set(ts)}

        def cosine(a, b):
            norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            return round(sum(v * b.get(t, 0) for t, v in a.items()) / norm, 6) if norm else 0.0

        vectors = [(name, vector(tokens(t))) for name, t in templates]

        def best(x):
            own = vector(tokens(x))
            return min((-cosine(own, v), name) for name, v in vectors)

        return best

    anchored = {k: [x for x in (t or "").split("\n") if re.search(L.ANCHOR, x)] for k, (_, _, t) in enumerate(rows)}
    parts = {k: blocks_of(t) for k, (_, _, t) in enumerate(rows)}
    of_line, of_block = matcher([x for v in anchored.values() for x in v], L.TEMPLATES), matcher([x for v in parts.values() for x in v], L.BLOCKS)
    own, owners = {}, {}
    for k, (_, path, text) in enumerate(rows):
        lines = [(m, len(x)) for x in anchored[k] if -(m := of_line(x))[0] >= L.THRESHOLD]
        found = [(m, x == text) for x in parts[k] if -(m := of_block(x))[0] >= L.THRESHOLD]
        if lines or found:
            own[k] = min(m for m, _ in [*lines, *found])
            named = path is not None and re.search(L.FILE_NAME, path.split("/")[-1])
            if named or any(w for _, w in found) or 2 * sum(c for _, c in lines) >= len(text):
                d = path.rpartition("/")[0] if path else ""
                owners[d] = min(owners.get(d, (0, "~")), own[k])
    out = []
    for k, (i, path, _) in enumerate(rows):
        d = path.rpartition("/")[0] if path else ""
        if k in own:
            out.append((i, own[k][1], "header"))
            continue
        while d and d not in owners:
            d = d.rpartition("/")[0]
        out.append((i, owners[d][1], "inherited") if d in owners else (i, None, "none"))
    return sorted(out, key=str)


def cases():
    body = "some code\nand more of it\n" * 20
    return [
        (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files\n" + body),
        (2, "a/x.py", body), (3, "a/b/y.py", body), (4, "a/b/c/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (5, "a/b/c/d/z.py", body),
        (6, "a/b/own.py", "# Licensed under CC BY-NC 4.0.\n" + body), (7, "other/q.py", body), (8, "top.py", body), (9, None, body), (10, "a/b/w.py", None), (11, "a/b/v.py", ""),
        (12, "a/b/c/LICENSE.txt", "Released under the MIT License."), (13, "z/talk.md", "we talk about a licence in general terms, at some length and with no name"),
        (14, "z/long.md", "licence " + "word " * 50_000), (3, "a/b/y.py", body), (None, "a/n.py", body), (15, "gpl/s", "This work is licensed under the GNU General Public License, version 3."), (16, "gpl/t/u/v", "x"),
    ]


def test_matches_brute_force(spark):
    df = spark.createDataFrame(cases(), "doc_id long, path string, text string").withColumns({"license": F.lit("clash"), "lic_dir": F.lit("x"), "depth": F.lit(1)})
    rows = L.license_report(df).collect()
    assert sorted(((r["doc_id"], r["license"], r["origin"]) for r in rows), key=str) == brute(cases())
    got = {(r["doc_id"], r["path"]): r for r in rows}
    assert got[5, "a/b/c/d/z.py"]["license"] == "Apache-2.0" and got[3, "a/b/y.py"]["license"] == "MIT" and got[6, "a/b/own.py"]["license"] == "CC-BY-NC-4.0"
    assert got[16, "gpl/t/u/v"]["origin"] == "inherited" and got[13, "z/talk.md"]["origin"] == "none"


def test_null_parts_of_paths(spark, documents):
    docs = documents([(1, "Released under the MIT License.", None), (2, "code", None), (3, "code", "en"), (None, "code", None)])
    got = {r["path"]: r["origin"] for r in L.license_report(L.document_paths(docs)).collect()}
    assert got == {"(null)/en/0/1": "header", "(null)/en/0/2": "inherited", "en/en/0/3": "none", "(null)/en/(null)/(null)": "none"}


def test_native_and_empty(spark):
    df = spark.createDataFrame(cases()[:2], "doc_id long, path string, text string")
    plan = L.headers(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert L.license_report(df.limit(0)).count() == 0
    assert all(re.search("|".join(L.HINTS), alternative) for alternative in ("licens", "licenc", *re.sub(r"^\(\?i\)licen\[cs\]\|", "", L.ANCHOR).split("|")))


def test_wrapped_headers_and_whole_texts(spark):
    import textwrap

    body = "\n\n" + "some code\nand more of it\n" * 200
    texts = {name: t for name, t in L.BLOCKS if re.search("Licensed under|redistribute it|THE SOFTWARE IS", t)}
    wrapped = lambda name, mark: "\n".join(mark + x for x in textwrap.wrap(texts[name], 50))
    rows = [
        (1, "p/gpl.py", "#!/usr/bin/python\n# Copyright 2020 Some Body\n" + wrapped("GPL-3.0", "# ") + body), (2, "p/apache.c", texts["Apache-2.0"] + body),
        (3, "p/lgpl.c", "/*\n" + wrapped("LGPL-3.0", " * ") + "\n */" + body), (4, "q/terms", "Copyright 2021 Any One\n\n" + wrapped("MIT", "")), (5, "q/r/code.py", body),
        (6, "p/none.py", "# nothing is licensed here\n" + body),
        (7, "p/long.py", "# licensed words\n" * 30_000), (8, "p/lines.txt", "licensed words\r\n" * 30_000),
    ]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in L.license_report(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("GPL-3.0", "header"), 2: ("Apache-2.0", "header"), 3: ("LGPL-3.0", "header"), 4: ("MIT", "header"), 5: ("MIT", "inherited"), 6: (None, "none"), 7: (None, "none"), 8: (None, "none")}


APACHE = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n"
GPL = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n"
MPL = "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n"
CC = "Attribution-ShareAlike 4.0 International\n\n=======================================================================\n\nCreative Commons Attribution-ShareAlike 4.0 International Public\nLicense\n\nBy exercising the Licensed Rights (defined below), You accept and agree\nto be bound by the terms and conditions of this Creative Commons\nAttribution-ShareAlike 4.0 International Public License (\"Public\nLicense\").\n\n"


def real_files():
    """Openings of the real licence files, with terms behind them, and what lies beside them."""
    terms = "".join(f'      "Term{i}" shall mean the thing numbered {i} as defined by the sections of this document.\n\n' for i in range(20))
    rows = [(1, "a/LICENSE", APACHE + terms), (3, "b/COPYING", GPL + terms), (5, "c/LICENSE", MPL + terms), (7, "d/LICENSE.txt", CC + terms)]
    rows += [(9, "e/COPYING.LESSER", GPL.replace("GENERAL", "LESSER GENERAL") + terms), (11, "f/COPYING", GPL.replace("3, 29 June 2007", "2, June 1991") + terms), (13, "g/LICENSE", "The MIT License (MIT)\n\nCopyright (c) 2020 Some Body\n\n" + terms)]
    return rows + [(i + 1, path.rpartition("/")[0] + "/src/code.py", "print(1)\n") for i, path, _ in rows]


def test_real_files(spark):
    want = {1: "Apache-2.0", 3: "GPL-3.0", 5: "MPL-2.0", 7: "CC-BY-SA-4.0", 9: "LGPL-3.0", 11: "GPL-2.0", 13: "MIT"}
    notice = dict(L.BLOCKS)["MIT"]
    grant, end = L._GRANT, notice[len(L._GRANT) + 1 :]
    rows = [*real_files(), (50, "x/run.py", f"#!/usr/bin/env python\n\n\"\"\"A tool.\n\n{grant}\n\n{end}\n\"\"\"\n" + "code = 1\n" * 300), (51, "x/readme.md", "# License\n\nsome words\n\n## Copyright\n\nother words\n")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in L.license_report(df).collect()}
    assert got == {i: (name, "header") for i, name in want.items()} | {i + 1: (name, "inherited") for i, name in want.items()} | {50: ("MIT", "header"), 51: (None, "none")}
    assert sorted(((i, *v) for i, v in got.items()), key=str) == brute(rows)


def test_sql_sees_blocks(spark, tmp_path):
    import duckdb

    from veriscope.llm.sql import LICENSE_SQL

    rows = [(64 * k + i, t, "en", p.split("/")[0], len(t)) for k, (i, p, t) in enumerate(real_files())] + [(9000, "Released under the MIT License.", "en", "a", 31), (9001, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    columns = ["doc_id", "path", "license", "score", "origin", "n_header_lines"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({LICENSE_SQL})").fetchall()
    got = [tuple(r) for r in L.license_report(L.document_paths(docs)).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[4] == "header" and r[5] == 0 for r in got) >= 3
