import re

import pytest
from pyspark.sql import functions as F

from veriscope.llm import mixing


def waterfill(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def rows():
    out = [(i, "w " * (i % 7 * 10 + 1), f"s{i % 5}") for i in range(200)]
    out += [(500, "tiny", "a"), (501, None, "b"), (502, "", "b"), (503, "x\x0by z q", None), (504, "long " * 40_000, "s1"), (None, "no id here", "s2")]
    return out + [(7, "again and again", "s2"), (7, "again and again", "s2")]


def test_report(documents):
    data = rows()
    got = mixing.mix_report(documents(data)).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, source in data:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = waterfill(sizes)
    by_size = {sizes[s]: s for s in sizes}
    taken = {}
    for r in got:
        source = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(target[source])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        taken[source] = taken.get(source, 0) + r["taken"]
    for s in target:
        assert taken[s] == int(target[s] + 1e-9)
    assert [tuple(r) for r in got] == [tuple(r) for r in mixing.mix_report(documents(list(reversed(data))).repartition(7)).collect()]


def test_positions_follow_the_schedule(documents):
    got = mixing.mix_report(documents([(i, "w " * 10, f"s{i % 3}") for i in range(3000)])).where("taken > 0").collect()
    at = [r["position"] for r in got]
    assert at == sorted(at) and 0 <= at[0] and at[-1] < 1
    early = [r for r in got if r["position"] < 0.5]
    share = lambda group, target: sum(r["size"] for r in group if r["target"] == target) / target  # noqa: E731  first copies
    targets = sorted({r["target"] for r in got})
    assert share(early, targets[0]) > 0.55 and 0.45 < share(early, targets[1]) < 0.55 and share(early, targets[2]) < 0.45


def test_documents_repeat_as_taken(documents):
    data = [r for r in rows()]
    docs = documents(data).withColumns({"size": F.lit(0), "mix_key": F.lit("k")})
    out = mixing.mix_documents(docs)
    assert out.schema == docs.schema
    report = {}
    for r in mixing.mix_report(docs).collect():
        report.setdefault(r["doc_id"], []).append((r["size"], r["taken"]))
    seen = {}
    for r in out.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    for i, sizes in report.items():
        exact = sum(t / s for s, t in sizes if s)
        assert abs(seen.get(i, 0) - exact) <= 0.5 * len(sizes) + 1e-9


def test_empty(documents):
    assert mixing.mix_report(documents([])).count() == 0
    assert mixing.mix_documents(documents([])).count() == 0
    assert mixing.mix_report(documents([(1, None), (2, "")])).select("taken").distinct().collect()[0][0] == 0
