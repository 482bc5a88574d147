import json
import time

from veriscope.streaming import run_log

SCHEMA = "i long, v double, note string"


def write(folder, name, records, torn=""):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records) + torn)
    time.sleep(1.1)  # file times have a second's resolution


def state(spark, target):
    return {r["i"]: (r["v"], r["note"]) for r in run_log.table(spark, target, "i").collect()}


def test_last_record_wins_and_replays_change_nothing(spark, tmp_path):
    source, target, mark = tmp_path / "log", str(tmp_path / "table"), str(tmp_path / "mark")
    source.mkdir()
    write(source, "b.jsonl", [{"i": 1, "v": 1.0}, {"i": 2, "v": 2.0}, {"i": 1, "v": 1.5, "note": "again"}], '{"i": 3, "v"')
    write(source, "a.jsonl", [{"i": 2, "v": 9.0}, {"v": 7.0}, {"i": None}])
    run = lambda: run_log.follow(spark, str(source), target, mark, SCHEMA, "i").awaitTermination(120)
    assert run()
    assert state(spark, target) == {1: (1.5, "again"), 2: (9.0, None)}
    write(source, "c.jsonl", [{"i": 1, "v": 3.0}, {"i": 4, "v": 4.0, "note": "é"}], "no json}\n")
    assert run()
    want = {1: (3.0, None), 2: (9.0, None), 4: (4.0, "é")}
    assert state(spark, target) == want
    assert run() and state(spark, target) == want
    # the last batch once more, as after a crash between its write and its commit
    batches = sorted(p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("batch="))
    lines = spark.read.text(str(source / "c.jsonl"))
    schema = spark.createDataFrame([], SCHEMA).schema
    run_log.merge_batch(target, "i")(run_log.parsed(lines, schema, "i"), int(batches[-1].partition("=")[2]))
    assert state(spark, target) == want and sorted(p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("batch=")) == batches
    run_log.compacted(spark, target, str(tmp_path / "folded"), "i")
    assert state(spark, str(tmp_path / "folded")) == want
