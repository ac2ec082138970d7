import json

from pyspark.sql import functions as F

from millrace.sources import oracle, records
from millrace.streaming import incremental


def test_jsonl_round_trip(spark, tmp_path):
    schema = "id string, m struct<x:double>, band string"
    assert records.read_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    source = tmp_path / "a.jsonl"
    source.write_text('{"id": "1", "m": {"x": 0.5}}\n\n{"id": "2", "band": "B1"}\n')
    df = records.read_jsonl(spark, str(source), schema)
    assert {r.id: (r.m.x if r.m else None, r.band) for r in df.collect()} == {"1": (0.5, None), "2": (None, "B1")}
    records.write_jsonl(df, str(tmp_path / "out"), ["band"])
    assert records.count_records(spark, str(tmp_path / "out")) == 2


def test_decks(spark, tmp_path):
    (tmp_path / "a.dck").write_bytes("x\xe9\ny\n".encode("latin-1"))
    row = records.read_decks(spark, str(tmp_path), "*.dck").select("cards", records.deck_text("cards").alias("t")).first()
    assert list(row.cards) == ["x\xe9", "y"] and row.t == "x\xe9\ny\n"


def test_paths(spark):
    assert records.record_base("/a/splits/train.jsonl") == "/a" and records.record_base("/a/index.jsonl") == "/a"
    df = spark.sql("select '/old/x' as p, named_struct('q', '/old/y', 'r', 'z') as s")
    out = records.rewrite_prefix(df, ["p", "s.q", "s.r"], "/old", "/new").first()
    assert (out.p, out.s.q, out.s.r) == ("/new/x", "/new/y", "z")
    assert df.select(records.resolve_path("p", "/b").alias("a"), records.resolve_path(F.col("s.r"), "/b").alias("b")).first() == ("/old/x", "/b/z")


def test_summaries_and_lock(spark, tmp_path):
    for name, body in (("a", {"k": 1}), ("b", {"other": 1}), ("skip", {"k": 2})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text(json.dumps(body))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "summary.json").write_text("{")
    got = records.summaries(spark, str(tmp_path), keys=("k",), skip=("skip",)).select("path").collect()
    assert [r.path.split("/")[-2] for r in got] == ["a"]
    assert records.source_lock(spark, str(tmp_path)).count() == 4


def test_oracle_commands(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "fail"), (3, "slow")], "id int, input string")
    script = 'case $(cat {input}) in fail) exit 3;; slow) sleep 5;; *) cp {input} {output};; esac'
    rows = {r.id: r for r in oracle.run_commands(df, ["sh", "-c", script], seconds=1).collect()}
    assert (rows[1].status, rows[1].output) == ("ok", "hello") and rows[2].status == "run_error" and rows[3].status == "timeout"
    assert df.columns == ["id", "input"]


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "k string, v int"
    for rows, want in (([("a", 1), ("a", 2), ("b", 1)], 2), ([("b", 5), ("c", 1)], 3)):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        incremental.run_available(incremental.dedupe(incremental.read_folder(spark, source, schema), ["k"]), target, state)
        assert spark.read.parquet(target).count() == want
    counted = lambda: incremental.run_whole(incremental.progress(incremental.read_folder(spark, source, schema), "k"), f"{target}_k", f"{state}_k")
    assert {r.k: r.n for r in counted().collect()} == {"a": 2, "b": 2, "c": 1}
    assert {r.k: r.n for r in counted().collect()} == {"a": 2, "b": 2, "c": 1}  # nothing new
    spark.createDataFrame([("c", 4)], schema).write.mode("append").parquet(source)
    assert {r.k: r.n for r in counted().collect()} == {"a": 2, "b": 2, "c": 2}
    (tmp_path / "none").mkdir()
    empty = incremental.progress(incremental.read_folder(spark, str(tmp_path / "none"), schema), "k")
    assert incremental.run_whole(empty, f"{target}_0", f"{state}_0").collect() == []


def test_sinks(spark, tmp_path):
    import json as j

    import pytest

    from millrace.sources import sinks

    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.25)], "k string, n int, x double")
    assert j.loads(sinks.json_document(df, "k")) == {"a": {"n": 1, "x": 0.5}, "b": {"n": 2, "x": 0.25}}
    assert "- a: n 1, x 0.5000" in sinks.markdown_report("t", {"s": df})
    path = f"file://{tmp_path}/w"
    with sinks.single_writer(spark, path), pytest.raises(sinks.Locked), sinks.single_writer(spark, path):
        pass
    assert j.loads(sinks.read_text(spark, f"{path}.state"))["status"] == "done"
    with pytest.raises(KeyError), sinks.single_writer(spark, path):
        raise KeyError("x")
    assert j.loads(sinks.read_text(spark, f"{path}.state"))["status"] == "failed"
    assert sinks.archive(df, f"{path}/arch", "k", "n").count() == 2
    rows = spark.createDataFrame([(f"i{k}", f"B{k % 2}", f"h{k}") for k in range(10)], "id string, band string, alpha_hash string")
    index = sinks.slice_dataset({"train": rows, "dev": rows.limit(3)}, f"{path}/cut", {"train": 4}, "s")
    assert {r.split: r.n for r in index.groupBy("split").agg(F.count("*").alias("n")).collect()}["train"] == 4
