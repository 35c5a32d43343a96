from __future__ import annotations

import json

from conftest import SMALL

from turnwise import schemas
from turnwise.operators import dedup
from turnwise.plans import plugins
from turnwise.sources import files
from turnwise.sources.tables import table
from turnwise.streaming import snapshots


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps([{"instruction": "i", "input": "x", "output": "y"}, {"input": "z"}]))
    (tmp_path / "sub" / "b.jsonl").write_text('{"input": "1"}\n{"input": "2"}\n{broken\n')
    (tmp_path / "c.txt").write_text("not read")
    rows = files.read_records(spark, str(tmp_path), schemas.SAMPLE).cache()
    assert sorted(r.input for r in rows.where("_corrupt IS NULL").collect()) == ["1", "2", "x", "z"]
    assert rows.where("_corrupt IS NOT NULL").count() == 1


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "step int, input string, score int")
    files.write_lines(df, str(tmp_path / "dump"), "append", "step")
    assert spark.read.json(str(tmp_path / "dump")).count() == 2
    got = files.with_responses(df.select("step").distinct(), df.selectExpr("step", "1 - score AS sample_no", "input AS text"), "step").first()
    assert got.responses == ["b", "a"]
    df.write.parquet(str(tmp_path / "p"))
    assert files.read_tables(spark, str(tmp_path / "p"), columns=("input",), optional=("tools",)).columns == ["input", "tools"]


def test_stream_keeps_what_batch_keeps(spark, tmp_path):
    whole = table(spark, SMALL, "dialogue_snapshots")
    whole.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = snapshots.source(spark, str(tmp_path / "in"), whole.schema, 1)
    q = snapshots.upsert_into(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    streamed = {tuple(r) for r in snapshots.latest(spark, str(tmp_path / "out")).collect()}
    assert streamed == {(r.cid, r.kept, r.length) for r in dedup.keep_longest(whole).collect()}


def test_arrivals(spark, tmp_path):
    whole = table(spark, SMALL, "dialogue_snapshots")
    whole.write.parquet(str(tmp_path / "in"))
    q = snapshots.arrivals(snapshots.source(spark, str(tmp_path / "in"), whole.schema)).writeStream.outputMode("complete").format("memory").queryName("arrivals").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM arrivals").first()[0] == whole.count()


def test_services(spark):
    df = spark.createDataFrame([(1, "one two three four"), (2, None)], "id int, prompt string")
    got = {r.id: r.answer for r in plugins.apply(df, plugins.first_words, "prompt", "answer").collect()}
    assert got == {1: "one two three", 2: None}
    assert plugins.shorter_than(df, "prompt", 3).count() == 0 and plugins.shorter_than(df, "prompt", 4).count() == 1


def test_cleaning_and_progress(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "generated_multi_turn_3.jsonl").write_text('{"instruction": "ｉ", "input": "“x”"}\n\n{bad\n')
    got = files.read_cleaned(spark, str(folder), schemas.SAMPLE).collect()
    assert [(r.instruction, r.input, r.output) for r in got] == [("i", '"x"', None)]
    assert files.progress(spark, str(folder), schemas.SAMPLE).count() == 2 and files.progress(spark, str(tmp_path), schemas.SAMPLE).count() == 0
    (tmp_path / "one.json").write_text('{"input": "a"}')
    assert files.read_array_or_object(spark, str(tmp_path / "one.json"), schemas.SAMPLE).first().input == "a"
    try:
        files.read_array_or_object(spark, "x.txt", schemas.SAMPLE)
        raise AssertionError
    except ValueError:
        pass
    nested = spark.createDataFrame([(1, [("ａ", ["。"])])], "k int, x array<struct<s:string,t:array<string>>>")
    assert files.cleaned(nested).first().x == [("a", ["."])]


def test_copies_and_caches(spark, tmp_path):
    source = f"file://{tmp_path}/a/b.txt"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.txt").write_text("1")
    target = files.copy(spark, source, f"file://{tmp_path}/c/b.txt")
    (tmp_path / "a" / "b.txt").write_text("2")
    files.copy(spark, source, target)
    assert (tmp_path / "c" / "b.txt").read_text() == "1"
    files.copy(spark, source, target, again=True)
    assert (tmp_path / "c" / "b.txt").read_text() == "2" and files.exists(spark, target)
    files.make_folder(spark, f"file://{tmp_path}/d")
    assert (tmp_path / "d").is_dir() and files.is_remote("hdfs://x/y") and not files.is_remote("/x") and files.cache_name("s3://b/k/f", "/c") != files.cache_name("s3://b/j/f", "/c")
    asked = []
    compute = lambda: (asked.append(1), spark.range(3))[1]
    assert [files.computed_once(spark, f"file://{tmp_path}/t", compute).count() for _ in range(2)] == [3, 3] and len(asked) == 1


def test_logs(spark, tmp_path):
    m = spark.createDataFrame([("loss", 1.0), ("kl", 0.5)], "name string, value double")
    files.log_metrics(m, str(tmp_path / "log"), 1)
    files.log_metrics(m, str(tmp_path / "log"), 2)
    assert sorted((r.step, r.data.loss) for r in spark.read.json(str(tmp_path / "log")).collect()) == [(1, 1.0), (2, 1.0)]
    a = spark.createDataFrame([("x",)], "s string")
    assert files.sample_table(files.sample_table(None, a, 1), a, 2).count() == 2
    pos = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, t string")
    assert [tuple(r) for r in files.side_by_side(pos, pos, only=(1,)).collect()] == [(1, "b", "b")]
    spark.createDataFrame([("p", "c", "r", 1)], "prompt string, chosen string, rejected string, x int").write.parquet(str(tmp_path / "pref"))
    assert files.preferences(spark, str(tmp_path / "pref")).columns == ["prompt", "chosen", "rejected"]
    files.dump_generations(spark.createDataFrame([(1, "a")], "step int, output string"), str(tmp_path / "gen"))
    assert spark.read.json(str(tmp_path / "gen")).first().output == "a"


def test_samples_and_evaluation_rows(spark, tmp_path):
    spark.range(50).selectExpr("id", "concat('p', id) AS prompt", "array('a') AS responses", "'s' AS data_source", "struct('g' AS ground_truth) AS reward_model").write.parquet(str(tmp_path / "e"))
    path = str(tmp_path / "e")
    assert files.read_samples(spark, path, key="id").count() == 50 and [r.id for r in files.read_samples(spark, path, key="id", most=3).collect()] == [0, 1, 2]
    drawn = [r.id for r in files.read_samples(spark, path, key="id", most=5, shuffle=True).collect()]
    assert len(drawn) == 5 and drawn != [0, 1, 2, 3, 4]
    assert tuple(files.evaluation_rows(spark, path).orderBy("prompt").first()) == ("p0", ["a"], "s", "g")
