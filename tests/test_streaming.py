from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.operators import matching, metrics
from certloom.streaming import streams
from certloom.streaming.runs import Runs


def test_daily_numbers_go_on_across_batches(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "id long, day date, given string"
    rows = [(n, "2024-01-0" + str(1 + n % 2), "X" if n == 4 else None) for n in range(8)]
    made = spark.createDataFrame(rows, "id long, day string, given string").withColumn("day", F.to_date("day"))

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        streams.stream_daily_number(stream, "day", "id", folder, "given", once=True).awaitTermination()

    made.where("id < 5").coalesce(1).write.mode("append").parquet(source)
    run()
    made.where("id >= 5").coalesce(1).write.mode("append").parquet(source)
    run()
    got = {r.id: r.report_no for r in spark.read.parquet(folder + "/out").collect()}
    want = {r.id: r.report_no for r in metrics.daily_numbers(made, "day", "id", F.col("given")).collect()}
    assert got == want


def test_feedback_stream(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "id string, updated_at string, template_name string, device_name string, device_code string, source_aliases array<string>"
    for n, template in enumerate(("T1", "T2")):
        spark.createDataFrame([(str(n), f"2024-0{n + 1}", template, "天平", "", [f"别名{n}"])], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        streams.stream_feedback(stream, folder, once=True).awaitTermination()
    last = streams.learned_entries(spark, folder).collect()
    assert [(r.id, r.template_name, r.source_aliases) for r in last] == [("0", "T2", ["别名0", "别名1"])]


def test_extraction_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("设备名称: 天平\n型号规格: T-100", encoding="utf-8")
    stream = streams.stream_extract(streams.read_text_stream(spark, str(source)))
    query = stream.select("device_name", "device_model").writeStream.format("memory").queryName("extracted").trigger(
        availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("extracted").collect()] == [("天平", "T-100")]


def _numbers(rows):
    return {r.id: r.report_no for r in rows.collect()}


def test_daily_numbers_of_many_batches_late_days_and_a_lost_batch(spark, tmp_path):
    folder = str(tmp_path / "state")
    rows = [(n, ["2024-01-01", "2024-01-02", None][n * n % 7 % 3], "X" if n % 6 == 4 else None, n // 3) for n in range(24)]
    made = spark.createDataFrame(rows, "id long, day string, given string, part long").withColumn("day", F.to_date("day")).cache()
    for n in range(8):
        # each batch by a new step, as after a restart
        batch = made.where(F.col("part") == n).drop("part")
        streams.numbering_step("day", "id", folder, "given", fan=2)(batch, n)
        if n in (3, 4):  # the batch is run again: its end had not been noted
            streams.numbering_step("day", "id", folder, "given", fan=2)(batch, n)
    want = metrics.daily_numbers(made.drop("part"), "day", "id", F.col("given"))
    assert _numbers(spark.read.parquet(folder + "/out")) == _numbers(want)


def _corrections(spark, rows):
    schema = "id string, updated_at string, template_name string, device_name string, device_code string, source_aliases array<string>"
    return spark.createDataFrame(rows, schema)


def _entries(rows):
    return sorted((r.id, r.updated_at, r.template_name, r.device_name, r.device_code, tuple(r.source_aliases)) for r in rows.collect())


def test_feedback_by_batches_equals_learning_again_from_all_entries(spark, tmp_path):
    folder = str(tmp_path / "state")
    batches = [
        [("a", "2024-01-01", "T1", "天平", "C-1", ["天平甲", "秤台"]), ("b", "2024-01-01", "T2", "烘箱", "", ["烘箱乙"])],
        [("c", "2024-01-02", "T3", "", "C-1", ["天平丙"])],
        [],
        [("d", "2024-01-04", "T4", "", "", ["天平丙", "新称"]), ("e", "2024-01-05", "T5", "", "", ["新称", "又称"])],
        [("f", "2024-01-06", "T6", "泵", "C-9", ["真空泵"]), ("g", "2024-01-06", "T7", "烘箱", None, ["烘箱丁"])],
    ]
    empty = _corrections(spark, [])
    known = empty
    for n, rows in enumerate(batches):
        batch = _corrections(spark, rows)
        streams.learning_step(folder, fan=2)(batch, n)
        if n == 3:
            streams.learning_step(folder, fan=2)(batch, n)
        known = matching.learn_feedback(known.select(*empty.columns), batch)
    got = _entries(streams.learned_entries(spark, folder))
    assert got == _entries(known)
    assert [(e[0], e[2]) for e in got] == [("a", "T5"), ("b", "T7"), ("f", "T6")]


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    folder = str(tmp_path / "state")
    many = _corrections(spark, [(f"{n:05}", "2024-01-01", "T", f"设备{n}", f"K-{n}", [f"别名{n}"]) for n in range(3000)])
    streams.learning_step(folder)(many, 0)
    streams.learning_step(folder)(_corrections(spark, [("x", "2024-02-01", "T9", "", "K-7", ["新名"])]), 1)
    streams.learning_step(folder)(_corrections(spark, [("y", "2024-02-02", "T9", "", "K-7", ["新名"])]), 2)
    written = {n: [r.id for r in spark.read.parquet(f"{folder}/learned/level=0/run={n}").collect()] for n in (1, 2)}
    assert written == {1: ["00007"], 2: ["00007"]}
    last = {r.id: r for r in streams.learned_entries(spark, folder).collect()}
    assert len(last) == 3000 and last["00007"].template_name == "T9" and last["00007"].source_aliases == ["别名7", "新名"]


def test_runs_alive_before_a_batch(spark, tmp_path):
    schema = T.StructType().add("batch", "long")
    log = Runs(str(tmp_path / "runs"), schema, lambda df: df, fan=3)
    for n in range(12):
        assert sorted(r.batch for r in log.before(spark, n).collect()) == list(range(n))
        log.write(n, spark.createDataFrame([(n,)], schema))
