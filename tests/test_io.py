import os

from textloom import runtime, sources, streaming


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted",\nlong text'), (2, None)], "id long, text string")
    sources.write(df, f"{tmp_path}/c", "csv")
    assert sorted(map(tuple, sources.read_csv(spark, f"{tmp_path}/c", "id long, text string").collect()), key=repr) == [(1, 'a "quoted",\nlong text'), (2, None)]
    sources.write(df, f"{tmp_path}/p", partition_by=["id"])
    assert sources.read_parquet(spark, f"{tmp_path}/p", ["text"]).count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("one\ntwo")
    assert sources.read_texts(spark, f"{tmp_path}/t").first().text == "one\ntwo"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Don't stop the running cats!")], "id long, text string").write.parquet(f"{tmp_path}/in")
    q = streaming.clean_stream(spark, f"{tmp_path}/in", "id long, text string").writeStream.format("memory").queryName("cleaned").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cleaned").first().clean == "do_not stop running cats"


def test_written_tables_are_dropped(spark):
    df = runtime.materialise(spark.range(5), "five")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(path)
    kept, runtime._WRITTEN[:] = runtime._WRITTEN[:-1], runtime._WRITTEN[-1:]
    runtime.drop_written(spark)
    runtime._WRITTEN[:] = kept
    assert not os.path.exists(path)
