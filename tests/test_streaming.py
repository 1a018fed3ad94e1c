from datetime import UTC, datetime, timedelta

from skeinwork.plans.index import postings
from skeinwork.streaming.incremental import fetches_by_host, first_seen, index_stream

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def test_index_stream(spark, tmp_path):
    source = tmp_path / "pages"
    page = lambda w: f"<title>{w}</title><body>{w} {w}</body>"
    schema = "url string, page string"
    spark.createDataFrame([("u", page("garden"))], schema).write.parquet(str(source / "1"))
    stream = spark.readStream.schema(schema).parquet(str(source / "*"))
    index_stream(stream, str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination(60)
    spark.createDataFrame([("v", page("stone"))], schema).write.parquet(str(source / "2"))
    index_stream(stream, str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination(60)
    got = {(r.word, r.field, r.url, r.cnt) for r in spark.read.parquet(str(tmp_path / "index" / "run=*")).collect()}
    every = postings(spark.read.schema(schema).parquet(str(source / "*")))
    assert got == {(r.word, r.field, r.url, r.cnt) for r in every.collect()} and len(got) == 4


def run(spark, tmp_path, make, mode):
    rows = [("h", "http://h/1", T0), ("h", "http://h/1", T0 + timedelta(minutes=3)), ("h", "http://h/2", T0 + timedelta(minutes=12)), ("k", "http://k/", T0 + timedelta(hours=3))]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "host string, url string, at timestamp").coalesce(1).write.parquet(path)
    stream = make(spark.readStream.schema("host string, url string, at timestamp").parquet(path))
    stream.writeStream.format("memory").queryName(f"out_{mode}").outputMode(mode).trigger(availableNow=True).start().awaitTermination(90)
    return spark.table(f"out_{mode}").collect()


def test_windows(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: fetches_by_host(s, "at"), "complete")
    assert sorted((r.host, r.fetches) for r in got) == [("h", 1), ("h", 2), ("k", 1)]


def test_first_seen(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: first_seen(s, "at"), "append")
    assert sorted(r.url for r in got) == ["http://h/1", "http://h/2", "http://k/"]
