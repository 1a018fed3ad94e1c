import pytest
from pyspark.sql import functions as F

from skeinwork.sources import rowlog, store


def keys(df, c="key"):
    return sorted(r[c] for r in df.collect())


@pytest.fixture(scope="module")
def letters(spark):
    return spark.createDataFrame([(c, ord(c)) for c in "abcdef"], "key string, n int")


def test_scan(letters):
    assert keys(store.scan(letters, "b", "d")) == ["b", "c"]
    assert keys(store.scan(letters, "e", "b")) == ["a", "e", "f"]
    assert keys(store.scan(letters, "c", "c")) == list("abcdef")
    assert keys(store.scan(letters, None, "c")) == ["a", "b"]
    assert keys(store.scan(letters, "e")) == ["e", "f"]
    assert keys(store.scan(letters)) == list("abcdef")


def test_gets(spark, letters):
    assert store.get_cell(letters, "b", "n").first()[0] == 98
    assert store.get_row(letters, "zz").count() == 0
    wanted = spark.createDataFrame([("a",), ("a",), ("x",)], "key string")
    assert keys(store.get_rows(letters, wanted)) == ["a", "a"]
    assert {r.key: r.found for r in store.exists(letters, wanted).collect()} == {"a": True, "x": False}


def test_puts(spark, letters):
    new = store.put_rows(letters, spark.createDataFrame([("a", 1), ("z", 2)], "key string, n int"))
    assert {r.key: r.n for r in new.collect()} == {"a": 1, "b": 98, "c": 99, "d": 100, "e": 101, "f": 102, "z": 2}
    table = spark.createDataFrame([("k", {"x": "1", "y": "2"})], "key string, cols map<string,string>")
    puts = spark.createDataFrame([("k", "x", "3", 1), ("k", "x", "4", 2), ("n", "q", "5", 1)], "key string, column string, value string, seq int")
    assert {r.key: r.cols for r in store.put_cells(table, puts).collect()} == {"k": {"x": "4", "y": "2"}, "n": {"q": "5"}}
    assert keys(store.columns_of(table), "column") == ["x", "y"]


def test_append(spark):
    old = spark.createDataFrame([("w", "u@!#1", None), ("o", "v@!#2", None)], "key string, p1 string, p2 string")
    new = spark.createDataFrame([("w", "x@!#3", "y@!#4"), ("n", None, "z@!#5")], "key string, p1 string, p2 string")
    got = {r.key: (r.p1, r.p2) for r in store.append_rows(old, new, ["p1", "p2"]).collect()}
    assert got == {"w": ("u@!#1@@!!##x@!#3", "y@!#4"), "o": ("v@!#2", None), "n": (None, "z@!#5")}


def test_latest_and_page(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y" * 600), ("b", 1, None)], "key string, seq int, v string")
    assert {r.key: r.v for r in store.latest(log, ["key"], F.col("seq")).collect()} == {"a": "y" * 600, "b": None}
    view = store.page_view(log.where("seq = 2 OR key = 'b'"), rows=1).collect()
    assert [r.key for r in view] == ["a", "b"] and view[0].v == "y" * 500 + "..."


def test_catalog(spark):
    c = store.Catalog(spark)
    for t in ("cat_a", "cat_b"):
        c.delete(t)
    assert c.count("cat_a") == 0
    c.persist("cat_a", "key string, seq int")
    c.persist("cat_a", "key string, seq int")
    c.write("cat_a", spark.createDataFrame([("k", 1), ("k", 2)], "key string, seq int"))
    assert c.count("cat_a") == 2 and "cat_a" in c.tables()
    c.compact("cat_a", ["key"], F.col("seq"))
    assert c.table("cat_a").collect()[0].seq == 2
    c.rename("cat_a", "cat_b")
    c.persist("cat_a", "key string")
    with pytest.raises(ValueError):
        c.rename("cat_a", "cat_b")
    for t in ("cat_a", "cat_b"):
        c.delete(t)


def test_row_log(spark, tmp_path):
    path = tmp_path / "one.table"
    rows = [("k", {"a": b"1 2\n3", "b": b""}), ("k2", {}), ("k", {"a": b"new"})]
    path.write_bytes(b"".join(rowlog.encode_row(k, c) for k, c in rows))
    got = {r.key: {n: bytes(v) for n, v in r.cols.items()} for r in rowlog.read_table(spark, str(tmp_path)).collect()}
    assert got == {"k": {"a": b"new"}, "k2": {}}
    assert rowlog.read_log(spark, str(path)).count() == 3
    assert rowlog.check_file(str(path)) == (3, "k", None)
    out = tmp_path / "two.table"
    assert rowlog.write_log(rowlog.read_table(spark, str(path)), str(out)) == 2
    path.write_bytes(path.read_bytes() + b"bad a 99 x")
    n, last, problem = rowlog.check_file(str(path))
    assert (n, last) == (3, "k") and "record at" in problem
    assert rowlog.read_log(spark, str(path), "permissive").count() == 3
    with pytest.raises(Exception, match="record at"):
        rowlog.read_log(spark, str(path)).count()
    with pytest.raises(ValueError):
        rowlog.encode_row("a b", {})
