import pytest
from pyspark.sql import functions as F

from skeinwork.operators.dataflow import Context, Pairs, Values


@pytest.fixture(scope="module")
def job(spark):
    return Context(spark)


def pairs(spark, rows):
    return Pairs(spark.createDataFrame(rows, "key string, value string"))


def test_output(spark):
    job = Context(spark)
    assert job.result() == "No output available"
    job.output("Worked, and the arguments are: ")
    job.output(",".join(["a", "b"]))
    assert job.result() == "Worked, and the arguments are: a,b"


def test_collect_count_take(job):
    v = job.parallelize(["b", "a", "c", "a"])
    assert sorted(v.collect()) == ["a", "a", "b", "c"]
    assert v.count() == 4
    assert len(v.take(2)) == 2 and set(v.take(9)) == {"a", "b", "c"}
    assert sorted(v.distinct().collect()) == ["a", "b", "c"]


def test_flat_map(job):
    for step in (F.split("value", " "), lambda v: v.split(" ")):
        assert sorted(job.parallelize(["hello world", "a b"]).flat_map(step).collect()) == ["a", "b", "hello", "world"]


def test_flat_map_none_and_errors(job):
    v = job.parallelize(["1", "x", "2"])
    assert v.flat_map(lambda _: None).collect() == []
    assert sorted(v.flat_map(lambda s: [None, s]).collect()) == ["1", "2", "x"]
    assert sorted(v.flat_map_shuffled(lambda s: [str(int(s) + 1)]).collect()) == ["2", "3"]
    with pytest.raises(Exception, match="invalid literal"):
        v.flat_map(lambda s: [int(s)]).collect()


def test_map_to_pair(job):
    v = job.parallelize(["apple", "bob"])
    expected = [("a", "pple"), ("b", "ob")]
    assert sorted(v.map_to_pair(lambda s: (s[0], s[1:])).collect()) == expected
    assert sorted(v.map_to_pair(F.substring("value", 1, 1), F.expr("substring(value, 2)")).collect()) == expected
    assert sorted(v.map_to_pair(lambda s: None if s == "bob" else (s, s)).collect()) == [("apple", "apple")]
    assert sorted(v.flat_map_to_pair(lambda s: [(s, "1")] * 2).collect()) == [("apple", "1")] * 2 + [("bob", "1")] * 2


def test_fold_by_key(job, spark):
    p = job.parallelize(["a 1", "b 5", "a 3"]).map_to_pair(lambda s: tuple(s.split(" ")))
    add = lambda x, y: str(int(x) + int(y))
    assert sorted(p.fold_by_key("0", add).collect()) == [("a", "4"), ("b", "5")]
    assert sorted(p.fold_by_key("0", add, commutative=True).collect()) == [("a", "4"), ("b", "5")]
    assert sorted(p.fold_by_key_with(F.sum(F.col("value").cast("int"))).collect()) == [("a", "4"), ("b", "5")]
    assert p.fold_by_key("0", lambda x, y: None).collect() == []
    assert pairs(spark, [("k", "c"), ("k", "a"), ("k", "b")]).fold_by_key("", lambda x, y: x + y).collect() == [("k", "abc")]


def test_word_count(job):
    words = job.parallelize(["the cat", "the dog"]).flat_map(F.split("value", " ")).map_to_pair(F.col("value"), F.lit("1"))
    assert sorted(words.fold_by_key_with(F.count(F.lit(1))).collect()) == [("cat", "1"), ("dog", "1"), ("the", "2")]


def test_filter(job):
    for step in (F.length("value") > 3, lambda v: len(v) > 3):
        assert sorted(job.parallelize(["a", "abcd", "xyz", "hello"]).filter(step).collect()) == ["abcd", "hello"]


def test_group_and_key_by(job):
    v = job.parallelize(["apple", "avocado", "bob"])
    assert sorted(v.key_by(lambda s: s[0]).collect()) == [("a", "apple"), ("a", "avocado"), ("b", "bob")]
    assert sorted(v.group_concat(F.substring("value", 1, 1)).collect()) == [("a", "apple,avocado"), ("b", "bob")]


def test_sets(job):
    a, b = job.parallelize(list("abbc")), job.parallelize(list("bcdb"))
    assert sorted(a.intersection(b).collect()) == ["b", "c"]
    assert sorted(a.union(b).collect()) == sorted("abbcbcdb")
    assert sorted(a.subtract(b).collect()) == ["a"]


def test_sample(job):
    v = job.parallelize([str(i) for i in range(200)])
    assert v.sample(0.0).collect() == []
    assert v.sample(1.0).count() == 200
    assert set(v.sample(0.5, seed=1).collect()) < set(v.collect())


def test_map_partitions(job):
    assert sorted(job.parallelize(["a", "b"]).map_partitions(lambda it: (x + "!" for x in it)).collect()) == ["a!", "b!"]


def test_join_and_cogroup(spark):
    left, right = pairs(spark, [("k", "1"), ("k", "2"), ("m", "9")]), pairs(spark, [("k", "a"), ("k", "b")])
    assert sorted(left.join(right).collect()) == [("k", "1,a"), ("k", "1,b"), ("k", "2,a"), ("k", "2,b")]
    left = pairs(spark, [("fruit", "apple"), ("fruit", "banana"), ("only left", "x")])
    right = pairs(spark, [("fruit", "cherry"), ("fruit", "date"), ("fruit", "fig"), ("r", "y")])
    assert sorted(left.cogroup(right).collect()) == [("fruit", "[apple,banana],[cherry,date,fig]"), ("only left", "[x],[]"), ("r", "[],[y]")]
    assert left.semi_join(right).count() == 2 and left.anti_join(right).collect() == [("only left", "x")]


def test_fold(job):
    v = job.parallelize(["1", "2", "3", "2"])
    assert v.fold("0", lambda a, b: str(int(a) + int(b))) == "8"
    assert job.parallelize([]).fold("0", lambda a, b: str(int(a) + int(b))) == "0"
    assert job.parallelize([]).count() == 0
    many = job.parallelize([str(i) for i in range(300)])
    many.df = many.df.repartition(150)
    assert many.fold("0", lambda a, b: str(int(a) + int(b))) == str(sum(range(300)))


def test_from_table_and_save(job, spark):
    df = spark.createDataFrame([("k1", "x"), ("k2", None)], "key string, c string")
    assert job.from_table(df, F.col("c")).collect() == ["x"]
    assert sorted(job.from_table(df, lambda r: r["key"]).collect()) == ["k1", "k2"]
    for t in ("df_values", "df_pairs"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    job.parallelize(["a"], "df_values")
    assert sorted(job.parallelize(["b"], "df_values").collect()) == ["a", "b"]
    assert pairs(spark, [("a b", "1"), ("a b", "2")]).save_as_table("df_pairs").wide().first()["values"] == ["1", "2"]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        pairs(spark, [("a", "1")]).save_as_table("df_pairs")
    for t in ("df_values", "df_pairs"):
        spark.sql(f"DROP TABLE {t}")


def test_long_and_odd_keys(spark):
    key = "a key with blanks " * 200
    assert pairs(spark, [(key, "1")]).join(pairs(spark, [(key, "2")])).collect() == [(key, "1,2")]


def test_concurrency(job, spark):
    c = Context(spark)
    c.set_concurrency(3)
    assert c.parallelize(["a", "b", "c"]).df.rdd.getNumPartitions() == 3


def test_first_by(job):
    assert sorted(job.parallelize(["u@!#3", "u@!#1", "v@!#2"]).first_by("@!#").collect()) == ["u@!#1", "v@!#2"]
    assert job.catalog.count("no_such_table") == 0


def test_parts_of_hot_keys(spark):
    rows = [("hot", f"v{i:04}") for i in range(2500)] + [("hot", "v0001")] + [("cold", "b"), ("cold", "a"), (None, "n")]
    pairs = Pairs(spark.createDataFrame(rows, "key string, value string"))
    got = sorted((r.key or "", r.part, r.n, list(r["values"])) for r in pairs.wide_parts(1000).collect())
    hot = sorted(v for k, v in rows if k == "hot")
    assert got == [("", 0, 1, ["n"]), ("cold", 0, 2, ["a", "b"]), *[("hot", i, len(hot[i * 1000 : i * 1000 + 1000]), hot[i * 1000 : i * 1000 + 1000]) for i in range(3)]]
    sides = {(r.key, r.side, r.part): r.n for r in pairs.cogroup_parts(Pairs(pairs.df.limit(0)), 2000).collect()}
    assert sides == {(None, 0, 0): 1, ("cold", 0, 0): 2, ("hot", 0, 0): 2000, ("hot", 0, 1): 501}
    assert pairs.df.limit(0).sparkSession and Pairs(pairs.df.limit(0)).wide_parts(5).count() == 0
    assert {(r.key, r.part): r.n for r in Values(pairs.df.select("value")).group_parts(F.lit("k"), 2000).collect()} == {("k", 0): 2000, ("k", 1): 504}


def test_commutative_fold_of_equal_values(spark):
    pairs = Pairs(spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) AS key", "'1' AS value"))
    got = dict(pairs.fold_by_key("0", lambda a, b: str(int(a) + int(b)), commutative=True).collect())
    assert got["hot"] == "6667" and sum(map(int, got.values())) == 20_000
