import json

import pytest

from skeinwork.cli import run


def test_commands(spark):
    for t in ("cli_a", "cli_b", "cli_a__new"):
        run(spark, ["delete", t])
    assert run(spark, ["persist", "cli_a"]) == "OK" and run(spark, ["count", "cli_a"]) == "0"
    for args in (["k", "x", "1"], ["k", "y", "2"], ["k", "x", "3"], ["m", "x", "4"]):
        run(spark, ["put", "cli_a", *args])
    assert run(spark, ["get", "cli_a", "k"]) == "k x=3 y=2" and run(spark, ["get", "cli_a", "k", "y"]) == "2" and run(spark, ["get", "cli_a", "zz"]) == ""
    assert run(spark, ["scan", "cli_a"]) == "k x=3 y=2\nm x=4" and run(spark, ["scan", "cli_a", "l"]) == "m x=4"
    run(spark, ["rename", "cli_a", "cli_b"])
    assert "cli_b" in run(spark, ["tables"]).split("\n") and run(spark, ["count", "cli_b"]) == "2"
    run(spark, ["delete", "cli_b"])
    with pytest.raises(SystemExit):
        run(spark, ["fly"])


def test_search(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([("http://a/", "<title>Red stones</title><body>stone stone</body>"), ("http://b/", "<body>x</body>")], "url string, page string").write.parquet(path)
    assert [r["url"] for r in json.loads(run(spark, ["search", path, "Stones"]))] == ["http://a/"]
    assert run(spark, ["search", path, "nothing"]) == "[]"
