"""Documents of runs."""

from pyspark.sql import functions as F

from fluvius.operators import documents as D


def test_run_table(spark):
    sites = spark.createDataFrame([("a", "A|1", True), ("b", "B", False), ("c", "C", False)], "slug string, name string, home boolean")
    runs = spark.createDataFrame([("a", 1, 0.5, False), ("a", 2, 0.125, False), ("b", 1, None, True)], "slug string, seq int, wet double, failed boolean")
    lines = D.run_table(sites, runs, {"wet": D.share(F.col("wet")), "seq": F.col("seq")})
    assert D.joined(lines, "| Site | Wet | Run |\n|-|-|-|").first().text.split("\n")[2:] == ["| B | **FAILED** |  |", "| C | _not run_ |  |", "| A\\|1 | 12% | 2 |"]


def test_put_block(spark):
    rows = [(1, "x\n<a>\nold\n<b>\ny"), (2, "x\n## Maps\nold"), (3, "x\n\n"), (4, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.t for r in df.select("id", D.put_block(F.col("text"), F.lit("new"), "<a>", "<b>", "## Maps").alias("t")).collect()}
    block = "<a>\nnew\n<b>"
    assert got == {1: f"x\n{block}\ny", 2: f"x\n## Maps\n\n{block}\n", 3: f"x\n\n## Maps\n\n{block}\n", 4: f"\n\n## Maps\n\n{block}\n"}
