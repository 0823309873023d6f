import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logweave.operators import ordering
from logweave.operators.ordering import PART, running, split_ranges


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    at = rng.sample(range(10_000), 900)
    # One group holds half of the rows; its order values are unevenly dense.
    rows = [("hot" if i % 2 else f"k{i % 30}", x if x > 500 else x * 7 - 3000, rng.randint(-5, 50)) for i, x in enumerate(at)]
    return spark.createDataFrame(rows, "g string, at long, v int").dropDuplicates(["at"])


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("part_rows", [7, 100, 1_000_000])
def test_running_values_equal_plain_windows(table, keys, part_rows):
    made = running(table, keys, ["at"], {
        "rn": ("row_number", None), "total": ("sum", "v"), "top": ("max", "v"), "prev": ("prior_max", "at"),
    }, part_rows=part_rows)
    w = Window.partitionBy(*keys).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    both = (
        made.withColumn("rn2", F.row_number().over(w)).withColumn("total2", F.sum("v").over(upto))
        .withColumn("top2", F.max("v").over(upto)).withColumn("prev2", F.lag("at").over(w))
    )
    assert both.count() == table.count()
    assert both.where("not (rn <=> rn2 and total <=> total2 and top <=> top2 and prev <=> prev2)").count() == 0


def test_only_oversized_groups_are_cut(table):
    plan = running(table, ["g"], ["at"], {"rn": ("row_number", None)})._jdf.queryExecution().toString()
    assert "Join" not in plan
    cut = running(table, ["g"], ["at"], {"rn": ("row_number", None)}, part_rows=50)
    window = [line for line in cut._jdf.queryExecution().executedPlan().toString().splitlines() if "row_number()" in line]
    assert any("_part" in line for line in window)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "g string, at long")
    assert running(empty, [], ["at"], {"rn": ("row_number", None)}).count() == 0
    assert running(empty, ["g"], ["at"], {"rn": ("row_number", None)}).count() == 0


@pytest.mark.parametrize("value", [
    "CASE WHEN id = 7 THEN 1000000000000 ELSE id * 2 END",  # one outlier
    "cast(pow(2, id / 1200.0) * 1000 as long)",  # exponential gaps
    "CASE WHEN id % 3 = 0 THEN 5 ELSE id END",  # one value with a third of the rows
    "cast(pow(id / 40000.0, 6) * 1000000 as long)",  # dense at one end
])
def test_ranges_do_not_depend_on_the_distribution(spark, value):
    part_rows = 2_000
    rows = spark.range(40_000).selectExpr("id", f"{value} AS at")
    ranges = split_ranges(rows, [], ["at", "id"], part_rows=part_rows)
    tied = max(r["count"] for r in rows.groupBy("at").count().collect())
    counts = [r["count"] for r in ranges._df.groupBy(PART).count().collect()]
    assert max(counts) <= max(2 * part_rows, tied) and sum(counts) == 40_000
    made = ranges.add({"rn": ("row_number", None)}).rows()
    plain = F.row_number().over(Window.orderBy("at", "id"))
    assert made.withColumn("rn2", plain).where("rn != rn2").count() == 0


def test_null_keys_and_values_keep_their_rows(spark):
    rows = spark.range(500).selectExpr("IF(id % 2 = 0, NULL, 'a') AS g", "IF(id % 50 = 0, NULL, id) AS at", "1 AS v")
    made = running(rows, ["g"], ["at"], {"total": ("sum", "v")}, part_rows=20)
    assert made.count() == 500
    assert [r.n for r in made.groupBy("g").agg(F.max("total").alias("n")).orderBy("g").collect()] == [250, 250]


@pytest.mark.parametrize("points", [0, 1, 2, 7, 254, 255])
def test_places_among_cut_points(spark, points):
    cuts = [3 * i - 40 for i in range(points)]
    values = [None, -1000, *range(-42, -30), *(c + d for c in cuts for d in (-1, 0, 1)), 10**12]
    rows = spark.createDataFrame([(v, cuts) for v in values] + [(5, None)], "v long, cuts array<long>")
    place = ordering._place(F.col("cuts"), F.col("v"))
    wanted = lambda v, c: 0 if v is None or c is None else sum(x < v for x in c) + sum(x <= v for x in c)
    assert all(r["p"] == wanted(r["v"], r["cuts"]) for r in rows.withColumn("p", place).collect())


def test_expression_to_cut_on_is_worked_out_once(spark):
    rows = spark.range(1000).withColumn("t", F.lpad(F.col("id").cast("string"), 6, "0"))
    cut = ordering.split_ranges(rows, [], ["t"], split_on=F.conv("t", 10, 10).cast("long"), part_rows=50)
    assert ordering.CUT_ON in cut._df.columns
    made = cut.add({"n": ("row_number", None)}).rows()
    assert made.columns == ["id", "t", "n"]
    assert made.where("n = id + 1").count() == 1000
