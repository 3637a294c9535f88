"""Lab panels, trends and progression alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import rules
from ..functions.norm import digits_number, leading_number


def markers(spark: SparkSession) -> DataFrame:
    """The 29 panel markers, a fixed table."""
    return spark.createDataFrame([(p, m) for p, ms in rules.PANELS.items() for m in ms], "panel string, marker string")


def panel_hits(labs: DataFrame) -> DataFrame:
    """A row for each panel marker that a test name contains."""
    return labs.join(F.broadcast(markers(labs.sparkSession)), F.lower("test_name").contains(F.col("marker")))


def panels(labs: DataFrame) -> DataFrame:
    """Per patient, panel and marker: latest, highest, lowest, median, change a day, persistent abnormality, and the points (date and value) in order.

    Highest, lowest and median are of numeric values; latest and earliest of all rows by date, then id.
    Markers without a numeric value have no row.
    """
    key = ["patient_id", "panel", "marker"]
    order = F.struct("test_date", "id")
    hits = panel_hits(labs).withColumn("x", leading_number(F.col("value")))
    # each hit needs the flag before it; counts and extremes come with the same grouping
    before = F.lag("abnormal_flag").over(W.partitionBy(*key).orderBy("test_date", "id"))
    hits = hits.withColumn("twice", F.coalesce(F.col("abnormal_flag") & before, F.lit(False)))
    row = F.struct("test_date", "x", "value", "unit")
    out = hits.groupBy(*key).agg(
        F.max_by(row, order).alias("last"), F.min_by(row, order).alias("first"), F.max("x").alias("hi"), F.min("x").alias("lo"),
        F.median("x").alias("mid"), F.max("twice").alias("persistent_abnormality"), F.count(F.lit(1)).alias("n_points"),
        F.sort_array(F.collect_list(F.struct("test_date", "id", "value"))).alias("all"),
    ).where(F.col("hi").isNotNull())
    days = F.abs(F.datediff("last.test_date", "first.test_date"))
    change = (F.col("last.x") - F.col("first.x")) / F.nullif(days, F.lit(0))
    return out.select(
        "patient_id", "panel", F.upper("marker").alias("marker"), F.col("last.value").alias("latest"), F.coalesce("last.unit", F.lit("")).alias("unit"),
        F.col("hi").alias("highest"), F.col("lo").alias("lowest"), F.round("mid", 6).alias("median"),
        F.when((F.col("n_points") < 2) | (days == 0), 0.0).otherwise(F.round(change, 3) + 0.0).alias("change_per_day"), "persistent_abnormality", "n_points",
        F.transform("all", lambda r: F.struct(r["test_date"].alias("date"), r["value"].alias("value"))).alias("points"),
    )


def trends(labs: DataFrame, tests: list[str] = rules.TREND_TESTS) -> DataFrame:
    """Per patient and asked test: latest value and unit, smallest and largest number, their count, the last direction, and the points in order.

    ``points``: date, value, unit, whether it is abnormal, reference range.
    """
    asked = labs.sparkSession.createDataFrame([(t,) for t in tests], "asked string")
    name, want = F.lower(F.trim("test_name")), F.lower(F.trim("asked"))
    hits = labs.join(F.broadcast(asked), name.contains(want) | want.contains(name)).withColumn("x", digits_number(F.col("value")))
    hits = hits.where(F.col("x").isNotNull())
    have = lambda c, kind: F.col(c) if c in labs.columns else F.lit(None).cast(kind)
    more = (F.coalesce(have("unit", "string"), F.lit("")).alias("unit"), F.coalesce(have("abnormal_flag", "boolean"), F.lit(False)).alias("abnormal"), have("reference_range", "string").alias("range"))
    out = hits.groupBy("patient_id", "asked").agg(F.sort_array(F.collect_list(F.struct("test_date", "id", "x", *more))).alias("p"), F.min("x").alias("min_val"), F.max("x").alias("max_val"))
    last, before = F.get("p", F.size("p") - 1), F.get("p", F.size("p") - 2)["x"]
    direction = F.when(F.size("p") < 2, "NONE").when(last["x"] > before, "UPWARD").when(last["x"] < before, "DOWNWARD").otherwise("STABLE")
    point = lambda r: F.struct(r["test_date"].alias("date"), r["x"].alias("value"), r["unit"].alias("unit"), r["abnormal"].alias("is_abnormal"), r["range"].alias("reference_range"))
    return out.select(
        "patient_id", "asked", last["x"].alias("latest_value"), last["unit"].alias("latest_unit"), direction.alias("trend_direction"), "min_val", "max_val", F.size("p").alias("n_points"),
        F.transform("p", point).alias("points"),
    )


def progressions(labs: DataFrame) -> DataFrame:
    """Rising HbA1c and falling haemoglobin, from a patient's first to last test."""
    name = F.lower("test_name")
    kind = F.when(name.contains("hba1c"), "hba1c").when(name.isin("hemoglobin", "hb"), "hemoglobin")
    row, order = F.struct(leading_number(F.col("value")).alias("x")), F.struct("test_date", "id")
    ends = labs.withColumn("kind", kind).where("kind is not null").groupBy("patient_id", "kind").agg(
        F.min_by(row, order)["x"].alias("first"), F.max_by(row, order)["x"].alias("last"), F.count(F.lit(1)).alias("n")
    )
    sugar = (F.col("kind") == "hba1c") & (F.col("last") > F.col("first"))
    blood = (F.col("kind") == "hemoglobin") & (F.col("last") < F.col("first")) & (F.col("last") < 12)
    critical = F.when(F.col("kind") == "hba1c", F.col("last") >= 6.5).otherwise(F.col("last") < 10)
    title = F.when(F.col("kind") == "hba1c", "Diabetes Progression Risk (Rising HbA1c)").otherwise("Anemia Alert (Falling Hemoglobin)")
    return ends.where((F.col("n") >= 2) & (sugar | blood)).select("patient_id", title.alias("title"), F.when(critical, "critical").otherwise("warning").alias("severity"), "first", "last", "n")


def high_pressure(labs: DataFrame) -> DataFrame:
    """Patients with a blood pressure over 140, whatever its status and date."""
    name = F.lower("test_name")
    hit = (name.contains("bp") | name.contains("blood pressure")) & (leading_number(F.col("value")) > 140)
    return labs.where(hit).select("patient_id").distinct()
