"""The event sources of the timeline on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import timelines

D = dt.date


def test_short_interest_and_holders(spark):
    positions = spark.createDataFrame([(1, D(2024, 1, 15), 100), (1, D(2024, 1, 31), 130), (1, D(2024, 2, 15), 131), (1, D(2024, 2, 29), 65), (2, D(2024, 1, 15), 0), (2, D(2024, 1, 31), 50), (2, D(2024, 2, 15), None), (2, D(2024, 2, 29), 10)], "security_id long, settlement_date date, position long")
    got = timelines.short_interest_events(positions, spark.createDataFrame([(1, 9), (2, 8)], "security_id long, cik long"), F.date_add("settlement_date", 10)).orderBy("date").collect()
    assert [(r.date, r.title, r.entity) for r in got] == [(D(2024, 2, 10), "Short interest +30% to 130 shares", 9), (D(2024, 3, 10), "Short interest -50% to 65 shares", 9)]
    q1, q2 = D(2024, 3, 31), D(2024, 6, 30)
    rows = [(1, q1, q1, "A", "", 10.0), (2, q1, q1, "A", "", 10.0), (2, q1, q1, "B", "", 20.0), (3, q1, D(2024, 6, 1), "A", "", 99.0), (4, q1, q1, "A", "PUT", 99.0), (1, q2, q2, "A", "", 60.0)]
    held = timelines.holder_events(spark.createDataFrame(rows, "filer_cik long, period date, filed date, cusip string, put_call string, shares double"), spark.createDataFrame([("A", 7), ("B", 7)], "cusip string, cik long")).orderBy("date").collect()
    assert [(r.date, r.title) for r in held] == [(D(2024, 5, 15), "13F: 2 holders"), (D(2024, 8, 14), "13F: 1 holders (-1), shares held +50%")]


def test_presidential_and_releases(spark):
    documents = spark.createDataFrame([(1, D(2024, 1, 2), "executive_order", "Chips"), (2, D(2024, 1, 3), "memo", "Fish"), (3, None, "memo", "Chips"), (4, D(2024, 1, 4), "memo", None)], "number long, signed date, type string, title string")
    found = spark.createDataFrame([(2, 0.6), (4, 0.4), (1, 0.9)], "number long, score double")
    numbers = lambda **k: sorted(r.ref.split(":")[1] for r in timelines.presidential_events(documents, **k).collect())
    assert numbers() == ["1", "2", "4"]
    assert numbers(titled=F.col("title").contains("Chip")) == ["1"]
    assert numbers(titled=F.col("title").contains("Chip"), found=found) == ["1", "2"]
    assert timelines.presidential_events(documents).where("ref LIKE '%:1'").first().title == "executive order: Chips"
    dates = spark.createDataFrame([("CPI", D(2024, 1, 9)), ("CPI", D(2024, 1, 9)), ("H15", D(2024, 1, 9)), ("Other", D(2024, 1, 10))], "release string, date date")
    series = spark.createDataFrame([("CPI", "b", False), ("CPI", "a", None), ("H15", "r", True)], "release string, series_id string, daily boolean")
    titles = lambda **k: sorted(r.title for r in timelines.release_events(dates, series, **k).collect())
    assert titles() == ["CPI (a, b)", "Other"] and titles(wanted=["b"]) == ["CPI (b)"] and titles(shown=1) == ["CPI (a)", "Other"]
    assert timelines.release_events(dates.limit(0), series).collect() == []
