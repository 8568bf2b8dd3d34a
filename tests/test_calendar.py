from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from edictal.operators import aggregate as A
from edictal.operators import calendar as D


def date(text):
    return dt.date.fromisoformat(text)


def test_easter(spark):
    # Easter Sundays from published almanacs.
    known = {1818: "03-22", 1943: "04-25", 1954: "04-18", 1981: "04-19", 2000: "04-23", 2008: "03-23", 2019: "04-21", 2026: "04-05", 2038: "04-25", 2049: "04-18"}
    rows = spark.createDataFrame([(y,) for y in known], "y int").select("y", D.easter(F.col("y")).alias("e")).collect()
    assert {r.y: r.e.strftime("%m-%d") for r in rows} == known


def test_deadlines(spark):
    # Bulletin date, sentence and last day of the term.
    cases = [
        ("2026-09-11", "20 días hábiles", "2026-10-13"), ("2026-07-15", "diez días", "2026-07-29"), ("2026-10-07", "deu dies hàbils", "2026-10-23"),
        ("2026-09-17", "20 días naturales", "2026-10-07"), ("2026-09-14", "veinte días naturales", "2026-10-05"), ("2026-09-14", "un mes", None), (None, "20 días", None),
    ]
    df = spark.createDataFrame([(i, b and date(b), t) for i, (b, t, _) in enumerate(cases)], "i int, gazette_date date, deadline string")
    out = D.deadline(df, D.calendar(spark, 2025, 2027)).orderBy("i").collect()
    assert [r.term_closes and r.term_closes.isoformat() for r in out] == [c for _, _, c in cases]
    assert [r.term_verified for r in out[:5]] == [True] * 5


def test_business_days_match_a_day_by_day_count(spark):
    cal = D.calendar(spark, 2023, 2028, verified={})
    days = {r.day: r.business for r in cal.collect()}
    starts = [date("2023-12-20") + dt.timedelta(days=37 * i) for i in range(25)]
    df = spark.createDataFrame([(s, n) for s in starts for n in (1, 7, 45)], "start date, n int")
    for r in D.add_business_days(df, cal, "start", "n").collect():
        day, left = r.start, r.n
        while left:
            day += dt.timedelta(days=1)
            left -= days[day]
        assert r.end == day


def test_local_date(spark):
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2026-07-01 22:30:00' AS t UNION ALL SELECT TIMESTAMP_NTZ'2026-01-01 22:30:00'")
    got = sorted(r[0].isoformat() for r in rows.select(D.local_date("t")).collect())
    assert got == ["2026-01-01", "2026-07-02"]


def test_read_windows(spark):
    runs = spark.createDataFrame(
        [("a", "OK", date("2026-09-01")), ("b", "SIN_NOVEDADES", date("2026-09-09")), ("c", "ERROR", date("2026-09-10")), ("d", "OK", date("2026-01-01"))],
        "source string, state string, until date",
    )
    out = {r.source: (r.days, r.exceeded) for r in A.read_windows(runs, F.lit(date("2026-09-11"))).collect()}
    assert out == {"a": (11, False), "b": (7, False), "c": (7, False), "d": (30, True)}


def test_calendar_covers_the_dates_in_use(spark):
    df = spark.createDataFrame([(1, date("1950-03-01"), "20 días"), (2, date("2019-12-30"), "600 días"), (3, None, "20 días")], "i int, gazette_date date, deadline string")
    cal = D.calendar_for(spark, [D.term_use(df, ["gazette_date"])], (1994, 2003))
    assert [r.term_closes for r in D.deadline(df, cal).orderBy("i").collect()] == [date("1950-03-29"), date("2022-05-19"), None]
    assert {r.term_state for r in D.term_state(df.filter("i < 3"), cal, F.lit(date("2020-01-15"))).collect()} == {"CERRADO", "ABIERTO"}
    with pytest.raises(ValueError):
        D.calendar_for(spark, [(df, ["gazette_date"], F.lit(99_999))], (1994, 2003))


def test_a_day_past_the_edge_is_an_error(spark):
    cal = D.calendar(spark, 1994, 2003)
    df = spark.createDataFrame([(date("2003-12-30"), "20 días", 20)], "gazette_date date, deadline string, n int")
    late = df.withColumn("gazette_date", F.lit(date("2004-01-05")))
    for out in (
        D.term_state(df, cal, F.lit(date("2000-01-01"))), D.add_business_days(df, cal, "gazette_date", "n"), D.is_business_day(late, cal, "gazette_date"),
        D.next_business_day(late, cal, "gazette_date", "next"),
    ):
        with pytest.raises(Exception, match="outside the calendar"):
            out.collect()


def test_terms_of_aggregated_bulletins(spark):
    ten, twenty = "diez días hábiles", "20 días hábiles"
    rows = [
        (1, None, None, None, None), (2, "", None, None, None), (3, twenty, date("2026-09-23"), None, None), (4, twenty, date("2026-09-23"), None, None),
        (5, twenty, date("2026-09-23"), None, None), (6, twenty, None, date("2026-09-02"), date("2026-10-01")), (7, None, None, None, None), (8, "ver bases", date("2026-09-17"), None, None),
    ]
    processes = spark.createDataFrame(rows, "process_id long, deadline string, gazette_date date, opens date, closes date")
    said = [
        (1, ten, date("2026-09-01")), (1, ten, date("2026-09-20")),  # several decide nothing
        (2, ten, date("2026-09-01")),  # the only one is taken
        (3, ten, date("2026-09-01")),  # what the process says itself goes first
        (4, None, None), (4, None, None),  # several, though they state nothing
        (6, ten, date("2026-09-01")),  # own sentence, date of the bulletin
        (7, None, date("2026-09-01")), (9, ten, date("2026-09-01")),
    ]
    bulletins = spark.createDataFrame(said, "process_id long, deadline string, gazette_date date")
    plan = D.deadline_plan(processes, D.calendar(spark, 2025, 2027), bulletins)
    got = {r.process_id: (r.action, r.term_opens.isoformat(), r.term_closes.isoformat()) for r in plan.collect()}
    assert got == {
        2: ("FILL", "2026-09-02", "2026-09-15"), 3: ("FILL", "2026-09-24", "2026-10-23"), 5: ("FILL", "2026-09-24", "2026-10-23"), 6: ("DISCREPANCY", "2026-09-02", "2026-09-29"),
    }
    assert D.own_term(processes, bulletins.limit(0)).exceptAll(processes.withColumn("deadline", F.nullif("deadline", F.lit("")))).count() == 0
