"""Sweeps over time: how many sessions are open at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.shared import running


def sessions(events: DataFrame, client: str, at: str, gap: str) -> DataFrame:
    """client, begin, end: a client's events with no more than `gap` between them, which end a gap after the last."""
    found = events.filter(F.col(client).isNotNull() & F.col(at).isNotNull()).groupBy(client, F.session_window(at, gap).alias("_w")).agg(F.count("*").alias("n"))
    return found.select(client, F.col("_w.start").alias("begin"), F.col("_w.end").alias("end"), "n")


def most_at_once(spans: DataFrame, begin: str = "begin", end: str = "end", every: str = "day") -> DataFrame:
    """(day, most): the greatest number of spans that are open at the same time on each day that any touches. A span is open from its begin to before its end.

    Begins count one more and ends one less; their running sum in the order of time is taken over all tasks, so none ranks all rows. Where a day begins, what is open then counts for it, too.
    """
    point = lambda t, n: F.struct(t.alias("t"), F.lit(n).alias("n"))
    ends = spans.filter(F.col(begin) < F.col(end)).select(F.explode(F.array(point(F.col(begin), 1), point(F.col(end), -1))).alias("p"))
    last = F.date_trunc(every, F.col(end) - F.expr("interval 1 microsecond"))
    days = spans.filter(F.col(begin) < F.col(end)).select(F.explode(F.sequence(F.date_trunc(every, begin), last, F.expr(f"interval 1 {every}"))).alias("t")).distinct()
    points = ends.select("p.t", "p.n").unionByName(days.select("t", F.lit(0).alias("n")))
    swept = running(points, [F.col("t"), F.col("n")], F.col("n"), "open")
    # The day after a last end at midnight has no open span and no row of its own.
    found = swept.groupBy(F.date_trunc(every, "t").alias("day")).agg(F.max("open").cast("long").alias("most"))
    return found.join(days.select(F.col("t").alias("day")), "day", "left_semi")
