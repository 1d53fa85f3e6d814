"""URL filters over time: dated list entries become validity intervals, captures meet them as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a time cell: an interval is listed once in each cell that captures ask about, a capture looks into its own.
CELL = 30 * 86400
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host(url: str | Column = "url") -> Column:
    """The lower-case host of a URL; null if it has none."""
    h = F.lower(F.regexp_extract(F.col(url) if isinstance(url, str) else url, HOST, 1))
    return F.when(h != "", h)


def domains(h: Column) -> Column:
    """A host and all its parent domains, the longest first."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until) for each time a pattern is on the list; ``entries`` are (pattern, action, at).

    An entry holds until the pattern's next one: "add" opens an interval, "remove" closes it, a repeated one changes
    nothing. Of entries at the same instant "remove" comes last. Null pattern, time or another action is ignored.
    """
    known = entries.where("pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')").select(F.lower("pattern").alias("pattern"), "action", "at").distinct()
    w = Window.partitionBy("pattern").orderBy("at", "action")
    return known.withColumn("until", F.lead("at").over(w)).where("action = 'add' AND (until IS NULL OR until > at)").select("pattern", F.col("at").alias("since"), "until")


def in_cells(spans: DataFrame, asked: DataFrame) -> DataFrame:
    """(pattern, cell, since, until): the intervals that touch a cell of ``asked`` (pattern, cell), and those that open in any.

    Intervals of a pattern do not overlap, so at the start of a cell at most one is running: the last one opened before. A
    running interval costs one row for each cell in which captures ask for it, however long it runs.
    """
    spans = spans.select("pattern", F.col("since").cast("timestamp").alias("since"), F.col("until").cast("timestamp").alias("until"))
    opened = spans.withColumn("cell", F.floor(F.unix_timestamp("since") / CELL))
    marks = spans.select("pattern", F.col("since").alias("at"), F.struct("since", "until").alias("span"), F.lit(None).cast("long").alias("cell")).unionByName(
        asked.select("pattern", F.timestamp_seconds(F.col("cell") * CELL).alias("at"), F.lit(None).cast("struct<since:timestamp,until:timestamp>").alias("span"), "cell"))
    # Of an interval and a cell at the same instant either order is right: that interval opens in the cell.
    before = Window.partitionBy("pattern").orderBy("at", F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = marks.withColumn("span", F.last("span", ignorenulls=True).over(before)).where("cell IS NOT NULL AND span.since < at AND (span.until IS NULL OR span.until > at)")
    return opened.unionByName(running.select("pattern", "span.since", "span.until", "cell"))


def filtered(captures: DataFrame, entries: DataFrame, page_id: str = "page_id", url: str = "url", fetched: str | Column = "fetched_at") -> DataFrame:
    """One row for each row of ``captures``: page_id, host, fetched_at, n_active, pattern, blocked.

    A pattern is a host or a domain above it. n_active counts the patterns on the list when the capture was fetched, pattern
    is the longest of them (null: none), blocked tells whether there is one. An interval holds from its first instant up to,
    not including, its end. A URL without a host and a null time meet nothing; repeated rows are kept; empty tables give no
    rows or no blocks; other columns are not read.

    Each distinct (host, time) looks up once, so a hot host costs what its distinct times cost. Lookups and intervals meet by
    an equi-join on (domain, time cell); within it a capture only sees the intervals that touch its cell.
    """
    seconds = F.unix_timestamp(F.col("fetched_at").cast("timestamp"))
    rows = captures.select(F.col(page_id).alias("page_id"), host(url).alias("host"), (F.col(fetched) if isinstance(fetched, str) else fetched).cast("timestamp").alias("fetched_at"))
    asked = rows.where("host IS NOT NULL AND fetched_at IS NOT NULL").select("host", "fetched_at").distinct()
    looks = asked.select("host", "fetched_at", F.floor(seconds / CELL).alias("cell"), F.explode(domains(F.col("host"))).alias("pattern"))
    listed = in_cells(intervals(entries), looks.select("pattern", "cell").distinct())
    active = looks.join(listed, ["pattern", "cell"]).where("since <= fetched_at AND (until IS NULL OR fetched_at < until)")
    found = active.groupBy("host", "fetched_at").agg(F.countDistinct("pattern").alias("n_active"), F.max_by("pattern", F.length("pattern")).alias("pattern"))
    return rows.join(found, ["host", "fetched_at"], "left").select("page_id", "host", "fetched_at", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"), "pattern", F.col("pattern").isNotNull().alias("blocked"))
