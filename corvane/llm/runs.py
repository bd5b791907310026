"""Runs of consecutive events with the same name, as one event each.

Boundary-only rows: only events that differ from their predecessor are kept; the lead over these starts gives where a run
ends, position differences give counts, and the timestamp of the event before the next start gives the duration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.ordering import BLOCK, in_block, ordered_blocks


def tool_key(name: Column) -> Column:
    """Lower case, nothing but a-z and 0-9; null where nothing is left."""
    key = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return F.when(key != "", key)


def sequence_events(df: DataFrame, session: str, event_id: str, name: str, position: str, time: str, ingested: str | None = None) -> DataFrame:
    """One row per event id: s, id, name, pos, us. Of repeated ids the first ingested row counts (ties: the smallest values).

    Rows without a session or without an id belong to no sequence and are left out.
    """
    pick = F.struct(
        *([F.col(ingested).alias("i")] if ingested else []), F.col(session).alias("s"), F.col(position).cast("long").alias("pos"),
        tool_key(F.col(name)).alias("name"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"),
    )
    rows = df.where(F.col(session).isNotNull() & F.col(event_id).isNotNull()).select(F.col(event_id).alias("id"), pick.alias("r"))
    return rows.groupBy("id").agg(F.min("r").alias("r")).select("r.s", "id", "r.name", "r.pos", "r.us")


ORDER = [F.asc_nulls_first, F.asc]


def sequence_order() -> list[Column]:
    return [F.col("pos").asc_nulls_first(), F.col("id").asc()]


def collapse_runs(
    df: DataFrame, session: str = "session_id", event_id: str = "id", name: str = "tool_name", position: str = "execution_order",
    time: str = "timestamp", ingested: str | None = "ingested_at", max_gap_seconds: float = 600.0,
) -> DataFrame:
    """One row per run: session, name, first_id, last_id, n_events, first_us, last_us, duration_us.

    An event continues the run of its predecessor in (position, id) if both have the same name (``tool_key``) and lie at most
    ``max_gap_seconds`` apart, in either direction. An event without a name, or next to one without a timestamp, is a run of
    its own; null positions come first; ties in position are ordered by id. Repeated ids count once. Empty input gives an
    empty result. Other columns of ``df`` play no part, whatever they are called. A session may be of any size: it is cut
    into blocks by order, see operators.ordering.
    """
    events = sequence_events(df, session, event_id, name, position, time, ingested)
    order = sequence_order()
    blocks = ordered_blocks(events, "s", order)
    last = F.struct("pos", "id", "name", "us")
    by = Window.partitionBy("s").orderBy(BLOCK)
    edges = blocks.groupBy("s", BLOCK).agg(F.count(F.lit(1)).alias("n"), F.max(last).alias("last"), F.max(F.col("pos").isNull()).alias("holes"))
    # Positions with nulls sort first in structs as well, so max(struct) is the last event of the block.
    before = edges.select(
        F.col("s").alias("bs"), F.col(BLOCK).alias("bb"), F.lag("last").over(by).alias("carried"),
        (F.sum("n").over(by) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy("s")).alias("total"),
        F.max("last").over(Window.partitionBy("s")).alias("final"),
    )
    w = in_block("s", order)
    rows = blocks.select("*", F.row_number().over(w).alias("rn"), F.lag(last).over(w).alias("lagged"))
    rows = rows.join(before, (F.col("s") == F.col("bs")) & (F.col(BLOCK) == F.col("bb")))
    rows = rows.select("s", BLOCK, "id", "name", "us", "total", "final", (F.col("rn") + F.col("offset")).alias("at"), F.coalesce("lagged", "carried").alias("prev"))
    continues = (F.col("name") == F.col("prev.name")) & (F.abs(F.col("us") - F.col("prev.us")) <= F.lit(int(max_gap_seconds * 1_000_000)))
    starts = rows.where(~F.coalesce(continues, F.lit(False)))
    # The next start may lie in a later block of the session: the first start of each block is carried back.
    nxt = F.struct("at", F.col("prev.id").alias("id"), F.col("prev.us").alias("us"))
    firsts = starts.groupBy("s", BLOCK).agg(F.min(nxt).alias("first"))
    after = firsts.select(F.col("s").alias("fs"), F.col(BLOCK).alias("fb"), F.lead("first").over(by).alias("later"))
    led = starts.select("*", F.lead(nxt).over(Window.partitionBy(BLOCK, "s").orderBy("at")).alias("led"))
    led = led.join(after, (F.col("s") == F.col("fs")) & (F.col(BLOCK) == F.col("fb")))
    end = F.coalesce("led", "later", F.struct((F.col("total") + 1).alias("at"), F.col("final.id").alias("id"), F.col("final.us").alias("us")))
    return led.select("s", "name", F.col("id").alias("first_id"), F.col("us").alias("first_us"), "at", end.alias("end")).select(
        F.col("s").alias("session"), "name", "first_id", F.col("end.id").alias("last_id"), (F.col("end.at") - F.col("at")).alias("n_events"),
        "first_us", F.col("end.us").alias("last_us"), (F.col("end.us") - F.col("first_us")).alias("duration_us"),
    )
