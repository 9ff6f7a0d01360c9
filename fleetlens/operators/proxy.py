"""Proxy-tier rules as data: round robin, sticky clients, health checks,
idle sessions (SURVEY #68, #69, #85, #86).

Connections and probes are long ordered sequences. Round robin and the
health state machine need positions along the whole sequence of a front
end / backend, so they use the chunked helpers of :mod:`.sequence`: each
key is cut into chunks of its order column, worked inside the chunk, and
stitched with windows over one-row-per-chunk summaries. A hot front end or
backend is therefore spread over many tasks and the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import ordered_index

# Proxy defaults of the published configuration.
DEFAULT_BACKENDS = 2
FALL = 3
RISE = 2
IDLE_GAP = "24 hours"


def assign_round_robin(conns: DataFrame, n: int = DEFAULT_BACKENDS, by: tuple[str, ...] = (),
                       order=("ts", "conn_id"), chunk: Column | None = None) -> DataFrame:
    """#68 new connections go to backends ``0..n-1`` in arrival order, per front end ``by``.

    ``chunk`` (default: the minute of ``ts``) splits the arrival order so
    that no task has to hold a whole front end; only the per-chunk counts
    (one row per minute) are ordered in one window.
    """
    ch = chunk if chunk is not None else F.date_trunc("minute", F.col(order[0]))
    seq = ordered_index(conns, list(order), ch, by, out="_seq")
    return seq.withColumn("backend", F.pmod(F.col("_seq") - 1, F.lit(n))).drop("_seq")


def sticky_backend(conns: DataFrame, n: int = DEFAULT_BACKENDS, ip_col: str = "client_ip") -> DataFrame:
    """#85 client address -> always the same backend (stateless hash; batch or stream)."""
    h = F.conv(F.substring(F.md5(F.col(ip_col)), 1, 8), 16, 10).cast("bigint")
    return conns.withColumn("backend", F.pmod(h, F.lit(n)).cast("int"))


def health_state(probes: DataFrame, fall: int = FALL, rise: int = RISE, key: str = "backend_id",
                 order: str = "probe_no", chunk_size: int = 100_000) -> DataFrame:
    """#69 state after each probe: starts up, down after ``fall`` failures in a row,
    up after ``rise`` successes in a row.

    Probes are worked in chunks of ``order``:

    1. inside each chunk: a probe's place in its run of equal results and the
       state changes of all runs that begin there; only the chunk's first run
       may go on from the chunk before;
    2. one summary row per chunk (size, first and last result, length of the
       first run, last change) and windows over those rows give each chunk the
       length of the run that it continues and the state it begins with;
    3. one join back: probes of the first run add the carried length.

    Every row-level window is bounded by a chunk; only the one-row-per-chunk
    summaries are ordered per backend. The result equals the single-window
    form (tested with several chunk sizes).
    """
    chunk = F.floor(F.col(order) / F.lit(chunk_size))
    within = Window.partitionBy(key, "_chunk").orderBy(order)
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    chunks = Window.partitionBy(key).orderBy("_chunk")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    limit = lambda ok: F.when(ok, F.lit(rise)).otherwise(F.lit(fall))

    rows = probes.withColumn("_chunk", chunk).withColumn("_lp", F.row_number().over(within))
    rows = rows.withColumn("_prev", F.lag("ok").over(within))
    rows = rows.withColumn("_begin", F.max(F.when(c("_prev") != c("ok"), c("_lp"))).over(running))  # NULL in the first run
    fires = c("_lp") - c("_begin") + 1 == limit(c("ok"))
    rows = rows.withColumn("_ev", F.when(fires, F.struct(c("_lp").alias("at"), (~c("ok")).alias("down"))))
    rows = rows.withColumn("_last", F.max("_ev").over(running))

    summ = rows.groupBy(key, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("ok", "_lp").alias("_first_ok"), F.max_by("ok", "_lp").alias("_last_ok"),
        F.count_if(c("_begin").isNull()).alias("_head"), F.max("_begin").alias("_tail_begin"), F.max("_ev").alias("_inner"))
    summ = summ.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = F.lag("_last_ok").over(chunks) == c("_first_ok")
    # where the run at a chunk's end began, in probes of the backend; a chunk of one run that goes on has none of its own
    began = F.when(c("_tail_begin").isNotNull(), c("_off") + c("_tail_begin")).when(F.coalesce(joined, F.lit(False)), F.lit(None)).otherwise(c("_off") + 1)
    summ = summ.withColumn("_began", began).withColumn("_joined", F.coalesce(joined, F.lit(False)))
    summ = summ.withColumn("_len", F.when(c("_joined"), c("_off") - F.max("_began").over(before) + 1).otherwise(F.lit(0)))
    at = limit(c("_first_ok")) - c("_len")  # place in the chunk at which the first run changes the state
    summ = summ.withColumn("_at", F.when((at >= 1) & (at <= c("_head")), at))
    down = F.when(c("_inner").isNotNull(), c("_inner.down")).when(c("_at").isNotNull(), ~c("_first_ok"))
    summ = summ.withColumn("_down", F.coalesce(F.last(down, ignorenulls=True).over(before), F.lit(False)))
    carry = summ.select(key, "_chunk", "_at", "_down", "_first_ok")

    p = rows.join(carry, [key, "_chunk"])
    now = F.when(c("_last").isNotNull(), c("_last.down")).when(c("_at") <= c("_lp"), ~c("_first_ok")).otherwise(c("_down"))
    return p.select(*probes.columns, F.when(now, F.lit("down")).otherwise(F.lit("up")).alias("state"))


_UNITS_US = {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}


def gap_us(gap: str) -> int:
    """Microseconds of a text like ``24 hours``."""
    n, unit = gap.split()
    return int(float(n) * _UNITS_US[unit.rstrip("s").lower()])


def idle_sessions(conns: DataFrame, gap: str = IDLE_GAP, key: str = "client_ip", ts: str = "ts",
                  chunk: Column | None = None) -> DataFrame:
    """#86 connections of one client joined until ``gap`` of silence.

    Same sessions as ``session_window(ts, gap)`` (a connection ``gap`` or
    more after the previous one starts a new session; the session ends
    ``gap`` after its last connection), computed so that one very busy
    client is not one task: a client's connections are cut into chunks of
    time (``chunk``, default the hour) and made into sessions inside each
    chunk; then neighbouring chunks' sessions are merged the same way. Rows
    never join back. The streaming form is
    :func:`fleetlens.streaming.streams.idle_sessions_stream`.
    """
    ch = chunk if chunk is not None else F.date_trunc("hour", F.col(ts))

    def merged(rows, by):
        """Rows (by, start, end, n) joined where the next begins less than the gap after the end."""
        w = Window.partitionBy(*by).orderBy("_start", "_end")
        prev = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = prev.isNull() | (F.timestamp_diff("MICROSECOND", prev, F.col("_start")) >= F.lit(gap_us(gap)))
        rows = rows.withColumn("_new", new.cast("int"))
        rows = rows.withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.groupBy(*by, "_id").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.sum("_n").alias("_n")).drop("_id")

    one = conns.select(key, ch.alias("_chunk"), F.col(ts).alias("_start"), F.col(ts).alias("_end"), F.lit(1).alias("_n"))
    s = merged(merged(one, [key, "_chunk"]).drop("_chunk"), [key])
    return s.select(key, F.col("_start").alias("session_start"), (F.col("_end") + F.expr(f"INTERVAL {gap}")).alias("session_end"),
                    F.col("_n").alias("n_conns"))
