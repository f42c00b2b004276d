"""Sessions of clicks that arrive out of order, closed by a Structured Streaming query whose state holds gaps.

State is the complement of the open sessions: for each client the ordered gaps of more than 30 minutes without clicks, the
endless ones before the first and after the last click included, each with the running totals of all clicks before it. A
session lies between two neighbouring gaps, and its totals are the difference of theirs. Arriving clicks shrink gaps, split
them, or leave nothing of more than 30 minutes: a deleted gap between two open sessions is a merge.

Clicks of one client and half hour are always one session, so they are added up before the state sees them: what a client
sends there grows with time, not with its clicks. Clients share a state row by a hash, in as many rows as the clicks need.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from provenir import storage
from provenir.llm.common import bound_batches

HOUR = 3_600_000_000
GAP = HOUR // 2
#: Ends of the endless gaps; a difference of the two still fits.
LOW, HIGH = -(1 << 61), 1 << 61
#: Clicks for which there is a state row, and the least number of rows. This decides which task does the work, never what is found.
STATE_CLICKS, STATE_ROWS = 20_000, 256
#: Fragments that a task holds before it adds them up.
HELD = 200_000
FRAGMENT = ("client_id", "first_us", "last_us", "n", "crc")
GAPS = ("client_id", "left", "right", "n", "crc", "merges")
_SESSIONS = "client_id long, first_us long, last_us long, n_clicks long, ids_crc32 long, n_merges long, close_batch long"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is UTC, whatever the session's zone."""
    if not isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    units = {"DAY": 24 * HOUR, "HOUR": HOUR, "MINUTE": HOUR // 60, "SECOND": 1_000_000}
    since = f"{name} - TIMESTAMP_NTZ '1970-01-01 00:00:00'"
    return F.expr(" + ".join(f"CAST(CAST(extract({unit} FROM {since}) AS DECIMAL(20, 6)) * {size} AS BIGINT)" for unit, size in units.items()))


# -- gaps of a state row ---------------------------------------------------------------------------------------------


def _added_up(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Fragments of one client and half hour as one."""
    slot = f["first_us"] // GAP
    order = np.lexsort((slot, f["client_id"]))
    client, slot = f["client_id"][order], slot[order]
    new = np.ones(len(order), bool)
    new[1:] = (client[1:] != client[:-1]) | (slot[1:] != slot[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return f
    how = {"client_id": np.minimum, "first_us": np.minimum, "last_us": np.maximum, "n": np.add, "crc": np.add}
    return {c: how[c].reduceat(f[c][order], at) for c in FRAGMENT}


def absorb(gaps: dict[str, np.ndarray], f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The gaps that arriving fragments leave, with their new totals; both are of many clients, gaps ordered by client and time.

    A fragment is a stretch of clicks without a longer pause than ``GAP``. Its ends are points; a gap with points inside
    falls into pieces, of which those longer than ``GAP`` stay.
    """
    fresh = np.setdiff1d(f["client_id"], gaps["client_id"])
    zero = np.zeros(len(fresh), np.int64)
    g = {c: np.concatenate([gaps[c], x]) for c, x in zip(GAPS, (fresh, zero + LOW, zero + HIGH, zero, zero, zero))}
    k, m = len(g["client_id"]), len(f["client_id"])
    client = np.concatenate([g["client_id"], f["client_id"], f["client_id"]])
    time = np.concatenate([g["left"], f["first_us"], f["last_us"]])
    kind = np.repeat([0, 1, 2], [k, m, m])
    order = np.lexsort((kind, time, client))
    client, time, kind = client[order], time[order], kind[order]
    gap = order[np.maximum.accumulate(np.where(kind == 0, np.arange(len(order)), 0))]  # the last gap that begins before; a client's first item is one
    part = (kind == 0) | (time < g["right"][gap])
    total = {}
    for c in ("n", "crc"):
        run = np.cumsum(np.concatenate([np.zeros(k, np.int64), f[c], np.zeros(m, np.int64)])[order])
        first = np.ones(len(client), bool)
        first[1:] = client[1:] != client[:-1]
        total[c] = run - run[np.maximum.accumulate(np.where(first, np.arange(len(client)), 0))]
    at = np.flatnonzero(part)
    right = g["right"][gap[at]]
    same = gap[at][1:] == gap[at][:-1]
    right[:-1][same] = time[at][1:][same]
    stays = right - time[at] > GAP
    pieces = np.zeros(k, np.int64)
    np.add.at(pieces, gap[at], stays)
    heads = order[np.flatnonzero(kind == 0)]  # gaps in order
    gone = (pieces[heads] == 0) & (g["left"][heads] > LOW) & (g["right"][heads] < HIGH)
    before = np.zeros(k, np.int64)
    before[heads] = np.cumsum(gone) - gone
    owner = g["client_id"][heads]
    lead = np.ones(k, bool)
    lead[1:] = owner[1:] != owner[:-1]
    base = np.zeros(k, np.int64)
    base[heads] = before[heads][np.maximum.accumulate(np.where(lead, np.arange(k), 0))] if k else 0
    at, right, src = at[stays], right[stays], gap[at][stays]
    return {
        "client_id": client[at],
        "left": time[at],
        "right": right,
        "n": g["n"][src] + total["n"][at],
        "crc": g["crc"][src] + total["crc"][at],
        "merges": g["merges"][src] + before[src] - base[src],
    }


def close(gaps: dict[str, np.ndarray], before: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(sessions whose last click is before an instant, gaps that are left). A client without open sessions leaves nothing."""
    n = len(gaps["client_id"])
    ends = np.zeros(n, bool)  # whether the session after this gap closes
    ends[:-1] = (gaps["client_id"][1:] == gaps["client_id"][:-1]) & (gaps["left"][1:] < before)
    i = np.flatnonzero(ends)
    sessions = {"client_id": gaps["client_id"][i], "first_us": gaps["right"][i], "last_us": gaps["left"][i + 1]}
    sessions |= {to: gaps[c][i + 1] - gaps[c][i] for c, to in (("n", "n_clicks"), ("crc", "ids_crc32"), ("merges", "n_merges"))}
    rest = {c: gaps[c][~ends] for c in GAPS}
    lead = np.ones(len(rest["client_id"]), bool)
    lead[1:] = rest["client_id"][1:] != rest["client_id"][:-1]
    head = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0)) if len(lead) else np.zeros(0, np.int64)
    for c in ("n", "crc", "merges"):
        rest[c] = rest[c] - rest[c][head]
    rest["left"] = np.where(lead, LOW, rest["left"])
    some = ~(lead & (rest["right"] == HIGH))
    return sessions, {c: rest[c][some] for c in GAPS}


# -- the stream ------------------------------------------------------------------------------------------------------


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of a task's rows, added up by client and half hour."""
    held, n = [], 0
    for batch in batches:
        held.append({c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in FRAGMENT})
        n += batch.num_rows
        if n > HELD:
            held = [_added_up({c: np.concatenate([h[c] for h in held]) for c in FRAGMENT})]
            n = 0  # what is added up already isn't counted again
    if held:
        out = _added_up({c: np.concatenate([h[c] for h in held]) for c in FRAGMENT})
        yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in FRAGMENT], names=list(FRAGMENT))


def _folded(before: int, batch: int):
    """The state's step: absorb what arrived, close what ended before an instant."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        gaps = dict(zip(GAPS, (np.frombuffer(x, np.int64) for x in state.get))) if state.exists else {c: np.zeros(0, np.int64) for c in GAPS}
        if not state.hasTimedOut:
            frames = [p for p in parts if len(p)]
            if frames:
                gaps = absorb(gaps, _added_up({c: np.concatenate([p[c].to_numpy(np.int64) for p in frames]) for c in FRAGMENT}))
        sessions, gaps = close(gaps, before)
        if len(gaps["client_id"]):
            state.update(tuple(np.ascontiguousarray(gaps[c]).tobytes() for c in GAPS))
            state.setTimeoutDuration(1)  # a row without new clicks is visited in the next batch too
        elif state.exists:
            state.remove()
        yield pd.DataFrame(sessions | {"close_batch": np.full(len(sessions["client_id"]), batch)})

    return step


def closed_sessions(clicks: DataFrame, *, rows: int, late: int | None, before: int, batch: int) -> DataFrame:
    """The sessions that one micro-batch closes, of a streaming frame ``client_id, us, crc``, with ``rows`` state rows.

    Clicks before ``late`` are dropped, sessions that end before ``before`` close and are marked with ``batch``; rows
    without a client are ignored.
    """
    kept = clicks.filter("client_id is not null and us is not null" if late is None else f"client_id is not null and us >= {late}")
    kinds = ", ".join(f"{c} long" for c in FRAGMENT)
    single = kept.select("client_id", F.col("us").alias("first_us"), F.col("us").alias("last_us"), F.lit(1).cast("long").alias("n"), "crc")
    # Twice: in the reading task, then where the rest of a client's half hour meets.
    whole = single.mapInArrow(_fragments, kinds).repartition("client_id", F.floor(F.col("first_us") / F.lit(GAP))).mapInArrow(_fragments, kinds)
    keyed = whole.withColumn("row", F.pmod(F.xxhash64("client_id"), F.lit(rows)))
    state = ", ".join(f"{c} binary" for c in GAPS)
    return keyed.groupBy("row").applyInPandasWithState(_folded(before, batch), _SESSIONS, state, "append", "ProcessingTimeTimeout")


def cut_batches(clicks: DataFrame, path: str, batches: int = 8) -> tuple[list[int | None], int]:
    """Write clicks in batches by arrival, as folders ``b0`` ..; (the largest ts through each batch, rows written).

    Each click_id counts once (its least row by ts, arrival and client); rows without click_id, client_id or ts are left
    out; a click without ``arrived_at`` arrives at its ts. Hours of arrival are dealt evenly over the batches; a client's
    hour of clicks is one batch late where crc32 of ``client_id:ts hour`` is divisible by 3.
    """
    spark = clicks.sparkSession
    us = micros(clicks, "ts")
    rows = clicks.filter("click_id is not null and client_id is not null and ts is not null").select(F.col("click_id").cast("long"), us.alias("us"), F.coalesce(micros(clicks, "arrived_at"), us).alias("arrived"), F.col("client_id").cast("long"))
    once = rows.groupBy("click_id").agg(F.min(F.struct("us", "arrived", "client_id")).alias("x"))
    hours = lambda c: F.floor(F.col(c) / F.lit(HOUR)).cast("long")  # noqa: E731  whole numbers up to 2 ** 53 divide exactly enough
    once = once.select("x.client_id", "x.us", hours("x.arrived").alias("h"), F.crc32(F.col("click_id").cast("string").cast("binary")).alias("crc"))
    once = storage.cut(once, "clicks")
    lo, hi, n = once.agg(F.min("h"), F.max("h"), F.count("*")).first()
    lo, hi = (lo, hi) if n else (0, 0)
    base = F.expr(f"{batches} * (h - {lo}L) div {hi - lo + 1}L")
    moved = F.crc32(F.concat_ws(":", F.col("client_id").cast("string"), hours("us").cast("string")).cast("binary")) % 3 == 0
    dealt = once.withColumn("batch", F.least(base + moved.cast("long"), F.lit(batches - 1).cast("long"))).select("client_id", "us", "crc", "batch")
    dealt = dealt.repartitionByRange("batch", "client_id", "us")
    # A row of nulls, so that no batch is empty and each start visits the state.
    dealt = dealt.unionByName(spark.range(batches).select(F.lit(None).cast("long").alias("client_id"), F.lit(None).cast("long").alias("us"), F.lit(None).cast("long").alias("crc"), F.col("id").alias("batch")))
    dealt.write.partitionBy("batch").parquet(f"{path}/dealt")
    most = dict(spark.read.parquet(f"{path}/dealt").groupBy("batch").agg(F.max("us")).collect())
    top, tops = None, []
    for b in range(batches):
        top = max((x for x in (top, most[b]) if x is not None), default=None)
        tops.append(top)
    return tops, n


def _move(spark: SparkSession, source: str, target: str) -> None:
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    files = a.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(b.getParent())
    if not files.rename(a, b):
        raise OSError(f"{source} can't be moved to {target}")


def session_gaps(clicks: DataFrame, *, batches: int = 8, lateness_hours: int = 240) -> DataFrame:
    """One row per session: ``client_id, first_us, last_us, n_clicks, ids_crc32, n_merges, close_batch``.

    Clicks are cut into batches (:func:`cut_batches`), which a streaming query reads in order, started anew for each on one
    checkpoint. After batch b the watermark is the largest ts so far less ``lateness_hours``: clicks of the next batch
    below it are dropped, and sessions whose last click is more than 30 minutes before it close as b; the rest close at
    the end, as ``batches``. Clicks of a client at most 30 minutes apart share a session; ``n_merges`` counts the open
    sessions beyond the first that batches joined in it. An empty table gives an empty result; ties and repeated rows
    change nothing beyond their counts; further columns are ignored. Every call has a folder of its own in shared storage.
    """
    spark = clicks.sparkSession
    bound_batches(spark)
    path = os.path.join(storage.shared_dir(spark), f"sessions-{uuid.uuid4().hex}")
    storage.keep(spark, path)
    tops, n = cut_batches(clicks, path, batches)
    rows = max(STATE_ROWS, n // STATE_CLICKS)
    marks = [None if t is None else t - lateness_hours * HOUR for t in tops]
    for b in range(batches):
        _move(spark, f"{path}/dealt/batch={b}", f"{path}/feed/b{b}")
        stream = spark.readStream.schema("client_id long, us long, crc long").parquet(f"{path}/feed/*")
        last = b == batches - 1
        before = HIGH if last else LOW if marks[b] is None else marks[b] - GAP
        # The last visit closes twice: what the watermark closes as its batch, the rest as one more.
        out = closed_sessions(stream, rows=rows, late=marks[b - 1] if b else None, before=before, batch=b)
        if last:
            out = out.withColumn("close_batch", F.when(F.col("last_us") < F.lit(LOW if marks[b] is None else marks[b] - GAP), F.col("close_batch")).otherwise(F.lit(batches)).cast("long"))
        query = out.writeStream.format("parquet").option("path", f"{path}/sessions").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(once=True).start()
        query.awaitTermination()
    return spark.read.schema(_SESSIONS).parquet(f"{path}/sessions")


def oracle(batches: int = 8, lateness_hours: int = 240) -> str:
    """SQL of op13 on ``clicks``: sessions of all clicks that aren't late; merges from the components through each batch."""

    def crc(text: str) -> str:
        return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1])), 4294967295)"

    return f"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), once AS (
  SELECT click_id, m.c AS client_id, epoch_us(m.ts) AS us, epoch_us(m.a) // {HOUR} AS h FROM (
    SELECT click_id, min({{'ts': ts, 'a': coalesce(arrived_at, ts), 'c': client_id}}) AS m FROM clicks
    WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL GROUP BY click_id)
), hours AS (
  SELECT client_id, hour, {crc("client_id || ':' || hour")} % 3 = 0 AS moved FROM (SELECT DISTINCT client_id, us // {HOUR} AS hour FROM once), tab
), dealt AS (
  SELECT o.client_id, us, {crc("click_id::VARCHAR")} AS crc,
    least({batches - 1}, {batches} * (h - (SELECT min(h) FROM once)) // ((SELECT max(h) - min(h) FROM once) + 1) + moved::BIGINT) AS b
  FROM once o JOIN hours k ON k.client_id = o.client_id AND k.hour = us // {HOUR}, tab
), marks AS (
  SELECT r.b, (SELECT max(us) FROM dealt WHERE dealt.b <= r.b) - {lateness_hours * HOUR} AS w FROM range({batches}) AS r(b)
), kept AS (
  SELECT d.* FROM dealt d LEFT JOIN marks m ON m.b = d.b - 1 WHERE m.w IS NULL OR us >= m.w
), named AS (
  SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client_id ORDER BY us) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM kept)
), parts AS (
  SELECT client_id, s, upto, part, min(b) AS least FROM (
    SELECT *, sum(fresh2) OVER (PARTITION BY client_id, s, upto ORDER BY us ROWS UNBOUNDED PRECEDING) AS part FROM (
      SELECT n.*, r.upto, CASE WHEN us - lag(us) OVER (PARTITION BY client_id, s, r.upto ORDER BY us) <= {GAP} THEN 0 ELSE 1 END AS fresh2
      FROM named n, range({batches}) AS r(upto) WHERE n.b <= r.upto))
  GROUP BY ALL
), merges AS (
  SELECT client_id, s, count(*) FILTER (least = upto) - 1 AS n_merges FROM parts GROUP BY ALL
), sessions AS (
  SELECT client_id, s, min(us) AS first_us, max(us) AS last_us, count(*) AS n_clicks, sum(crc) AS ids_crc32 FROM named GROUP BY ALL
)
SELECT client_id, first_us, last_us, n_clicks::BIGINT AS n_clicks, ids_crc32::BIGINT AS ids_crc32, n_merges::BIGINT AS n_merges,
  coalesce((SELECT min(b) FROM marks WHERE last_us < w - {GAP}), {batches})::BIGINT AS close_batch
FROM sessions JOIN merges USING (client_id, s)
"""
