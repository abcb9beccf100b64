"""Change feeds: what changed in a stream of status snapshots, notifications, and windows over events."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Minutes without news after which a key is forgotten.
DEADLINE = 30
#: Notices that an account keeps.
KEPT = 30
# Phases of a run, and the kinds of notices in the order in which one snapshot gives them.
RUNNING, FINISHED = ("uploaded", "queued", "processing"), ("ready", "failed")
KINDS = ("error", "completed", "critical")
RING = "array<struct<at:string,event:bigint,kind:int>>"


def changes(snapshots: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Snapshots whose state differs from the one before; the first of a key is a change (null before)."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return snapshots.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(state)) | F.col("before").isNull())


def notifications(snapshots: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows (…, phase, error, critical) that end a run: failed, ready, or ready with critical findings.

    The first sight of a file says nothing.
    """
    previous = F.lag("phase").over(Window.partitionBy(key).orderBy(*order))
    ended = (F.col("previous") == "processing") & (F.col("phase") != "processing")
    kind = F.when(F.col("error").isNotNull(), "error").when(F.col("critical") > 0, "critical").otherwise("ready")
    return snapshots.withColumn("previous", previous).where(ended).withColumn("kind", kind).drop("previous")


def notices(snapshots: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Snapshots (key, order, phase, error, critical) with ``kind``: a row for each notice that a file gives.

    A finished file gives an error that is new or ends a run; a run that ends ready is completed unless there is an
    error, and critical if there are critical findings. The first sight of a file says nothing.
    """
    last = Window.partitionBy(*key).orderBy(*order)
    text = F.coalesce("error", F.lit(""))
    seen = snapshots.withColumn("_before", F.lag(F.struct("phase", text.alias("error"))).over(last))
    ran = F.col("_before.phase").isin(*RUNNING)
    ready, failed = F.col("phase") == "ready", text != ""
    tests = [F.col("phase").isin(*FINISHED) & failed & (ran | (text != F.col("_before.error"))), ran & ready & ~failed, ran & ready & (F.col("critical") > 0)]
    kinds = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in enumerate(tests)]))
    return seen.where("_before IS NOT NULL").withColumn("kind", F.explode(kinds)).drop("_before")


def last_notices(found: DataFrame, account: str, file: str, order: list[str], kept: int = KEPT) -> DataFrame:
    """The ``kept`` newest notices of each account, numbered from 1: first of each file, then of all, so that an account
    with most of the files is not sorted in one task."""
    newest = [F.desc(c) for c in order]
    for keys in ([account, file], [account]):
        found = found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where(F.col("place") <= kept)
    return found.withColumn("place", F.col("place").cast("long"))


def notice_rings(events: DataFrame, account: str, file: str, time: str, event: str, kept: int = KEPT) -> DataFrame:
    """``notices`` over a stream: (account, file, n, ring) whenever a file has news. ``ring`` has its last ``kept`` notices,
    ``n`` counts all it ever had.

    The state of a file is its last snapshot and its ring, whatever happened before. An account's newest notices are
    among the newest of its files, so no state is kept for accounts. Rows of a batch are taken in order of time.
    """
    kinds = dict(events.dtypes)

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        phase, error, n, ring = held.get if held.exists else (None, "", 0, "[]")
        ring, before = json.loads(ring), n
        for row in pd.concat(list(batches)).sort_values([time, event], kind="stable").itertuples(index=False):
            told = row.error or ""
            if phase is not None:
                ran, ready = phase in RUNNING, row.phase == "ready"
                tests = (row.phase in FINISHED and told and (ran or told != error), ran and ready and not told, ran and ready and row.critical > 0)
                new = [[getattr(row, time).isoformat(), getattr(row, event), i] for i, test in enumerate(tests) if test]
                ring, n = (ring + new)[-kept:], n + len(new)
            phase, error = row.phase, told
        held.update((phase, error, n, json.dumps(ring)))
        if n > before:
            rows = json.dumps([{"at": at, "event": e, "kind": i} for at, e, i in ring])
            yield pd.DataFrame({account: [k[0]], file: [k[1]], "n": [n], "ring": [rows]})

    output = f"{account} {kinds[account]}, {file} {kinds[file]}, n long, ring string"
    told = events.groupBy(account, file).applyInPandasWithState(step, output, "phase string, error string, n long, ring string", "append", GroupStateTimeout.NoTimeout)
    return told.withColumn("ring", F.from_json("ring", RING))


def last_of_rings(rings: DataFrame, account: str, file: str, kept: int = KEPT) -> DataFrame:
    """What ``last_notices`` keeps, from all that ``notice_rings`` has written: (account, file, at, event, kind, place)."""
    newest = rings.groupBy(account, file).agg(F.max_by("ring", "n").alias("ring"))
    each = newest.select(account, file, F.explode("ring").alias("r")).select(account, file, F.to_timestamp("r.at").alias("at"), "r.event", "r.kind")
    return last_notices(each, account, file, ["at", "event", "kind"], kept)


def changes_stream(events: DataFrame, key: str, time: str, state: str, forget: bool = True) -> DataFrame:
    """The same over a stream: (key, time, before, state) for each change. Rows of a batch are taken in order of time.

    A key is forgotten after ``DEADLINE`` minutes without rows, so the state stays as large as what is active. A query
    that drains a table and stops takes ``forget=False``: timers would keep it alive.
    """
    kinds = dict(events.dtypes)
    output = f"{key} {kinds[key]}, {time} {kinds[time]}, before string, {state} string"

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches)).sort_values([time, state], kind="stable")
        last, out = (held.get[0] if held.exists else None), []
        for t, s in zip(rows[time], rows[state], strict=True):
            if s != last:
                out.append((k[0], t, last, s))
                last = s
        held.update((last,))
        if forget:
            held.setTimeoutDuration(DEADLINE * 60 * 1000)
        yield pd.DataFrame(out, columns=[key, time, "before", state])

    return events.groupBy(key).applyInPandasWithState(step, output, "last string", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(by, start, n, total) in tumbling windows; on a stream, rows later than ``late`` are left out."""
    if late:
        events = events.withWatermark(time, late)
    grouped = events.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(by, F.col("w.start").alias("start"), "n", "total")
