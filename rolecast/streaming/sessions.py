"""Sessions of a key over a stream: when it opened, and when it closed for not being seen again.

State lives in the state store: of every open key its first and last time and a count. A key is due at
its last time plus the horizon; when the watermark passes it, the key is emitted as closed and leaves
the state, so the store holds only what is still open. A key seen again after more than the horizon
opens a new session, also within one batch.

Keys are followed by bucket of their hash: a call of Python costs far more than the rows of one key, so
it is made per bucket that has rows or a due key, not per key. A bucket's row of state lists its open
keys, and its event-time timer stands at the earliest of theirs. The number of `buckets` is part of a
stream's state: go on with the one it began with.

Rows that come later than the watermark are dropped by Spark and counted in the progress of the
stream (`late_rows`). The result depends on the rows' times and on which of them are late, not on
how the others are cut into batches.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "key string, state string, first_seen timestamp, last_seen timestamp, n_rows long"
_OPEN = "keys array<string>, first array<long>, last array<long>, n array<long>"
BUCKETS = 256


def _rows(found: list[tuple[str, str, int, int, int]]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=["key", "state", "first_seen", "last_seen", "n_rows"])
    for c in ("first_seen", "last_seen"):
        out[c] = pd.to_datetime(out[c].astype("int64"), unit="us", utc=True)
    return out


def _follow(horizon: int):
    """Follows the keys of one bucket; its state lists the open ones, its timer is the earliest of theirs."""
    due = lambda last: (last + horizon) // 1000 + 1

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found, now = [], state.getCurrentWatermarkMs()
        held = {k: (a, b, n) for k, a, b, n in zip(*state.get)} if state.exists else {}
        seen = {}
        if not state.hasTimedOut:
            # Rows of a key come in any order; times are small next to the rows themselves.
            for b in batches:
                for k, t in zip(b["key"].tolist(), b["_us"].tolist()):
                    seen.setdefault(k, []).append(t)
        for k in [k for k, x in held.items() if k not in seen and due(x[1]) < now]:
            found.append((k, "closed", *held.pop(k)))
        for k, times in seen.items():
            first, last, n = held.get(k, (None, None, 0))
            for t in sorted(times):
                if n and t - last > horizon:
                    found.append((k, "closed", first, last, n))
                    n = 0
                if not n:
                    first = last = t
                    found.append((k, "open", t, t, 1))
                # A row between watermark and first time moves the session's start back.
                first, last, n = min(first, t), max(last, t), n + 1
            held[k] = (first, last, n)
        if held:
            state.update(([*held], *([x[i] for x in held.values()] for i in range(3))))
            # Never before the watermark, which Spark refuses: then the next batch closes it.
            state.setTimeoutTimestamp(max(due(min(x[1] for x in held.values())), now + 1))
        else:
            state.remove()
        if found:
            yield _rows(found)

    return run


def sessions(stream: DataFrame, horizon: str, delay: str, key: str = "key", ts: str = "ts",
             buckets: int = BUCKETS) -> DataFrame:
    """(key, state, first_seen, last_seen, n_rows): a row 'open' when a key is first seen, or seen again
    after more than `horizon`, and a row 'closed' with the whole session when it was not seen for so
    long. `delay` bounds how late rows may come. Rows with a null key or time are no part of it.

    Of one session with late-coming rows in order, 'open' carries the first time that was met first;
    'closed' carries the true one."""
    length = stream.sparkSession.sql(f"SELECT INTERVAL '{horizon}' AS i").select(
        F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.col("i"))).first()[0]
    rows = (stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"))
            .where("key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
            .withColumn("_us", F.unix_micros("ts")).withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))))
    return rows.groupBy("_bucket").applyInPandasWithState(_follow(length), SESSION, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)


def closed_keys(stream: DataFrame, horizon: str, delay: str, key: str = "key", ts: str = "ts") -> DataFrame:
    """The sessions that ended: keys not seen for the horizon."""
    return sessions(stream, horizon, delay, key, ts).where("state = 'closed'").drop("state")


def first_rows(stream: DataFrame, horizon: str, delay: str, key: str = "key", ts: str = "ts") -> DataFrame:
    """(key, first_seen): each key once per session, the copies within the horizon left out."""
    return sessions(stream, horizon, delay, key, ts).where("state = 'open'").select("key", "first_seen")


def late_rows(query) -> int:
    """Rows of a finished or running stream that came after the watermark and were dropped."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in _plain(p)["stateOperators"])


def _plain(progress) -> dict:
    import json

    return progress if isinstance(progress, dict) else json.loads(progress.json)


def drain(df: DataFrame, root: str) -> list:
    """Runs a stream over all that has landed, into `root`/rows; gives the finished query. Called
    again with the same root it goes on where it stopped."""
    job = (df.writeStream.format("parquet").option("checkpointLocation", f"{root}/offsets").option("path", f"{root}/rows")
           .trigger(availableNow=True).start())
    job.awaitTermination()
    return job
