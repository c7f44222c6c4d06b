"""Leases as keyed streaming state: grants and lookups in, trust out.

The log has a watermark: events come in order but for its delay, state whose last lease and deadline the
watermark has passed is dropped, and so are events behind it.  Within a batch events are put in order.

State is a table of the events that one still to come can touch, as the bytes of an array.  A batch is
worked off column by column: its cost is that of sorting it, whatever the number of keys and holders.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairnstore.operators.coherence import BUMPS
from cairnstore.operators.gc import HOUR

OUT = "holder long, object long, seq long, trusted boolean"
RECALLS = "object long, m_seq long, started long, acked long"
#: Groups of state that the keys of leases share: a batch costs a call for each group, not for each key.
BUCKETS = 1024
#: A time after all others, for lookups that have none.
NEVER = 1 << 62
GRANT, LOOKUP, BUMP = range(3)


def _expire(state, micros: int) -> None:
    """Let the state go once the watermark has passed this time."""
    state.setTimeoutTimestamp(max(micros // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def _with_held(state, frames: Iterable[pd.DataFrame], columns: tuple[str, ...]) -> np.ndarray:
    """The events held and those that came, a row for each column."""
    came = pd.concat(list(frames))
    new = np.stack([came[c].to_numpy(np.int64) for c in columns])
    if not state.exists:
        return new
    return np.concatenate([np.frombuffer(state.get[0], np.int64).reshape(len(columns), -1), new], axis=1)


def _hold(state, events: np.ndarray, until: np.ndarray, horizon: int) -> None:
    """Keep the events that matter until ``horizon`` or later."""
    kept = until >= horizon
    if kept.any():
        state.update((events[:, kept].tobytes(),))
        _expire(state, int(until[kept].max()))
    elif state.exists:
        state.remove()


def _horizon(state, at: np.ndarray, delay: int) -> int:
    """No event before this time comes in a later batch.  The watermark counts in milliseconds."""
    now = at[at < NEVER].max(initial=0)
    return max(int(now) - delay - 1000, state.getCurrentWatermarkMs() * 1000)


def _trust(lease: int, delay: int):
    columns = ("kind", "holder", "object", "at", "seq")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # no event that may still come finds the lease unexpired
            state.remove()
            return
        log = _with_held(state, frames, columns)
        nulls = log[0] >> 1
        log = log[:, np.lexsort((log[4], log[3], log[2], log[1], nulls & 3))]
        kind, holder, object_, at, seq = log
        granted, nulls = (kind & 1) == 1, kind >> 1
        who, place = np.stack([nulls & 3, holder, object_]), np.arange(len(at))
        first = np.append(True, (who[:, 1:] != who[:, :-1]).any(axis=0))
        begin = np.maximum.accumulate(np.where(first, place, 0))
        last = np.maximum.accumulate(np.where(granted, place, -1))
        trusted = (last >= begin) & (at - at[last] <= lease)
        asked = ~granted
        shown = {c: pd.arrays.IntegerArray(v[asked].copy(), (nulls[asked] >> n & 1) > 0) for n, (c, v) in enumerate((("holder", holder), ("object", object_), ("seq", seq)))}
        yield pd.DataFrame(shown | {"trusted": trusted[asked]})
        # A grant counts until its lease ends, or until the key's next grant is behind the horizon.
        horizon, grants, who = _horizon(state, at, delay), log[:, granted], who[:, granted]
        ends = grants[3] + lease
        followed = np.append((who[:, 1:] == who[:, :-1]).all(axis=0), False)[: len(ends)]
        ends = np.where(followed, np.minimum(ends, np.append(grants[3][1:], 0)[: len(ends)]), ends)
        _hold(state, grants, ends, horizon)

    return run


def lease_state(log: DataFrame, lease: int, delay: int = HOUR) -> DataFrame:
    """For each lookup of a stream (holder, object, op, at, seq): whether the holder's last grant still holds.

    Keys are dealt into ``BUCKETS`` groups; a group's state holds each key's grants that may still be asked for.
    ``delay`` is the watermark's, in microseconds.
    """
    known = log.where("op = 'lookup' OR op = 'grant' AND at IS NOT NULL")
    kind = (F.col("op") == "grant").cast("long")
    for n, c in enumerate(("holder", "object", "seq")):
        kind = kind + F.col(c).isNull().cast("long") * (2 << n)
    whole = lambda c, other: F.coalesce(c, F.lit(other).cast("long")).alias(c)
    known = known.select(
        F.pmod(F.xxhash64("holder", "object"), F.lit(BUCKETS)).alias("bucket"), "ts", kind.alias("kind"), whole("holder", 0), whole("object", 0), whole("at", NEVER), whole("seq", NEVER)
    )
    return known.groupBy("bucket").applyInPandasWithState(_trust(lease, delay), OUT, "held binary", "append", "EventTimeTimeout")


def counts(kind: np.ndarray, holder: np.ndarray, at: np.ndarray, lease: int, deadline: int) -> tuple[np.ndarray, np.ndarray]:
    """For each mutation of one object: the other holders that it recalls, and those that answer in time.

    The sums of ``coherence.recalls``: leases, and the times from which a lookup would be in time, are
    intervals; what their ends change, summed over holders, is read off at the mutations.
    """
    g, a, m = (kind == k for k in (GRANT, LOOKUP, BUMP))
    n_g, n_a, n_m = g.sum(), a.sum(), m.sum()
    one = lambda *signs: np.repeat(np.array(signs, np.int64), (n_g, n_g, n_a, n_a, n_m))
    who = np.concatenate([holder[g], holder[g], holder[a], holder[a], holder[m]])
    t = np.concatenate([at[g], at[g] + lease + 1, at[a] - deadline, at[a], at[m]])
    told = one(0, 0, 0, 0, 1)
    order = np.lexsort((told, t, who))
    held = np.cumsum(one(1, -1, 0, 0, 0)[order]) > 0  # each holder's sums end at zero
    heard = held & (np.cumsum(one(0, 0, 1, -1, 0)[order]) > 0)
    by_time = np.lexsort((told[order], t[order]))
    found = told[order][by_time] == 1
    place = order[by_time][found] - (len(t) - n_m)
    out = []
    for own in (held.astype(np.int64), heard.astype(np.int64)):
        every = np.cumsum(np.diff(own, prepend=0)[by_time]) - own[by_time]
        counted = np.empty(n_m, np.int64)
        counted[place] = every[found]
        out.append(counted)
    return out[0], out[1]


def _recalls(lease: int, deadline: int, delay: int):
    columns = ("kind", "holder", "at", "seq", "started", "acked")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = _with_held(state, frames, columns)
        kind, holder, at, seq = log[:4]
        bumps = np.flatnonzero(kind == BUMP)
        now = np.stack(counts(kind, holder, at, lease, deadline))
        more = now - log[4:, bumps]
        log[4:, bumps] = now
        new = more.any(axis=0)
        yield pd.DataFrame({"object": np.full(new.sum(), key[0], np.int64), "m_seq": seq[bumps][new], "started": more[0][new], "acked": more[1][new]})
        # Mutations wait for answers until their deadline; leases and answers count as long as such a mutation does.
        until = at + np.array([lease + deadline, deadline, deadline])[kind]
        _hold(state, log, until, _horizon(state, at, delay))

    return run


def recall_state(log: DataFrame, lease: int, deadline: int, delay: int = HOUR) -> DataFrame:
    """How many recalls a stream's mutations start, and how many are answered in time: what each batch adds, to be summed.

    A recall without an answer has timed out once the deadline has passed.  An object's state holds the
    mutations whose deadline hasn't passed, with what was told of them, and the grants and lookups that touch them.
    """
    kind = F.when(F.col("op") == "grant", GRANT).when(F.col("op") == "lookup", LOOKUP).when(F.col("op").isin(*BUMPS), BUMP).cast("long")
    none = F.lit(0).cast("long")
    known = log.withColumn("kind", kind).where("kind IS NOT NULL AND object IS NOT NULL AND holder IS NOT NULL AND at IS NOT NULL")
    known = known.select("ts", "object", "kind", "holder", "at", "seq", none.alias("started"), none.alias("acked"))
    return known.groupBy("object").applyInPandasWithState(_recalls(lease, deadline, delay), RECALLS, "held binary", "append", "EventTimeTimeout")
