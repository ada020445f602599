"""Which of a key's seconds fire when every fire is followed by a quiet time.

A stretch of time is a function: from the end of the quiet time that reaches into it to the end of
the one that reaches out of it. Only seconds up to one quiet time after its start, and the first
beyond, can be met by what reaches in, so a function is a sorted table of that many seconds. Days
get theirs from their own seconds, 86,400 at most; longer stretches are composed from ``FAN`` shorter ones.
From the top the ends are handed down again, and each day then fires on its own. Work is linear in
the distinct seconds, the number of shuffles follows the logarithm of the time span to base ``FAN``, and no
task ever holds more of a key than a day's seconds or ``FAN`` tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.session import materialize, materialize_observed

DAY = 86400
FAN = 32
#: Nothing reaches into the first stretch of a key.
_FREE = -(1 << 62)


def _chain_ends(secs: np.ndarray, quiet: np.ndarray) -> np.ndarray:
    """For each of the sorted seconds, if it fires: when the last quiet time ends that follows from it."""
    end = secs + quiet
    after = np.searchsorted(secs, end)
    last = np.where(after < len(secs), after, np.arange(len(secs)))
    while not np.array_equal(last, last[last]):
        last = last[last]
    return end[last]


def _step(secs: np.ndarray, ends: np.ndarray, until: np.ndarray) -> np.ndarray:
    """What ``until`` becomes behind a stretch with this table."""
    at = np.searchsorted(secs, until)
    met = at < len(secs)
    return np.where(met, ends[np.minimum(at, len(secs) - 1)], until)


def _cut(secs: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.searchsorted(secs, limit, side="right") + 1
    return secs[:n], ends[:n]


def _tables(group: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(block, seconds, ends) of the rows of a group, in order of time."""
    rows = group.select(["block", "secs", "ends"]).sort_by("block")
    return [(b.as_py(), s.values.to_numpy(), e.values.to_numpy()) for b, s, e in zip(*[c.combine_chunks() for c in rows.columns], strict=True)]


def _result(group: pa.Table, keys: list[str], columns: dict[str, pa.Array]) -> pa.Table:
    """``columns`` beside the keys of the group."""
    n = len(next(iter(columns.values())))
    first = group.select(keys).take(pa.array(np.zeros(n, np.int64)))
    return pa.table([*first.columns, *columns.values()], names=[*keys, *columns])


def fires(seconds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sec) of the rows of ``seconds`` (keys, sec, quiet) that fire; rows are distinct, quiet is over 0."""
    kinds = {f.name: f.dataType.simpleString() for f in seconds.schema}
    own = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    dated = seconds.select(*keys, F.col("sec").cast("long").alias("sec"), F.col("quiet").cast("long").alias("quiet"), F.floor(F.col("sec") / DAY).alias("block"))
    dated, seen = materialize_observed(dated, "seconds", low=F.min("block"), high=F.max("block"), longest=F.max("quiet"))
    if seen["low"] is None:
        return dated.select(*keys, "sec")
    low, high, longest = seen["low"], seen["high"], seen["longest"]

    def of_day(group: pa.Table) -> pa.Table:
        rows = group.sort_by("sec")
        secs, block = rows["sec"].to_numpy(), rows["block"][0].as_py()
        secs, ends = _cut(secs, _chain_ends(secs, rows["quiet"].to_numpy()), block * DAY + longest)
        return _result(group, keys, {"block": pa.array([block], pa.int64()), "secs": pa.array([secs]), "ends": pa.array([ends])})

    def of_stretch(length: int):
        def compose(group: pa.Table) -> pa.Table:
            tables = _tables(group)
            block = tables[0][0] // FAN
            limit = block * length + longest
            found_secs, found_ends = [], []
            for k, (_, secs, ends) in enumerate(tables):
                if found_secs and found_secs[-1][-1] > limit:
                    break
                secs, ends = _cut(secs, ends, limit)
                for _, later, later_ends in tables[k + 1 :]:
                    ends = _step(later, later_ends, ends)
                found_secs.append(secs)
                found_ends.append(ends)
            secs, ends = _cut(np.concatenate(found_secs), np.concatenate(found_ends), limit)
            return _result(group, keys, {"block": pa.array([block], pa.int64()), "secs": pa.array([secs]), "ends": pa.array([ends])})

        return compose

    def enter(group: pa.Table, until: int = _FREE) -> pa.Table:
        blocks, reached = [], []
        for block, secs, ends in _tables(group):
            blocks.append(block)
            reached.append(until)
            until = int(_step(secs, ends, np.array([until]))[0])
        return _result(group, keys, {"block": pa.array(blocks, pa.int64()), "until": pa.array(reached, pa.int64())})

    def fire(rows: pa.Table, reached: pa.Table) -> pa.Table:
        rows = rows.sort_by("sec")
        secs, quiet = rows["sec"].to_numpy(), rows["quiet"].to_numpy()
        after = np.searchsorted(secs, secs + quiet)
        at, hit = int(np.searchsorted(secs, reached["until"][0].as_py())), []
        while at < len(secs):
            hit.append(at)
            at = int(after[at])
        return _result(rows, keys, {"sec": pa.array(secs[hit])})

    table = f"{own}block long, secs array<long>, ends array<long>"
    levels, length = [dated.groupBy(*keys, "block").applyInArrow(of_day, table)], DAY
    up = lambda: F.floor(F.col("block") / FAN).alias("above")
    while high - low >= FAN:
        levels[-1] = materialize(levels[-1], "stretches")
        length *= FAN
        levels.append(levels[-1].groupBy(*keys, up()).applyInArrow(of_stretch(length), table))
        low, high = low // FAN, high // FAN
    state = f"{own}block long, until long"
    reached = levels[-1].groupBy(*keys).applyInArrow(lambda group: enter(group), state)
    for lower in reversed(levels[:-1]):
        both = lower.groupBy(*keys, up()).cogroup(reached.groupBy(*keys, "block"))
        reached = both.applyInArrow(lambda group, above: enter(group, above["until"][0].as_py()), state)
    return dated.groupBy(*keys, "block").cogroup(reached.groupBy(*keys, "block")).applyInArrow(fire, f"{own}sec long")
