"""Quota, capacity and their presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairnstore.operators.folds import fold

NO_BYTES_LIMIT, NO_INODES_LIMIT = 1 << 50, 1 << 32


def admitted(log: DataFrame, scope: str, limit: int) -> DataFrame:
    """``log`` (scope, seq, delta) with accepted and used, admitted in order of seq.

    A change is refused if there is a limit, it grows and the sum would pass the limit; usage never
    falls below zero.
    """

    def step(state: list[int], delta: int) -> tuple:
        ok = not (limit > 0 and delta > 0 and state[0] + delta > limit)
        if ok:
            state[0] = max(state[0] + delta, 0)
        return ok, state[0]

    return fold(log, scope, ["seq"], ["delta"], lambda: [0], step, "accepted boolean, used long").select(scope, "seq", "delta", "accepted", "used")


def statfs(bytes_limit: Column, inodes_limit: Column, bytes_used: Column, inodes_used: Column) -> list[Column]:
    total = F.when(bytes_limit == 0, F.lit(NO_BYTES_LIMIT)).otherwise(bytes_limit)
    files = F.when(inodes_limit == 0, F.lit(NO_INODES_LIMIT)).otherwise(inodes_limit)
    zero = F.lit(0).cast("long")
    return [
        total.alias("total_bytes"), F.greatest(zero, total - bytes_used).alias("free_bytes"),
        files.alias("total_inodes"), F.greatest(zero, files - inodes_used).alias("free_inodes"),
    ]


def human_bytes(n: Column, units: tuple[str, ...] = ("KiB", "MiB", "GiB", "TiB")) -> Column:
    """1024-based with one decimal from KiB on; the last unit takes all that is larger."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(units, 1):
        tenths = F.floor(n * 10 / F.lit(float(1024**power))).cast("long")
        text = F.concat((tenths.cast("double") / 10).cast("decimal(20,1)").cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= 1024**power, text).otherwise(out)
    return out


def roll_up(charged: DataFrame) -> DataFrame:
    """Bytes and files under each ancestor, from (ancestor, size)."""
    return charged.groupBy("ancestor").agg(F.sum("size").alias("bytes_used"), F.count(F.lit(1)).alias("inodes_used"))


def reservations(log: DataFrame) -> DataFrame:
    """Specified: per scope, what is used and what is reserved: a holder's last step there was to reserve, settle or release."""
    last = log.groupBy("scope", "holder").agg(F.max_by(F.struct("op", "amount"), F.struct("at", "seq")).alias("l"))
    total = lambda op: F.coalesce(F.sum(F.when(F.col("l.op") == op, F.col("l.amount"))), F.lit(0).cast("long"))
    return last.groupBy("scope").agg(total("settle").alias("used"), total("reserve").alias("reserved"))
