"""Exhaustive search of a small model, level by level, without states on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnstore.sources.shared import shared_dir

#: How a state of the rehoming model is written.  Region 0 is the first home, 1 the other; ``homes``
#: has the region committed at epoch e in bit e - 1; ``accepted`` has a bit for each recorded write.
REHOMING = "epoch int, home int, sealing boolean, drained boolean, copied boolean, homes int, accepted long"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the session's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def reachable(start: DataFrame, successors: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame] = checkpointed, most: int = 1000) -> DataFrame:
    """All states that ``successors`` reaches from ``start``; ``keep`` cuts the lineage of a level."""
    every = frontier = keep(start.distinct())
    for _ in range(most):
        frontier = keep(successors(frontier).distinct().join(every, start.columns, "left_anti"))
        if frontier.isEmpty():
            return every
        every = keep(every.unionByName(frontier))
    raise RuntimeError(f"more than {most} levels")


def _write_bit(client: int, clients: int, region: int):
    """The place of a write's record: its epoch, client, region and whether the map was sealing."""
    return ((F.col("epoch") - 1) * clients + client) * 4 + region * 2 + F.col("sealing").cast("int")


def rehoming_steps(clients: int, max_epoch: int) -> Callable[[DataFrame], DataFrame]:
    """The transitions: seal, drain, copy, commit the next epoch, and a client's write.

    A write carries any region; only one to the present home, while the map is active, is accepted.
    """
    if clients * max_epoch * 4 > 62:
        raise ValueError("the records of accepted writes must fit in a long")
    columns = [c.split()[0] for c in REHOMING.split(", ")]
    types = dict(c.split() for c in REHOMING.split(", "))

    def to(guard, **changed):
        values = [changed.get(c, F.col(c)) for c in columns]
        return F.when(guard, F.struct(*[v.cast(types[c]).alias(c) for c, v in zip(columns, values)]))

    sealing, drained, copied, yes, no = F.col("sealing"), F.col("drained"), F.col("copied"), F.lit(True), F.lit(False)
    other = 1 - F.col("home")
    steps = [
        to(~sealing & (F.col("epoch") < max_epoch), sealing=yes),
        to(sealing & ~drained, drained=yes),
        to(sealing & drained & ~copied, copied=yes),
        to(sealing & drained & copied, epoch=F.col("epoch") + 1, home=other, sealing=no, drained=no, copied=no, homes=F.col("homes").bitwiseOR(F.call_function("shiftleft", other, F.col("epoch")))),
    ]
    for client in range(clients):
        for region in (0, 1):
            record = F.call_function("shiftleft", F.lit(1).cast("long"), _write_bit(client, clients, region))
            steps.append(to(~sealing & (F.col("home") == region), accepted=F.col("accepted").bitwiseOR(record)))
    return lambda states: states.select(F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull())).alias("s")).select("s.*")


def rehoming_states(spark: SparkSession, clients: int = 2, max_epoch: int = 3) -> DataFrame:
    """Every state that rehoming a subtree can reach, with ``safe``.

    A state is safe if each accepted write went to the region that its epoch was committed with, and
    none was accepted while the map was sealing: no two regions accept writes of one epoch.
    """
    start = spark.createDataFrame([(1, 0, False, False, False, 0, 0)], REHOMING)
    found = reachable(start, rehoming_steps(clients, max_epoch))
    safe = F.lit(True)
    for epoch in range(1, max_epoch + 1):
        home = F.call_function("shiftright", F.col("homes"), F.lit(epoch - 1)).bitwiseAND(1)
        for client in range(clients):
            at = ((epoch - 1) * clients + client) * 4
            had = lambda bit: F.col("accepted").bitwiseAND(F.lit(1 << bit).cast("long")) != 0
            wrong = had(at + 1) | had(at + 3) | (had(at) & (home != 0)) | (had(at + 2) & (home != 1))
            safe = safe & ~wrong
    return found.withColumn("safe", safe)
