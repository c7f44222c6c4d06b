"""Leases, versions, invalidation and recall, replayed from a log (at, seq, holder, op, object)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnstore.operators.gc import HOUR, SECOND

#: Lease in microseconds, whether mutations recall, the kernel's time to live.
CLASSES = (("relaxed", 30 * SECOND, False, 30 * SECOND), ("session", 5 * SECOND, False, 5 * SECOND), ("posix", HOUR, True, 0), ("immutable", 0, False, 60 * SECOND))
MAX_SUBSCRIBERS = 64
RECALL_DEADLINE = 2 * SECOND
NEGATIVE_CAP = 5 * SECOND
BUMPS = ("commit", "create", "unlink")


def _until(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def versions(log: DataFrame) -> DataFrame:
    """Adds version: how many mutations of the object there have been, this one included."""
    return log.withColumn("version", F.sum(F.col("op").isin(*BUMPS).cast("long")).over(_until("object")))


def trusted(log: DataFrame, lease: int) -> DataFrame:
    """Lookups with the version granted last to the holder, and whether the lease still held (at expiry: yes)."""
    seen = versions(log)
    grant = F.last_value(F.when(F.col("op") == "grant", F.struct("at", "version")), True).over(_until("holder", "object"))
    found = seen.withColumn("_grant", grant).where("op = 'lookup'")
    held = F.col("_grant").isNotNull() & (F.col("at") <= F.col("_grant.at") + lease)
    return found.select("seq", "holder", "object", "version", F.when(held, F.col("_grant.version")).alias("granted"), F.coalesce(held, F.lit(False)).alias("trusted"))


def negative_trusted(log: DataFrame, lease: int, buckets: int) -> DataFrame:
    """Lookups that a cached miss may answer: granted by an earlier miss, no change of the directory since, not expired."""
    folder = F.pmod(F.col("object"), F.lit(buckets))
    seen = log.withColumn("dir", folder).withColumn("dirver", F.sum(F.col("op").isin(*BUMPS).cast("long")).over(_until("dir")))
    before = Window.partitionBy("holder", "object").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    miss = F.last_value(F.when(F.col("op") == "lookup", F.struct("at", "dirver")), True).over(before)
    found = seen.withColumn("_miss", miss).where("op = 'lookup'")
    held = F.col("_miss").isNotNull() & (F.col("_miss.dirver") == F.col("dirver")) & (F.col("at") <= F.col("_miss.at") + lease)
    return found.select("seq", "holder", "object", F.coalesce(held, F.lit(False)).alias("trusted"))


def subscribers(log: DataFrame, most: int = MAX_SUBSCRIBERS) -> DataFrame:
    """Per object: holders accepted, in the order in which they first came, and refused."""
    first = log.groupBy("object", "holder").agg(F.min(F.struct("at", "seq")).alias("first"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("object").orderBy("first")))
    return ranked.groupBy("object").agg(F.count_if(F.col("rank") <= most).alias("accepted"), F.count_if(F.col("rank") > most).alias("refused"))


def recalls(log: DataFrame, lease: int, deadline: int) -> DataFrame:
    """Per mutation: holders whose lease it revokes (not its own), those that acknowledge in time and those that don't.

    An acknowledgement is the holder's next lookup of the object; a late one counts for nothing.

    No mutation meets a grant in a join.  A holder's leases, and the times from which a lookup of its would be in
    time, are intervals; sums over their ends say at each moment whether it holds a lease and would answer.
    The changes of that, summed over an object's holders, give the counts at a mutation, less its own holder's.
    """
    at, none = F.col("at"), F.lit(0)

    def ends(of: DataFrame, first: Column, after: Column, held: int, heard: int) -> DataFrame:
        one = lambda t, sign: F.struct(t.alias("t"), F.lit(sign * held).alias("held"), F.lit(sign * heard).alias("heard"))
        return of.select("object", "holder", F.inline(F.array(one(first, 1), one(after, -1)))).withColumn("m_seq", F.lit(None).cast("long"))

    told = log.where(F.col("op").isin(*BUMPS)).select("object", "holder", at.alias("t"), none.alias("held"), none.alias("heard"), F.col("seq").alias("m_seq"))
    every = ends(log.where("op = 'grant'"), at, at + lease + 1, 1, 0).unionByName(ends(log.where("op = 'lookup'"), at - deadline, at, 0, 1)).unionByName(told)
    moment = [F.col("t"), F.col("m_seq").isNotNull()]
    own = Window.partitionBy("object", "holder").orderBy(*moment)
    sums = every.withColumn("_a", F.sum("held").over(own) > 0).withColumn("_b", F.col("_a") & (F.sum("heard").over(own) > 0))
    for c in ("_a", "_b"):
        sums = sums.withColumn(c, F.col(c).cast("int"))
    changed = sums.withColumns({f"d{c}": F.col(c) - F.coalesce(F.lag(c).over(own), none) for c in ("_a", "_b")})
    whole = Window.partitionBy("object").orderBy(*moment)
    counted = changed.where("m_seq IS NOT NULL OR d_a <> 0 OR d_b <> 0").withColumns({"_held": F.sum("d_a").over(whole) - F.col("_a"), "_acked": F.sum("d_b").over(whole) - F.col("_b")})
    return counted.where("m_seq IS NOT NULL AND _held > 0").select("m_seq", F.col("_acked").alias("acked"), (F.col("_held") - F.col("_acked")).alias("timed_out"))


def fan_out(log: DataFrame, buckets: int) -> DataFrame:
    """The objects that each mutation bumps: the inode, the directory's version, object and inode."""
    folder = F.pmod(F.col("object"), F.lit(buckets)).cast("string")
    each = F.array(
        F.concat(F.lit("inode:"), F.col("object").cast("string")), F.concat(F.lit("dirver:"), folder), F.concat(F.lit("dir:"), folder), F.concat(F.lit("inode-of-dir:"), folder)
    )
    return log.where(F.col("op").isin(*BUMPS)).select("seq", F.explode(each).alias("bumped"))


def guarded(log: DataFrame, latency: int) -> DataFrame:
    """Lookups whose answer may be cached: no mutation of the object between request and response.

    The next mutation after each request is carried back over the object's log: no join.
    """
    after = Window.partitionBy("object").orderBy(F.col("at").desc(), F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last_value(F.when(F.col("op").isin(*BUMPS), F.col("at")), True).over(after)
    found = log.withColumn("_next", following).where("op = 'lookup'")
    return found.select("seq", "object", (F.col("_next").isNull() | (F.col("_next") > F.col("at") + latency)).alias("cached"))


def staleness(log: DataFrame, lease: int) -> DataFrame:
    """Per holder: trusted reads, those that were stale, and the worst lag in versions."""
    reads = trusted(log, lease).where("trusted")
    return reads.groupBy("holder").agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("granted") < F.col("version")).alias("stale"), F.max(F.col("version") - F.col("granted")).alias("worst"))


def not_monotonic(log: DataFrame) -> DataFrame:
    """Reads that saw an older version than an earlier read of the session; a correct log gives none."""
    seen = versions(log).where("op = 'lookup'")
    before = F.lag("version").over(Window.partitionBy("holder", "object").orderBy("at", "seq"))
    return seen.withColumn("before", before).where("version < before").select("seq", "holder", "object", "version", "before")


def revalidate(log: DataFrame, buckets: int) -> DataFrame:
    """Specified: per holder and directory, the directory's version and the holder's inodes seen at an older version than now.

    An object's versions and sightings are counted before any join; directories are sums over objects.
    """
    seen = versions(log)
    now = seen.groupBy("object").agg(F.max("version").alias("version")).withColumn("dir", F.pmod("object", F.lit(buckets)))
    folders = now.groupBy("dir").agg(F.sum("version").alias("dirver"))
    held = seen.where("op = 'lookup'").groupBy("holder", "object").agg(F.max("version").alias("seen")).join(now, "object")
    stale = F.array_sort(F.collect_list(F.when(F.col("seen") < F.col("version"), F.col("object"))))
    return held.groupBy("holder", "dir").agg(stale.alias("stale")).join(folders, "dir").select("holder", "dir", "dirver", "stale")


def class_parameters(spark) -> DataFrame:
    return spark.createDataFrame(CLASSES, "class string, lease long, recall boolean, kernel_ttl long")


def negative_lease(lease: Column) -> Column:
    """Specified, not in the reference's code: a negative lease is capped."""
    return F.least(lease, F.lit(NEGATIVE_CAP))


def _bound_before(log: DataFrame) -> DataFrame:
    """Adds _bound: the seq that created the object, if its last create or unlink so far was a create."""
    last = F.last_value(F.when(F.col("op").isin("create", "unlink"), F.struct("op", "seq")), True).over(_until("object"))
    return log.withColumn("_last", last).withColumn("_bound", F.when(F.col("_last.op") == "create", F.col("_last.seq"))).drop("_last")


def uncached_lookups(log: DataFrame) -> DataFrame:
    """What each lookup finds at the authority, past any cache: the inode (its create's seq), or nothing."""
    return _bound_before(log).where("op = 'lookup'").select("seq", "holder", "object", F.col("_bound").alias("inode"))


def leased_lookups(log: DataFrame, buckets: int) -> DataFrame:
    """The leases that each lookup at the authority grants: the directory's in any case, before it is known whether
    the name is there; then the inode's on a hit, or a negative on a miss.  One row a grant.
    """
    folder = F.concat(F.lit("dir:"), F.pmod(F.col("object"), F.lit(buckets)).cast("string"))
    found = F.when(F.col("_bound").isNotNull(), F.concat(F.lit("inode:"), F.col("_bound").cast("string"))).otherwise(F.concat(F.lit("negative:"), F.col("object").cast("string")))
    grants = F.posexplode(F.array(folder, found)).alias("place", "granted")
    return _bound_before(log).where("op = 'lookup'").select("seq", "holder", grants)


def own_invalidations(log: DataFrame, buckets: int) -> DataFrame:
    """What a holder drops from its own cache after a mutation of its own: all that it holds of the directory."""
    folder = F.pmod(F.col("object"), F.lit(buckets)).cast("string")
    each = F.array(*[F.concat(F.lit(f"{kind}:"), folder) for kind in ("record", "dentries", "negatives", "inode-of-dir")])
    return log.where(F.col("op").isin(*BUMPS)).select("seq", "holder", F.explode(each).alias("dropped"))


def event_buffers(log: DataFrame, slots: int = MAX_SUBSCRIBERS, most: int = MAX_SUBSCRIBERS) -> DataFrame:
    """Per holder: events pushed to its stream, delivered, and dropped because ``slots`` were waiting.

    The first ``most`` holders of an object subscribe to it; each change of it by another is pushed to them.
    A holder's next lookup of anything empties its buffer, as a reconnect does.
    """
    first = log.groupBy("object", "holder").agg(F.min(F.struct("at", "seq")).alias("since"))
    subscribed = first.withColumn("_rank", F.row_number().over(Window.partitionBy("object").orderBy("since"))).where(F.col("_rank") <= most).drop("_rank")
    changes = log.where(F.col("op").isin(*BUMPS)).select("object", "at", "seq", F.col("holder").alias("by"))
    # At most ``most`` rows a change, so the fan-out is bounded.
    pushed = changes.join(subscribed, "object").where("holder <> by AND struct(at, seq) > since").select("holder", "at", "seq", F.lit(0).alias("drain"))
    both = pushed.unionByName(log.where("op = 'lookup'").select("holder", "at", "seq", F.lit(1).alias("drain")))
    epoch = F.sum("drain").over(Window.partitionBy("holder").orderBy("at", "seq", "drain").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    waiting = both.withColumn("_epoch", epoch).where("drain = 0").groupBy("holder", "_epoch").agg(F.count(F.lit(1)).alias("n"))
    kept = F.least(F.col("n"), F.lit(slots))
    return waiting.groupBy("holder").agg(F.sum("n").alias("pushed"), F.sum(kept).alias("delivered"), F.sum(F.col("n") - kept).alias("dropped"))


def flushes(log: DataFrame) -> DataFrame:
    """What each flush (seq) of a handle commits: its writes since the last flush as one unit, or nothing if there are none.

    The log has open, write, flush and unlink, the last on the object by whomever; a buffer whose name was
    unlinked after the handle was opened is committed without a name.
    """
    own = Window.partitionBy("holder", "object").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = F.last_value(F.when(F.col("op") == "unlink", F.struct("at", "seq")), True).over(_until("object"))
    seen = log.withColumn("_gone", gone)
    opened = F.last_value(F.when(F.col("op") == "open", F.struct("at", "seq")), True).over(own)
    writes = F.sum((F.col("op") == "write").cast("long")).over(own)
    seen = seen.withColumns({"_opened": opened, "_writes": writes}).where("op = 'flush'")
    before = F.coalesce(F.lag("_writes").over(Window.partitionBy("holder", "object").orderBy("at", "seq")), F.lit(0))
    seen = seen.withColumn("writes", F.col("_writes") - before)
    lost = F.col("_gone").isNotNull() & (F.col("_opened").isNull() | (F.col("_gone") > F.col("_opened")))
    return seen.select("seq", "holder", "object", "writes", F.when(F.col("writes") == 0, "clean").when(lost, "detached").otherwise("commit").alias("how"))


def invariants(log: DataFrame, lease: int) -> DataFrame:
    """Specified: the coherence model's invariants over a trace: what was checked and what violates them.

    A trusted read saw a version that was the authority's at some time since its grant; no lease is trusted
    past its expiry; versions of an object only grow; of two reads in one session the later sees no older version.
    """
    seen = versions(log)
    grant = F.last_value(F.when(F.col("op") == "grant", F.struct("at", "version")), True).over(_until("holder", "object"))
    reads = seen.withColumn("_g", grant).where("op = 'lookup'").where(F.col("_g").isNotNull() & (F.col("at") <= F.col("_g.at") + lease))
    step = F.lag("version").over(Window.partitionBy("object").orderBy("at", "seq"))
    session = F.lag(F.col("_g.version")).over(Window.partitionBy("holder", "object").orderBy("at", "seq"))
    name = lambda df, n, bad: df.agg(F.lit(n).alias("invariant"), F.count(F.lit(1)).alias("checked"), F.count_if(bad).alias("violations"))
    found = name(reads, "granted version was current", F.col("_g.version") > F.col("version"))
    found = found.unionByName(name(reads, "trusted within the lease", F.col("at") > F.col("_g.at") + lease))
    found = found.unionByName(name(seen.withColumn("_p", step), "versions only grow", F.col("version") < F.col("_p")))
    return found.unionByName(name(reads.withColumn("_p", session), "sessions are monotonic", F.col("_g.version") < F.col("_p")))


def observed(log: DataFrame, lease: int, slots: int = MAX_SUBSCRIBERS) -> DataFrame:
    """Specified: what operators watch: the cache's hit ratio, the staleness of trusted reads in versions, the share of pushes that land."""
    found = trusted(log, lease)
    lag = F.when(F.col("trusted"), F.col("version") - F.col("granted"))
    one = lambda df, n, v: df.agg(F.lit(n).alias("metric"), F.round(v, 6).alias("value"))
    out = one(found, "cache_hit_ratio", F.avg(F.col("trusted").cast("double")))
    for q in (0.5, 0.99):
        out = out.unionByName(one(found, f"staleness_versions_p{int(q * 100)}", F.percentile(lag, q)))
    pushes = event_buffers(log, slots)
    return out.unionByName(one(pushes, "invalidation_delivery_ratio", F.sum("delivered") / F.sum("pushed")))
