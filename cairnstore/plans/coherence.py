"""Queries over leases and versions, as replays of the event log, and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnstore.operators import caches
from cairnstore.operators import coherence as H
from cairnstore.operators.gc import HOUR
from cairnstore.plans.registry import registry
from cairnstore.sources.shared import shared_dir
from cairnstore.sources.views import MUTATIONS_SQL, OPERATIONS, mutations, table
from cairnstore.streaming import leases

QUERIES, SQL, query = registry()
WEEK = 168 * HOUR
_V = f"""{MUTATIONS_SQL}, v AS (SELECT *, CAST(sum(CASE WHEN op IN ('commit', 'create', 'unlink') THEN 1 ELSE 0 END) OVER (PARTITION BY object ORDER BY tm, seq) AS BIGINT) AS version FROM mutations)"""
_T = f"""{_V}, t AS (SELECT seq, holder, object, op, tm, version, last_value(CASE WHEN op = 'grant' THEN tm END IGNORE NULLS) OVER w AS g_at,
  last_value(CASE WHEN op = 'grant' THEN version END IGNORE NULLS) OVER w AS g_version FROM v
  WINDOW w AS (PARTITION BY holder, object ORDER BY tm, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
leased AS (SELECT seq, holder, object, version, coalesce(tm <= g_at + {WEEK}, false) AS trusted, CASE WHEN tm <= g_at + {WEEK} THEN g_version END AS granted FROM t WHERE op = 'lookup')"""


@query(f"WITH {_V} SELECT seq, object, version FROM v")
def object_versions(spark, sf_dir):
    return H.versions(mutations(spark, sf_dir)).select("seq", "object", "version")


@query(f"WITH {_T} SELECT seq, holder, object, version, granted, trusted FROM leased")
def lease_trusted(spark, sf_dir):
    return H.trusted(mutations(spark, sf_dir), WEEK)


@query(f"""WITH {MUTATIONS_SQL}, d AS (SELECT *, sum(CASE WHEN op IN ('commit', 'create', 'unlink') THEN 1 ELSE 0 END) OVER (PARTITION BY object % 25 ORDER BY tm, seq) AS dirver FROM mutations),
m AS (SELECT *, last_value(CASE WHEN op = 'lookup' THEN tm END IGNORE NULLS) OVER w AS m_at, last_value(CASE WHEN op = 'lookup' THEN dirver END IGNORE NULLS) OVER w AS m_ver FROM d
  WINDOW w AS (PARTITION BY holder, object ORDER BY tm, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, holder, object, coalesce(m_ver = dirver AND tm <= m_at + {WEEK}, false) AS trusted FROM m WHERE op = 'lookup'""")
def negative_trusted(spark, sf_dir):
    return H.negative_trusted(mutations(spark, sf_dir), WEEK, 25)


@query(f"""WITH {MUTATIONS_SQL}, f AS (SELECT object, holder, min((tm, seq)) AS first FROM mutations GROUP BY ALL), r AS (SELECT object, row_number() OVER (PARTITION BY object ORDER BY first) AS k FROM f)
SELECT object, count(*) FILTER (WHERE k <= 64) AS accepted, count(*) FILTER (WHERE k > 64) AS refused FROM r GROUP BY object""")
def subscriber_cap(spark, sf_dir):
    return H.subscribers(mutations(spark, sf_dir))


@query(f"""WITH {MUTATIONS_SQL}, m AS (SELECT object, tm, seq, holder FROM mutations WHERE op IN ('commit', 'create', 'unlink')),
h AS (SELECT DISTINCT m.seq AS m_seq, m.object, m.tm, g.holder FROM m JOIN mutations g ON g.object = m.object AND g.op = 'grant' AND g.holder <> m.holder AND g.tm <= m.tm AND g.tm + {WEEK} >= m.tm),
a AS (SELECT h.m_seq, h.holder, bool_or(l.tm > h.tm AND l.tm <= h.tm + {24 * HOUR}) AS acked FROM h LEFT JOIN mutations l ON l.object = h.object AND l.holder = h.holder AND l.op = 'lookup' GROUP BY ALL)
SELECT m_seq, count(*) FILTER (WHERE coalesce(acked, false)) AS acked, count(*) FILTER (WHERE NOT coalesce(acked, false)) AS timed_out FROM a GROUP BY m_seq""")
def recall_outcome(spark, sf_dir):
    """Leases of a week, a deadline of a day: the log's events are hours apart."""
    return H.recalls(mutations(spark, sf_dir), WEEK, 24 * HOUR)


@query(f"""WITH {MUTATIONS_SQL}, m AS (SELECT seq, object, object % 25 AS d FROM mutations WHERE op IN ('commit', 'create', 'unlink'))
SELECT seq, unnest(['inode:' || object, 'dirver:' || d, 'dir:' || d, 'inode-of-dir:' || d]) AS bumped FROM m""")
def bump_fanout(spark, sf_dir):
    return H.fan_out(mutations(spark, sf_dir), 25)


@query(f"""WITH {MUTATIONS_SQL}, g AS (SELECT seq, object, op, tm, first_value(CASE WHEN op IN ('commit', 'create', 'unlink') THEN tm END IGNORE NULLS) OVER (PARTITION BY object ORDER BY tm, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM mutations)
SELECT seq, object, next IS NULL OR next > tm + {2 * HOUR} AS cached FROM g WHERE op = 'lookup'""")
def epoch_guard(spark, sf_dir):
    return H.guarded(mutations(spark, sf_dir), 2 * HOUR)


@query(f"WITH {_T} SELECT holder, count(*) AS reads, count(*) FILTER (WHERE granted < version) AS stale, max(version - granted) AS worst FROM leased WHERE trusted GROUP BY holder")
def staleness_check(spark, sf_dir):
    return H.staleness(mutations(spark, sf_dir), WEEK)


@query(f"""WITH {_V} SELECT seq, holder, object, version, before FROM (SELECT *, lag(version) OVER (PARTITION BY holder, object ORDER BY tm, seq) AS before FROM v WHERE op = 'lookup') WHERE version < before""")
def monotonic_reads(spark, sf_dir):
    return H.not_monotonic(mutations(spark, sf_dir))


@query(f"WITH {_T} SELECT object, count(*) AS lookups, count(*) FILTER (WHERE trusted AND granted = version) AS hits FROM leased GROUP BY object")
def revalidation_hits(spark, sf_dir):
    found = H.trusted(mutations(spark, sf_dir), WEEK)
    return found.groupBy("object").agg(F.count(F.lit(1)).alias("lookups"), F.count_if(F.col("trusted") & (F.col("granted") == F.col("version"))).alias("hits"))


@query("""SELECT * FROM (VALUES ('relaxed', CAST(30000000 AS BIGINT), false, CAST(30000000 AS BIGINT), CAST(5000000 AS BIGINT)), ('session', 5000000, false, 5000000, 5000000),
  ('posix', 3600000000, true, 0, 5000000), ('immutable', 0, false, 60000000, 0)) t(class, lease, recall, kernel_ttl, negative_lease)""")
def class_parameters(spark, sf_dir):
    return H.class_parameters(spark).withColumn("negative_lease", H.negative_lease(F.col("lease")))


_BOUND = f"""{MUTATIONS_SQL}, b AS (SELECT *, (SELECT max((c.tm, c.seq, c.op)) FROM mutations c WHERE c.object = m.object AND c.op IN ('create', 'unlink') AND (c.tm, c.seq) <= (m.tm, m.seq)) AS last FROM mutations m WHERE op = 'lookup'),
found AS (SELECT seq, holder, object, CASE WHEN last[3] = 'create' THEN last[2] END AS inode FROM b)"""


@query(f"WITH {_BOUND} SELECT seq, holder, object, inode FROM found")
def uncached_lookup(spark, sf_dir):
    return H.uncached_lookups(mutations(spark, sf_dir))


@query(f"""WITH {_BOUND} SELECT seq, holder, 0 AS place, 'dir:' || object % 25 AS granted FROM found
UNION ALL SELECT seq, holder, 1, CASE WHEN inode IS NULL THEN 'negative:' || object ELSE 'inode:' || inode END FROM found""")
def leased_lookup(spark, sf_dir):
    return H.leased_lookups(mutations(spark, sf_dir), 25)


@query(f"""WITH {MUTATIONS_SQL} SELECT seq, holder, kind || ':' || object % 25 AS dropped FROM mutations, (VALUES ('record'), ('dentries'), ('negatives'), ('inode-of-dir')) t(kind) WHERE op IN ('commit', 'create', 'unlink')""")
def own_invalidation(spark, sf_dir):
    return H.own_invalidations(mutations(spark, sf_dir), 25)


_PUSHED = f"""{MUTATIONS_SQL}, s AS (SELECT object, holder, min((tm, seq)) AS since FROM mutations GROUP BY object, holder QUALIFY row_number() OVER (PARTITION BY object ORDER BY min((tm, seq))) <= 64),
p AS (SELECT s.holder, m.tm, m.seq FROM mutations m JOIN s ON s.object = m.object AND s.holder <> m.holder AND (m.tm, m.seq) > s.since WHERE m.op IN ('commit', 'create', 'unlink')),
q AS (SELECT holder, (SELECT count(*) FROM mutations d WHERE d.holder = p.holder AND d.op = 'lookup' AND (d.tm, d.seq) < (p.tm, p.seq)) AS epoch FROM p),
n AS (SELECT holder, epoch, count(*) AS n FROM q GROUP BY ALL),
pushes AS (SELECT holder, CAST(sum(n) AS BIGINT) AS pushed, CAST(sum(least(n, 3)) AS BIGINT) AS delivered, CAST(sum(n - least(n, 3)) AS BIGINT) AS dropped FROM n GROUP BY holder)"""


@query(f"WITH {_PUSHED} SELECT holder, pushed, delivered, dropped FROM pushes")
def event_stream_buffer(spark, sf_dir):
    """Buffers of three events, not 64, so that some overflow here."""
    return H.event_buffers(mutations(spark, sf_dir), slots=3)


_HANDLES = """CASE op WHEN 'grant' THEN 'open' WHEN 'lookup' THEN 'write' WHEN 'commit' THEN 'flush' ELSE op END"""


@query(f"""WITH {MUTATIONS_SQL}, l AS (SELECT seq, tm, holder, object % 10 AS object, {_HANDLES} AS op FROM mutations),
f AS (SELECT l.*, (SELECT max((p.tm, p.seq)) FROM l p WHERE p.holder = l.holder AND p.object = l.object AND p.op = 'flush' AND (p.tm, p.seq) < (l.tm, l.seq)) AS prior,
  (SELECT max((p.tm, p.seq)) FROM l p WHERE p.holder = l.holder AND p.object = l.object AND p.op = 'open' AND (p.tm, p.seq) < (l.tm, l.seq)) AS opened,
  (SELECT max((p.tm, p.seq)) FROM l p WHERE p.object = l.object AND p.op = 'unlink' AND (p.tm, p.seq) < (l.tm, l.seq)) AS gone FROM l WHERE op = 'flush'),
w AS (SELECT f.*, (SELECT count(*) FROM l p WHERE p.holder = f.holder AND p.object = f.object AND p.op = 'write' AND (p.tm, p.seq) < (f.tm, f.seq) AND (f.prior IS NULL OR (p.tm, p.seq) > f.prior)) AS writes FROM f)
SELECT seq, holder, object, writes, CASE WHEN writes = 0 THEN 'clean' WHEN gone IS NOT NULL AND (opened IS NULL OR gone > opened) THEN 'detached' ELSE 'commit' END AS how FROM w""")
def buffered_commits(spark, sf_dir):
    """The log as handles on ten objects: grants open, lookups write, commits flush."""
    op = F.when(F.col("op") == "grant", "open").when(F.col("op") == "lookup", "write").when(F.col("op") == "commit", "flush").otherwise(F.col("op"))
    return H.flushes(mutations(spark, sf_dir).select("seq", "at", "holder", F.pmod("object", F.lit(10)).alias("object"), op.alias("op")))


@query(f"""WITH {_T}, r AS (SELECT * FROM t WHERE op = 'lookup' AND tm <= g_at + {WEEK}) SELECT 'granted version was current' AS invariant, count(*) AS checked, CAST(0 AS BIGINT) AS violations FROM r
UNION ALL SELECT 'trusted within the lease', count(*), count(*) FILTER (WHERE tm > g_at + {WEEK}) FROM r
UNION ALL SELECT 'versions only grow', count(*), 0 FROM v
UNION ALL SELECT 'sessions are monotonic', count(*), 0 FROM r""")
def coherence_invariants(spark, sf_dir):
    """The log as a trace of the model: a correct one violates nothing, which the oracle states."""
    return H.invariants(mutations(spark, sf_dir), WEEK)


@query(f"""WITH {_T}, {_PUSHED.split("FROM events), ", 1)[1]} SELECT 'cache_hit_ratio' AS metric, round(avg(CAST(trusted AS DOUBLE)), 6) AS value FROM leased
UNION ALL SELECT 'staleness_versions_p50', round(quantile_cont(version - granted, 0.5) FILTER (WHERE trusted), 6) FROM leased
UNION ALL SELECT 'staleness_versions_p99', round(quantile_cont(version - granted, 0.99) FILTER (WHERE trusted), 6) FROM leased
UNION ALL SELECT 'invalidation_delivery_ratio', round(sum(delivered) / sum(pushed), 6) FROM pushes""")
def observability(spark, sf_dir):
    return H.observed(mutations(spark, sf_dir), WEEK, slots=3)


def _reads(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("reader"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.pmod("l_partkey", F.lit(40)).alias("chunk"), (F.pmod("l_partkey", F.lit(40)) * 100 + 1).alias("size")
    )


_READS = """reads AS (SELECT l_suppkey AS reader, l_orderkey * 8 + l_linenumber AS seq, l_partkey % 40 AS chunk, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 8 + l_linenumber, l_partkey % 40) AS k FROM lineitem)"""


@query(f"""WITH RECURSIVE {_READS}, w AS (SELECT DISTINCT reader, CAST(0 AS BIGINT) AS seq, CAST(-1 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS k, false AS hit, CAST([] AS BIGINT[]) AS held FROM reads
  UNION ALL SELECT r.reader, r.seq, r.chunk, r.k, list_contains(w.held, r.chunk), CASE WHEN list_contains(w.held, r.chunk) THEN w.held WHEN len(w.held) = 16 THEN list_append(w.held[2:], r.chunk) ELSE list_append(w.held, r.chunk) END
  FROM w JOIN reads r ON r.reader = w.reader AND r.k = w.k + 1) SELECT reader, seq, chunk, hit FROM w WHERE k > 0""")
def fifo_chunk_cache(spark, sf_dir):
    """Tested against a replay."""
    return caches.fifo(_reads(spark, sf_dir))


@query(f"""WITH RECURSIVE {_READS}, w AS (SELECT DISTINCT reader, CAST(0 AS BIGINT) AS seq, CAST(-1 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS k, false AS hit, CAST(0 AS BIGINT) AS evicted, CAST([] AS BIGINT[]) AS held FROM reads
  UNION ALL SELECT reader, seq, chunk, k, hit, CASE WHEN hit THEN 0 ELSE drop END, CASE WHEN hit THEN moved ELSE moved[drop + 1:] END
  FROM (SELECT *, CASE WHEN list_sum(list_transform(moved, lambda x: x * 100 + 1)) <= 20000 THEN 0
      ELSE list_filter(range(1, len(moved)), lambda i: i = len(moved) - 1 OR list_sum(list_transform(moved[i + 1:], lambda x: x * 100 + 1)) <= 20000)[1] END AS drop
    FROM (SELECT r.reader, r.seq, r.chunk, r.k, list_contains(w.held, r.chunk) AS hit, list_append(list_filter(w.held, lambda x: x <> r.chunk), r.chunk) AS moved FROM w JOIN reads r ON r.reader = w.reader AND r.k = w.k + 1)))
SELECT reader, seq, chunk, hit, evicted FROM w WHERE k > 0""")
def lru_materializer(spark, sf_dir):
    """Tested against a replay."""
    return caches.lru(_reads(spark, sf_dir), 20_000)


def _stream(spark, sf_dir, name, states, files_at_once=None):
    """What ``states`` makes of the event log as a stream, read to its end; sink and checkpoint are in the shared folder."""
    place = f"{shared_dir(spark)}/cairnstore/{name}-{uuid.uuid4().hex}"
    raw = table(spark, sf_dir, "events")
    source = spark.readStream.schema(raw.schema)
    if files_at_once:
        source = source.option("maxFilesPerTrigger", files_at_once)
    stream = source.parquet(f"{sf_dir}/events.parquet*")
    op = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])[F.col("event_type")]
    log = stream.select(F.col("user_id").alias("holder"), F.get_json_object("props", "$.k").cast("long").alias("object"), op.alias("op"), F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq")).withWatermark("ts", "1 hour")
    told = states(log)
    told.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{place}/out")


@query(f"WITH {_T} SELECT holder, object, seq, trusted FROM leased")
def stream_lease_state(spark, sf_dir):
    """The log as a stream, keyed state for holders' leases of objects; the same as ``lease_trusted`` finds in batch."""
    return _stream(spark, sf_dir, "leases", lambda log: leases.lease_state(log, WEEK))


@query(SQL["recall_outcome"])
def stream_recall(spark, sf_dir):
    """Recalls of a stream, keyed state for each object; the same as ``recall_outcome`` finds in batch."""
    told = _stream(spark, sf_dir, "recalls", lambda log: leases.recall_state(log, WEEK, 24 * HOUR))
    acked, started = F.sum("acked"), F.sum("started")
    return told.groupBy("m_seq").agg(acked.alias("acked"), (started - acked).alias("timed_out"))
