"""Streaming queries over replayed tables; each must give the rows of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlake.operators import metrics as M
from driftlake.plans.catalog import query
from driftlake.plans.inference import KEYS, KEYS_SQL, NODES_SQL, TRAFFIC, baseline
from driftlake.plans.registry import _DRIFT_SQL, _PAIRS_SQL, _correlated_sql, documents
from driftlake.plans.traffic import _DEDUP, _DEDUP_NORMALIZED, _KEPT, _ENVELOPE_SQL, _MASKED_SQL, _SECONDS, PAYLOAD, _rate_sql, _sketch_sql, grouped_alerts, payload_hashes, raw_records, samples
from driftlake.plans.views import view
from driftlake.session import materialize, scratch_folder
from driftlake.sources import record_dump as RD
from driftlake.sources.traffic import decode_envelope, header_map
from driftlake.streaming import alerts as SA
from driftlake.streaming import correlate as SC
from driftlake.streaming import dedup as SD
from driftlake.streaming import feeds
from driftlake.streaming import inference as SI
from driftlake.streaming import ingest as SG
from driftlake.streaming import late as SL
from driftlake.streaming import rates as SP
from driftlake.streaming import registry as SR
from driftlake.streaming.replay import as_stream, plain_times, run_to_table


@query("src_record_stream", _ENVELOPE_SQL)
def src_record_stream(spark, sf_dir):
    """A dump of a topic in four partitions, read as a stream of records and decoded with the consumer's fallbacks."""
    header = "transform(map_entries(map_concat(headers, map('event_id', CAST(event_id AS STRING)))), e -> struct(e.key AS key, encode(e.value, 'UTF-8') AS value))"
    records = raw_records(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), "key", "value", F.expr(header).alias("headers"))
    dump = scratch_folder(spark, "dump")
    RD.write_dump(records, dump, 4, ["timestamp", "event_id"])
    named = RD.stream_dump(spark, dump, recordsPerTask="50000").withColumn("headers", header_map(F.col("headers")))
    named = named.withColumn("event_id", F.col("headers")["event_id"].cast("bigint"))
    return run_to_table(decode_envelope(named, keep=["event_id"]), "record_stream")


@query("stream_dedup", _KEPT, TRAFFIC, _DEDUP)
def stream_dedup(spark, sf_dir):
    source = as_stream(payload_hashes(spark, sf_dir), "sampled_at")
    return plain_times(run_to_table(SD.dedup_stream(source), "stream_dedup"))


@query("stream_dedup_batches", _KEPT, TRAFFIC, _DEDUP_NORMALIZED)
def stream_dedup_batches(spark, sf_dir):
    source = as_stream(payload_hashes(spark, sf_dir, "normalized"), "sampled_at")
    out, state, checkpoint = (scratch_folder(spark, f"dedup-{n}") for n in ("out", "state", "checkpoint"))
    SD.dedup_batches(source, out, state, checkpoint).awaitTermination()
    return plain_times(spark.read.parquet(out).select("sample_id", "sampled_at", "content_hash"))


_AGENTS = """chain AS (SELECT service_id, min(sampled_at) AS t FROM traffic_samples GROUP BY ALL UNION ALL
    SELECT c.service_id, min(x.sampled_at) FROM chain c JOIN traffic_samples x
      ON x.service_id = c.service_id AND x.sampled_at >= c.t + INTERVAL 1 HOUR GROUP BY c.service_id, c.t),
  starts AS (SELECT service_id, t, lead(t) OVER (PARTITION BY service_id ORDER BY t) AS next FROM chain)"""
_RATE = """SELECT x.sample_id, x.service_id FROM traffic_samples x JOIN starts s ON x.service_id = s.service_id
      AND sampled_at >= s.t AND sampled_at < coalesce(s.next, TIMESTAMP '9999-01-01')
    QUALIFY row_number() OVER (PARTITION BY s.service_id, s.t ORDER BY sampled_at, sample_id) <= 1"""


@query("stream_rate_limit", _RATE, TRAFFIC, _AGENTS)
def stream_rate_limit(spark, sf_dir):
    source = as_stream(samples(spark, sf_dir).select("sample_id", "service_id", "sampled_at"), "sampled_at")
    kept = SD.rate_limit_stream(source, ["service_id"], cap=1, seconds=3600)
    return run_to_table(kept, "stream_rate_limit").select("sample_id", "service_id")


@query(
    "stream_infer_window",
    f"""SELECT * FROM (SELECT {KEYS_SQL}, time_bucket(INTERVAL 10 MINUTE, sampled_at) AS window_start, path, count(*) AS n,
          count(*) FILTER (json_type = 'string') AS n_string FROM nodes GROUP BY ALL)
        WHERE window_start + INTERVAL 20 MINUTE <= (SELECT date_trunc('millisecond', max(sampled_at)) FROM traffic_samples)""",
    TRAFFIC, NODES_SQL,
)
def stream_infer_window(spark, sf_dir):
    """Windows the watermark has passed by the end of the input."""
    source = as_stream(samples(spark, sf_dir).select(*KEYS, "sampled_at", "body"), "sampled_at")
    table = run_to_table(SI.windowed_stats(source), "stream_infer")
    return plain_times(table).select(*KEYS, "window_start", "path", "n", "n_string")


@query("stream_drift")
def stream_drift(spark, sf_dir):
    """Violations per micro-batch of the replayed traffic."""
    source = as_stream(samples(spark, sf_dir).select(*KEYS, "sampled_at", "body"), "sampled_at")
    out, bad, checkpoint = (scratch_folder(spark, f"drift-{n}") for n in ("out", "bad", "checkpoint"))
    # the contracts are read once, not with every micro-batch
    declared = materialize(baseline(spark, sf_dir), "drift-baseline")
    job = SI.detect_drift(source, declared, out, bad, checkpoint, trigger={"availableNow": True})
    job.awaitTermination()
    return spark.read.parquet(out)


@query("stream_registry_drift", _DRIFT_SQL, ("contracts",), _PAIRS_SQL)
def stream_registry_drift(spark, sf_dir):
    """Cycles over contracts that change in four batches: each is active when it comes, later ones take its place or archive it."""
    number = F.expr("CAST(substring(id, 5) AS BIGINT)")
    final = documents(spark, sf_dir).withColumn("changed_at", number + 1_000_000_000)
    early = final.where("id LIKE '%5'").withColumns({"status": F.lit("active"), "changed_at": number})
    source = as_stream(early.unionByName(final), "changed_at")
    folder, checkpoint = scratch_folder(spark, "registry"), scratch_folder(spark, "registry-checkpoint")
    job = SR.drift_cycles(source, folder, checkpoint, trigger={"availableNow": True})
    job.awaitTermination()
    return SR.current(spark, folder, job.lastProgress["batchId"], "violations").drop("description")


@query(
    "correlate_stream",
    """SELECT violation_id, severity, service_id, detected_at, deployed_at, deployment_id, version_sha FROM correlated
       WHERE detected_at + INTERVAL 10 MINUTE <= least(
         (SELECT date_trunc('millisecond', max(detected_at)) FROM violations), (SELECT date_trunc('millisecond', max(deployed_at)) FROM deployments))""",
    ("violations", "deployments"), _correlated_sql("ASC"),
)
def correlate_stream(spark, sf_dir):
    seen = view(spark, sf_dir, "violations").select("violation_id", "severity", "service_id", "detected_at")
    left = as_stream(seen, "detected_at")
    right = as_stream(view(spark, sf_dir, "deployments"), "deployed_at")
    return plain_times(run_to_table(SC.correlate_stream(left, right), "correlate_stream"))


@query(
    "stream_recent_violations",
    "SELECT * FROM violations ORDER BY detected_at DESC, violation_id DESC LIMIT 5",
    ("violations",),
)
def stream_recent(spark, sf_dir):
    source = as_stream(view(spark, sf_dir, "violations"), "detected_at")
    latest = []
    job = feeds.newest_feed(source, "detected_at", "violation_id", 5, latest.append, scratch_folder(spark, "feed-checkpoint"))
    job.awaitTermination()
    return plain_times(latest[-1])


@query(
    "stream_violation_rate",
    f"""SELECT * FROM ({_rate_sql("violations", "detected_at", "severity")})
        WHERE window_start + INTERVAL 15 MINUTE <= (SELECT date_trunc('millisecond', max(detected_at)) FROM violations)""",
    ("violations",),
)
def stream_violation_rate(spark, sf_dir):
    """The windows that the watermark has passed, summed from one-minute counts."""
    source = as_stream(view(spark, sf_dir, "violations").select("severity", "detected_at"), "detected_at")
    return plain_times(run_to_table(SP.rate_stream(source, "detected_at", ["severity"]), "violation_rate"))


@query(
    "stream_latency_sketch",
    _sketch_sql("""WHERE time_bucket(INTERVAL 1 MINUTE, sampled_at) + INTERVAL 11 MINUTE <= (SELECT date_trunc('millisecond', max(sampled_at)) FROM traffic_samples)"""),
    TRAFFIC,
)
def stream_latency_sketch(spark, sf_dir):
    """Quantiles merged from the sketches that a stream has completed."""
    source = as_stream(samples(spark, sf_dir).select("endpoint", "duration_ms", "sampled_at"), "sampled_at")
    return M.sketch_quantiles(plain_times(run_to_table(SP.pane_stream(source), "latency_panes")))


_INGESTED = f"""rows_in AS (SELECT sample_id, CASE WHEN sample_id % 10 = 0 THEN ' ' ELSE service_id END AS service_id, endpoint, method, sampled_at, {PAYLOAD} AS p FROM traffic_samples),
  hashed AS (SELECT *, sha256(p) AS content_hash FROM rows_in WHERE trim(service_id) <> ''),
  chain AS (SELECT content_hash, min(sampled_at) AS t FROM hashed GROUP BY ALL UNION ALL
    SELECT c.content_hash, min(h.sampled_at) FROM chain c JOIN hashed h
      ON h.content_hash = c.content_hash AND h.sampled_at >= c.t + INTERVAL 5 MINUTE GROUP BY c.content_hash, c.t)"""


@query(
    "stream_ingest",
    f"""SELECT sample_id, service_id, endpoint, method, {_MASKED_SQL} AS normalized_payload, h.content_hash, sampled_at AS ingested_at, false AS rejected
        FROM hashed h JOIN chain c ON h.content_hash = c.content_hash AND h.sampled_at = c.t
        UNION ALL SELECT sample_id, service_id, endpoint, method, NULL, NULL, sampled_at, true FROM rows_in WHERE trim(service_id) = ''""",
    TRAFFIC, _INGESTED,
)
def stream_ingest(spark, sf_dir):
    """Samples checked, hashed, cleared of repeats and stored by one query, which is stopped half-way and started again."""
    rows = samples(spark, sf_dir).withColumns({"body": F.expr(PAYLOAD), "service_id": F.expr("CASE WHEN sample_id % 10 = 0 THEN ' ' ELSE service_id END")})
    rows = rows.select("sample_id", "service_id", "endpoint", "method", "body", F.col("sampled_at").cast("timestamp").alias("sampled_at"))
    source, out, rejects, checkpoint = (scratch_folder(spark, f"ingest-{n}") for n in ("source", "out", "rejects", "checkpoint"))
    half = rows.agg(F.percentile_approx(F.col("sampled_at"), 0.5)).first()[0]
    for part in (rows.filter(F.col("sampled_at") <= F.lit(half)), rows.filter(F.col("sampled_at") > F.lit(half))):
        part.repartition(8).write.mode("append").parquet(source)
        SG.ingest(spark.readStream.schema(rows.schema).parquet(source), out, rejects, checkpoint, trigger={"availableNow": True}).awaitTermination()
    stored = spark.read.parquet(out).drop("batch", "ingest_date").withColumn("rejected", F.lit(False))
    refused = spark.read.parquet(rejects).drop("batch", "body").withColumnRenamed("sampled_at", "ingested_at").withColumn("rejected", F.lit(True))
    return plain_times(stored.unionByName(refused, allowMissingColumns=True))


@query(
    "stream_alert_groups",
    """SELECT service_id, alert_severity, notified_at, n_new FROM sent
       WHERE notified_at < (SELECT date_trunc('millisecond', max(detected_at)) FROM violations) - INTERVAL 10 MINUTE""",
    ("violations",), _SECONDS,
)
def stream_alert_groups(spark, sf_dir):
    """The notifications that are due when the watermark has passed them; timers send them."""
    source = as_stream(grouped_alerts(spark, sf_dir), "detected_at")
    return plain_times(run_to_table(SA.notification_stream(source, ["service_id", "alert_severity"], "detected_at"), "alert_groups"))


@query(
    "stream_alert_sustained",
    """SELECT endpoint, min(w) AS started_at, max(w) AS last_at, CAST(epoch(max(w)) - epoch(min(w)) AS BIGINT) AS held_seconds
       FROM (SELECT *, sum(new) OVER (PARTITION BY endpoint ORDER BY w) AS island FROM (
         SELECT *, CASE WHEN hit IS DISTINCT FROM lag(hit) OVER (PARTITION BY endpoint ORDER BY w) THEN 1 ELSE 0 END AS new FROM series))
       WHERE hit AND w < (SELECT max(w) FROM series) - INTERVAL 10 MINUTE GROUP BY endpoint, island HAVING epoch(max(w)) - epoch(min(w)) >= 7200""",
    TRAFFIC,
    """series AS (SELECT endpoint, time_bucket(INTERVAL 1 HOUR, sampled_at) AS w, quantile_cont(duration_ms, 0.95) > 450 AS hit
         FROM traffic_samples GROUP BY ALL)""",
)
def stream_alert_sustained(spark, sf_dir):
    """The latency rule on a stream of hourly evaluations: the stretches that its alerts tell of."""
    series = M.latency_quantiles(samples(spark, sf_dir), window="1 hour").select("endpoint", "window_start", (F.col("p95") > 450).alias("hit"))
    raised = SA.sustained_stream(as_stream(series, "window_start"), ["endpoint"], "window_start", "hit", 7200)
    told = plain_times(run_to_table(raised, "alert_sustained"))
    stretches = told.groupBy("endpoint", "started_at").agg(F.max("last_at").alias("last_at"))
    held = F.unix_seconds(F.col("last_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    # an alert that a timer raised may have ended with the evaluation before it
    return stretches.withColumn("held_seconds", held).where(F.col("held_seconds") >= 7200)


@query(
    "stream_late_rows",
    """SELECT sample_id, sampled_at FROM batched JOIN marks USING (batch) WHERE sampled_at < seen - INTERVAL 10 MINUTE""",
    TRAFFIC,
    """arrivals AS (SELECT sample_id, sampled_at, sample_id + CASE WHEN sample_id % 97 = 0 THEN 500 ELSE 0 END AS arrival FROM traffic_samples),
      batched AS (SELECT *, CASE WHEN arrival <= t // 4 THEN 0 WHEN arrival <= t * 2 // 4 THEN 1 WHEN arrival <= t * 3 // 4 THEN 2 ELSE 3 END AS batch
        FROM arrivals, (SELECT max(arrival) AS t FROM arrivals)),
      marks AS (SELECT batch, max(max(sampled_at)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM batched GROUP BY batch)""",
)
def stream_late(spark, sf_dir):
    """Samples that arrive out of order, in four batches: the late ones, from the side table."""
    arrivals = samples(spark, sf_dir).selectExpr(
        "sample_id", "sampled_at", "sample_id + CASE WHEN sample_id % 97 = 0 THEN 500 ELSE 0 END AS arrival"
    )
    last = arrivals.agg(F.max("arrival")).first()[0] or 0
    source = as_stream(arrivals, "arrival", cuts=[last * i // 4 for i in (1, 2, 3)])
    ok, late, marks, checkpoint = (scratch_folder(spark, f"late-{n}") for n in ("ok", "late", "marks", "checkpoint"))
    SL.split_late(source, "sampled_at", ok, late, marks, checkpoint).awaitTermination()
    return plain_times(spark.read.parquet(late).select("sample_id", "sampled_at"))
