"""Queries on traffic sources, sinks, sampling, dedup and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlake.functions.scalars import endpoint_with_query
from driftlake.operators import metrics as M
from driftlake.operators import notify as N
from driftlake.operators import sampling as A
from driftlake.operators.dedup import dedup, with_hash
from driftlake.plans.catalog import query
from driftlake.plans.inference import TRAFFIC
from driftlake.plans.registry import AS_OF_SQL, as_of
from driftlake.plans.views import base, view
from driftlake.session import scratch_folder
from driftlake.sources import avro_wire as A2
from driftlake.sources import sinks as K
from driftlake.sources import traffic as T
from driftlake.streaming.late import late_by_batch


def samples(spark, sf_dir):
    return view(spark, sf_dir, "traffic_samples")


# -- sources and sinks -------------------------------------------------------------------------


_ENVELOPE_SQL = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('svc-', CAST(user_id % 10 AS STRING))
         WHEN event_id % 3 = 0 THEN concat('key-', CAST(event_id AS STRING)) ELSE 'unknown' END AS service_id,
       CASE WHEN event_id % 5 = 0 THEN '/unknown' ELSE concat('/api/', event_type) END AS endpoint,
       CASE WHEN event_id % 7 = 0 THEN 'GET' ELSE 'POST' END AS method,
       CASE WHEN event_id % 11 = 0 THEN '{}' ELSE props END AS payload FROM events"""


@query("envelope_defaults", _ENVELOPE_SQL)
def envelope_defaults(spark, sf_dir):
    return T.decode_envelope(raw_records(spark, sf_dir), keep=["event_id"])


def raw_records(spark, sf_dir):
    """Raw records with a map of headers; some lack headers, key or value."""
    return base(spark, sf_dir, "events").selectExpr(
        "event_id", "ts",
        """map_filter(map('service_id', CASE WHEN event_id % 2 = 0 THEN concat('svc-', user_id % 10) END,
             'endpoint', CASE WHEN event_id % 5 <> 0 THEN concat('/api/', event_type) END,
             'method', CASE WHEN event_id % 7 <> 0 THEN 'POST' END), (k, v) -> v IS NOT NULL) AS headers""",
        "CASE WHEN event_id % 3 = 0 THEN encode(concat('key-', event_id), 'UTF-8') END AS key",
        "CASE WHEN event_id % 11 <> 0 THEN encode(props, 'UTF-8') END AS value",
    )


@query(
    "src_traffic",
    """SELECT service_id, endpoint, method, CASE WHEN sample_id % 3 = 0 THEN '' ELSE endpoint END AS request_schema_sample,
       '' AS response_schema_sample, status_code, date_trunc('millisecond', sampled_at) AS captured_at,
       date_trunc('millisecond', sampled_at) + INTERVAL 1 SECOND AS sampled_at FROM traffic_samples""",
    TRAFFIC,
)
def src_traffic(spark, sf_dir):
    """Wire records as JSON text, decoded with their defaults."""
    wire = samples(spark, sf_dir).selectExpr(
        """to_json(struct(service_id, endpoint, method, CASE WHEN sample_id % 3 <> 0 THEN endpoint END AS request_schema_sample,
             status_code, unix_millis(CAST(sampled_at AS TIMESTAMP)) AS timestamp,
             unix_millis(CAST(sampled_at AS TIMESTAMP)) + 1000 AS sampled_at)) AS value"""
    )
    return T.decode_wire(wire)


_WIRE_SQL = """SELECT service_id, endpoint, method, CASE WHEN sample_id % 3 = 0 THEN '' ELSE endpoint END AS request_schema_sample,
       '' AS response_schema_sample, status_code, date_trunc('millisecond', sampled_at) AS captured_at,
       date_trunc('millisecond', sampled_at) + INTERVAL 1 SECOND AS sampled_at FROM traffic_samples"""


def _avro_records(spark, sf_dir):
    """Avro records behind a schema number; each nineteenth is cut off, each twenty-third has bytes left over."""
    rows = samples(spark, sf_dir).selectExpr(
        "sample_id", "service_id", "endpoint", "method", "CASE WHEN sample_id % 3 <> 0 THEN endpoint END AS request_schema_sample",
        "CAST(NULL AS STRING) AS response_schema_sample", "status_code", "unix_millis(CAST(sampled_at AS TIMESTAMP)) AS ts",
        "unix_millis(CAST(sampled_at AS TIMESTAMP)) + 1000 AS sampled_at",
    )
    records = A2.encode_avro(rows, ["sample_id"], schema_number=7)
    return records.withColumn("value", F.expr("CASE WHEN sample_id % 19 = 0 THEN substring(value, 1, 12) WHEN sample_id % 23 = 0 THEN concat(value, X'01') ELSE value END"))


@query("src_traffic_avro", f"{_WIRE_SQL} WHERE sample_id % 19 <> 0 AND sample_id % 23 <> 0", TRAFFIC)
def src_traffic_avro(spark, sf_dir):
    return A2.decode_avro(_avro_records(spark, sf_dir), framed=True)[0]


@query(
    "rejected_avro",
    """SELECT sample_id, CASE WHEN sample_id % 19 = 0 THEN 'endpoint is cut off' ELSE 'bytes left over' END AS error
       FROM traffic_samples WHERE sample_id % 19 = 0 OR sample_id % 23 = 0""",
    TRAFFIC,
)
def rejected_avro(spark, sf_dir):
    return A2.decode_avro(_avro_records(spark, sf_dir), keep=["sample_id"], framed=True)[1].drop("value")


@query(
    "src_ndjson",
    """SELECT date_trunc('second', sampled_at) AS sampled_at, service_id AS source, consumer_id AS destination, method, endpoint AS path,
       status_code, duration_ms, 'development' AS environment FROM traffic_samples WHERE sample_id % 13 <> 0 AND sample_id % 17 <> 0""",
    TRAFFIC,
)
def src_ndjson(spark, sf_dir):
    """Lines of a proxy log, some blank and some cut off."""
    line = """to_json(struct(date_format(sampled_at, "yyyy-MM-dd'T'HH:mm:ss'Z'") AS timestamp, service_id AS source, consumer_id AS destination,
        method, endpoint AS path, status_code, duration_ms, 'development' AS environment))"""
    lines = samples(spark, sf_dir).selectExpr(
        f"CASE WHEN sample_id % 13 = 0 THEN '   ' WHEN sample_id % 17 = 0 THEN left({line}, 40) ELSE {line} END AS value"
    )
    return T.parse_ndjson(lines).select(
        "sampled_at", "source", "destination", "method", "path", "status_code", "duration_ms", "environment"
    )


@query(
    "sink_keyed_json",
    """SELECT concat(service_id, ':', endpoint) AS key, service_id, endpoint, method, status_code, body FROM traffic_samples""",
    TRAFFIC,
)
def sink_keyed_json(spark, sf_dir):
    rows = samples(spark, sf_dir).select("service_id", "endpoint", "method", "status_code", "body")
    records = K.keyed_json(rows, ["service_id", "endpoint"])
    back = F.from_json("value", "service_id string, endpoint string, method string, status_code int, body string")
    return records.select("key", back.alias("v")).select("key", "v.*")


@query(
    "sink_raw_samples",
    r"""SELECT service_id, endpoint, method, CASE WHEN json_valid(body) THEN regexp_replace(body, '"ts":\d+', '"ts":"__NORMALIZED_TIMESTAMP__"')
        ELSE body END AS normalized_payload, sha256(body) AS content_hash, sampled_at AS ingested_at
        FROM traffic_samples WHERE sampled_at BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""",
    TRAFFIC,
)
def sink_raw_samples(spark, sf_dir):
    """Written by date, then replayed for a week: only the folders of that week are read."""
    path = scratch_folder(spark, "raw_samples")
    K.write_raw_samples(K.raw_samples(samples(spark, sf_dir)), path)
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 06:00:00", "2024-01-12 00:00:00"))
    return K.replay(K.read_raw_samples(spark, path), start, end).drop("ingest_date")


@query(
    "replay_range",
    """SELECT sample_id, service_id, sampled_at FROM traffic_samples
       WHERE sampled_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00' ORDER BY sampled_at DESC""",
    TRAFFIC,
)
def replay_range(spark, sf_dir):
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-10 00:00:00", "2024-01-10 12:00:00"))
    rows = samples(spark, sf_dir).select("sample_id", "service_id", "sampled_at")
    return K.replay(rows, start, end, time="sampled_at", date=None)


_HOLES = """SELECT sample_id, CASE WHEN sample_id % 10 = 0 THEN ' ' ELSE service_id END AS service_id, endpoint,
  CASE WHEN sample_id % 15 = 0 THEN CAST(NULL AS STRING) ELSE method END AS method,
  CASE WHEN sample_id % 4 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE sampled_at END AS sampled_at FROM traffic_samples"""


def _with_holes(spark, sf_dir):
    return samples(spark, sf_dir).selectExpr(
        "sample_id", "CASE WHEN sample_id % 10 = 0 THEN ' ' ELSE service_id END AS service_id", "endpoint",
        "CASE WHEN sample_id % 15 <> 0 THEN method END AS method", "CASE WHEN sample_id % 4 <> 0 THEN sampled_at END AS sampled_at",
    )


@query(
    "validate_samples",
    f"""SELECT sample_id, service_id, endpoint, method, coalesce(sampled_at, {AS_OF_SQL}) AS sampled_at FROM holes
        WHERE trim(service_id) <> '' AND trim(method) <> ''""",
    TRAFFIC, f"holes AS ({_HOLES})",
)
def validate_samples(spark, sf_dir):
    return T.validate(_with_holes(spark, sf_dir), as_of())[0]


@query(
    "rejected_samples",
    "SELECT * FROM holes WHERE trim(service_id) = '' OR method IS NULL",
    TRAFFIC, f"holes AS ({_HOLES})",
)
def rejected_samples(spark, sf_dir):
    return T.validate(_with_holes(spark, sf_dir), as_of())[1]


@query(
    "endpoint_from_url",
    r"""SELECT page_id, concat(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1),
        CASE WHEN regexp_matches(url, '^[^#]*\?') THEN concat('?', regexp_extract(url, '\?([^#]*)', 1)) ELSE '' END) AS endpoint FROM pages""",
)
def endpoint_from_url(spark, sf_dir):
    pages = base(spark, sf_dir, "pages")
    path, text = F.try_parse_url("url", F.lit("PATH")), F.try_parse_url("url", F.lit("QUERY"))
    return pages.select("page_id", endpoint_with_query(path, text).alias("endpoint"))


# -- sampling and dedup ------------------------------------------------------------------------


@query(
    "rate_limit_sample",
    """SELECT sample_id, time_bucket(INTERVAL 1 HOUR, sampled_at) AS window_start FROM traffic_samples
       QUALIFY row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, sampled_at) ORDER BY sampled_at, sample_id) <= 5""",
    TRAFFIC,
)
def rate_limit_sample(spark, sf_dir):
    return A.rate_limit(samples(spark, sf_dir), cap=5, seconds=3600).select("sample_id", "window_start")


@query(
    "rate_limit_errors_first",
    """SELECT sample_id, time_bucket(INTERVAL 1 HOUR, sampled_at) AS window_start FROM traffic_samples
       QUALIFY row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, sampled_at)
         ORDER BY CASE WHEN status_code >= 400 THEN 0 ELSE 1 END, sampled_at, sample_id) <= 5""",
    TRAFFIC,
)
def rate_limit_errors_first(spark, sf_dir):
    kept = A.rate_limit(samples(spark, sf_dir), cap=5, seconds=3600, errors_first="status_code")
    return kept.select("sample_id", "window_start")


@query(
    "rate_limit_sample_exact",
    """SELECT sample_id, s.t AS window_start FROM traffic_samples JOIN starts s
         ON sampled_at >= s.t AND sampled_at < coalesce(s.next, TIMESTAMP '9999-01-01')
       QUALIFY row_number() OVER (PARTITION BY s.t ORDER BY sampled_at, sample_id) <= 5""",
    TRAFFIC,
    """chain AS (SELECT min(sampled_at) AS t FROM traffic_samples UNION ALL
         SELECT min(x.sampled_at) FROM chain c JOIN traffic_samples x ON x.sampled_at >= c.t + INTERVAL 1 HOUR GROUP BY c.t),
       starts AS (SELECT t, lead(t) OVER (ORDER BY t) AS next FROM chain)""",
)
def rate_limit_sample_exact(spark, sf_dir):
    return A.rate_limit_exact(samples(spark, sf_dir), cap=5, seconds=3600).select("sample_id", "window_start")


@query(
    "reservoir_per_endpoint",
    """SELECT sample_id, endpoint, time_bucket(INTERVAL 1 DAY, sampled_at) AS window_start FROM traffic_samples
       QUALIFY row_number() OVER (PARTITION BY endpoint, time_bucket(INTERVAL 1 DAY, sampled_at)
         ORDER BY sample_id * 7919 % 10007, sample_id) <= 5""",
    TRAFFIC,
)
def reservoir_per_endpoint(spark, sf_dir):
    order = F.struct(F.expr("sample_id * 7919 % 10007"), "sample_id")
    kept = A.reservoir(samples(spark, sf_dir), order, size=5, seconds=86400)
    return kept.select("sample_id", "endpoint", "window_start")


# Four samples in five repeat one of three payloads; the time inside differs for half of those, so only masking makes them equal.
PAYLOAD = """CASE WHEN sample_id % 5 = 0 THEN body ELSE concat('{"order_id":"ord_1","amount":', CAST(sample_id % 3 AS STRING), ',"ts":',
  CASE WHEN sample_id % 2 = 0 THEN '0' ELSE CAST(sample_id * 1000 AS STRING) END, '}') END"""
_MASKED_SQL = r"""CASE WHEN json_valid(p) THEN regexp_replace(p, '"ts":\d+', '"ts":"__NORMALIZED_TIMESTAMP__"') ELSE p END"""


def _dedup_sql(payload: str) -> str:
    return f"""hashed AS (SELECT sample_id, sampled_at, sha256({payload}) AS content_hash FROM (SELECT *, {PAYLOAD} AS p FROM traffic_samples)),
  chain AS (SELECT content_hash, min(sampled_at) AS t FROM hashed GROUP BY ALL UNION ALL
    SELECT c.content_hash, min(h.sampled_at) FROM chain c JOIN hashed h
      ON h.content_hash = c.content_hash AND h.sampled_at >= c.t + INTERVAL 5 MINUTE GROUP BY c.content_hash, c.t)"""


_DEDUP, _DEDUP_NORMALIZED = _dedup_sql("p"), _dedup_sql(_MASKED_SQL)
_KEPT = """SELECT h.sample_id, h.sampled_at, h.content_hash FROM hashed h JOIN chain c
       ON h.content_hash = c.content_hash AND h.sampled_at = c.t"""


def payload_hashes(spark, sf_dir, hash_on="raw"):
    """Samples with the hash of their whole payload, as captured or with volatile fields masked."""
    rows = samples(spark, sf_dir).withColumn("body", F.expr(PAYLOAD))
    return with_hash(rows, hash_on=hash_on).select("sample_id", "sampled_at", "content_hash")


@query("dedup_5m", _KEPT, TRAFFIC, _DEDUP)
def dedup_5m(spark, sf_dir):
    return dedup(payload_hashes(spark, sf_dir))


@query("dedup_5m_normalized", _KEPT, TRAFFIC, _DEDUP_NORMALIZED)
def dedup_5m_normalized(spark, sf_dir):
    return dedup(payload_hashes(spark, sf_dir, "normalized"))


@query("dedup_5m_busy", _KEPT, TRAFFIC, _DEDUP_NORMALIZED)
def dedup_5m_busy(spark, sf_dir):
    """The same result with the repeated payloads cut into segments, as busy keys are."""
    return dedup(payload_hashes(spark, sf_dir, "normalized"), fold_limit=50, leaf_rows=400)


# -- metrics -----------------------------------------------------------------------------------


@query(
    "error_rate_by_endpoint",
    """SELECT service_id, endpoint, count(*) AS n, count(*) FILTER (status_code >= 400) AS errors,
       CAST(count(*) FILTER (status_code >= 400) AS DOUBLE) / count(*) AS error_rate FROM traffic_samples GROUP BY ALL""",
    TRAFFIC,
)
def error_rate_by_endpoint(spark, sf_dir):
    return M.error_rate(samples(spark, sf_dir))


def _rate_sql(table: str, time: str, label: str) -> str:
    return f"""SELECT w AS window_start, {label}, count(*) AS n, count(*) / CAST(300 AS DOUBLE) AS rate
      FROM (SELECT {label}, unnest([time_bucket(INTERVAL 1 MINUTE, {time}) - to_minutes(m) for m in [0, 1, 2, 3, 4]]) AS w FROM {table})
      GROUP BY ALL"""


@query("violation_rate_5m", _rate_sql("violations", "detected_at", "severity"), ("violations",))
def violation_rate_5m(spark, sf_dir):
    return M.rate(view(spark, sf_dir, "violations"), "detected_at", ["severity"])


@query("gate_rate_5m", _rate_sql("gate_history", "decided_at", "decision"), ("gate_history",))
def gate_rate_5m(spark, sf_dir):
    return M.rate(view(spark, sf_dir, "gate_history"), "decided_at", ["decision"])


@query(
    "latency_quantiles",
    """SELECT endpoint, time_bucket(INTERVAL 5 MINUTE, sampled_at) AS window_start, count(*) AS n,
       quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99
       FROM traffic_samples GROUP BY ALL""",
    TRAFFIC,
)
def latency_quantiles(spark, sf_dir):
    return M.latency_quantiles(samples(spark, sf_dir))


_FLOORED = "(duration_ms >> greatest(length(bin(duration_ms)) - 7, 0)) << greatest(length(bin(duration_ms)) - 7, 0)"


def _sketch_sql(where: str = "") -> str:
    return f"""SELECT window_start, endpoint, count(*) AS n, {', '.join(f"CAST(max(v) FILTER (rn - 1 = c * {p} // 100) AS BIGINT) AS p{p}" for p in (50, 95, 99))}
      FROM (SELECT *, row_number() OVER (PARTITION BY window_start, endpoint ORDER BY v) AS rn, count(*) OVER (PARTITION BY window_start, endpoint) AS c
        FROM (SELECT endpoint, {_FLOORED} AS v, unnest([time_bucket(INTERVAL 1 MINUTE, sampled_at) - to_minutes(m) for m in [0, 1, 2, 3, 4]]) AS window_start
          FROM traffic_samples {where})) GROUP BY ALL"""


@query("latency_sketch", _sketch_sql(), TRAFFIC)
def latency_sketch(spark, sf_dir):
    """Sliding quantiles merged from one-minute sketches, exact below 128 ms and within 1/64 above."""
    return M.sketch_quantiles(M.latency_panes(samples(spark, sf_dir)))


@query(
    "load_stats",
    """SELECT t.*, p50, p95, p99 FROM (
         SELECT endpoint, count(*) AS requests, count(*) FILTER (status_code < 400) AS successful, count(*) FILTER (status_code >= 400) AS errors,
           min(duration_ms) FILTER (status_code < 400) AS min_ms,
           CAST(floor(avg(duration_ms) FILTER (status_code < 400)) AS BIGINT) AS avg_ms, max(duration_ms) FILTER (status_code < 400) AS max_ms
         FROM traffic_samples GROUP BY endpoint) t LEFT JOIN (
         SELECT endpoint, max(duration_ms) FILTER (rn - 1 = c * 50 // 100) AS p50, max(duration_ms) FILTER (rn - 1 = c * 95 // 100) AS p95,
           max(duration_ms) FILTER (rn - 1 = c * 99 // 100) AS p99
         FROM (SELECT endpoint, duration_ms, row_number() OVER (PARTITION BY endpoint ORDER BY duration_ms) AS rn,
                 count(*) OVER (PARTITION BY endpoint) AS c FROM traffic_samples WHERE status_code < 400) GROUP BY endpoint) r USING (endpoint)""",
    TRAFFIC,
)
def load_stats(spark, sf_dir):
    return M.load_stats(samples(spark, sf_dir))


@query(
    "slo_check",
    """SELECT endpoint, quantile_cont(duration_ms, 0.95) AS p95_ms, CAST(count(*) FILTER (status_code >= 400) AS DOUBLE) / count(*) AS failure_rate,
       quantile_cont(duration_ms, 0.95) < 500 AS latency_ok, CAST(count(*) FILTER (status_code >= 400) AS DOUBLE) / count(*) < 0.01 AS failures_ok
       FROM traffic_samples GROUP BY ALL""",
    TRAFFIC,
)
def slo_check(spark, sf_dir):
    return M.slo_check(samples(spark, sf_dir))


@query(
    "alert_sustained",
    """SELECT endpoint, min(w) AS started_at, max(w) AS last_at, CAST(epoch(max(w)) - epoch(min(w)) AS BIGINT) AS held_seconds
       FROM (SELECT *, sum(new) OVER (PARTITION BY endpoint ORDER BY w) AS island FROM (
         SELECT *, CASE WHEN hit IS DISTINCT FROM lag(hit) OVER (PARTITION BY endpoint ORDER BY w) THEN 1 ELSE 0 END AS new FROM (
           SELECT endpoint, time_bucket(INTERVAL 1 HOUR, sampled_at) AS w, quantile_cont(duration_ms, 0.95) > 450 AS hit
           FROM traffic_samples GROUP BY ALL)))
       WHERE hit GROUP BY endpoint, island HAVING epoch(max(w)) - epoch(min(w)) >= 7200""",
    TRAFFIC,
)
def alert_sustained(spark, sf_dir):
    """The latency rule: the hourly p95 of an endpoint stays high for two hours."""
    series = M.latency_quantiles(samples(spark, sf_dir), window="1 hour")
    return M.sustained_alerts(series, ["endpoint"], "window_start", F.col("p95") > 450, 7200)


_ALERTS = """SELECT violation_id, service_id, detected_at,
  CASE severity WHEN 'BREAKING' THEN 'P1' WHEN 'WARNING' THEN 'P2' ELSE 'P3' END AS alert_severity FROM violations"""


@query(
    "alert_throttle",
    """SELECT a.violation_id, a.service_id, a.detected_at, a.alert_severity, a.receiver, a.repeat_seconds FROM alerts a JOIN chain c
       ON a.service_id = c.service_id AND a.alert_severity = c.alert_severity AND a.detected_at = c.t""",
    ("violations",),
    f"""alerts AS (SELECT *, CASE alert_severity WHEN 'P2' THEN 'slack-warning' ELSE 'slack-critical' END AS receiver,
          CASE alert_severity WHEN 'P1' THEN 3600 ELSE 14400 END AS repeat_seconds FROM ({_ALERTS})),
        chain AS (SELECT service_id, alert_severity, min(detected_at) AS t FROM alerts GROUP BY ALL UNION ALL
          SELECT c.service_id, c.alert_severity, min(a.detected_at) FROM chain c JOIN alerts a
            ON a.service_id = c.service_id AND a.alert_severity = c.alert_severity AND a.detected_at >= c.t + to_seconds(a.repeat_seconds)
          GROUP BY c.service_id, c.alert_severity, c.t)""",
)
def alert_throttle(spark, sf_dir):
    level = F.when(F.col("severity") == "BREAKING", "P1").when(F.col("severity") == "WARNING", "P2").otherwise("P3")
    alerts = view(spark, sf_dir, "violations").select("violation_id", "service_id", "detected_at", level.alias("alert_severity"))
    sent = M.throttle_alerts(alerts, M.route_table(spark), ["service_id"], "detected_at", "violation_id")
    return sent.select("violation_id", "service_id", "detected_at", "alert_severity", "receiver", "repeat_seconds")


_SECONDS = """seconds AS (SELECT service_id, alert_severity, CAST(floor(epoch(detected_at)) AS BIGINT) AS t, count(*) AS n,
    CASE alert_severity WHEN 'P1' THEN 3600 ELSE 14400 END AS rep FROM ({alerts}) GROUP BY ALL),
  chain AS (SELECT service_id, alert_severity, min(t) + 30 AS f FROM seconds GROUP BY ALL UNION ALL
    SELECT service_id, alert_severity, f FROM (
      SELECT service_id, alert_severity, CASE WHEN least(CASE WHEN fresh <= closing THEN fresh END, CASE WHEN rep // 300 < closing THEN rep // 300 END) IS NOT NULL
          THEN f + 300 * least(CASE WHEN fresh <= closing THEN fresh END, CASE WHEN rep // 300 < closing THEN rep // 300 END) ELSE upcoming + 30 END AS f
      FROM (SELECT *, greatest(1, (l + 7200 - f + 299) // 300) AS closing, (upcoming - f + 299) // 300 AS fresh FROM (
        SELECT c.service_id, c.alert_severity, c.f, any_value(s.rep) AS rep, max(s.t) FILTER (s.t <= c.f) AS l, min(s.t) FILTER (s.t > c.f) AS upcoming
        FROM chain c JOIN seconds s ON s.service_id = c.service_id AND s.alert_severity = c.alert_severity GROUP BY c.service_id, c.alert_severity, c.f)))
    WHERE f IS NOT NULL),
  spans AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY service_id, alert_severity ORDER BY f), -1) AS b FROM chain),
  sent AS (SELECT s.service_id, s.alert_severity, CASE s.alert_severity WHEN 'P2' THEN 'slack-warning' ELSE 'slack-critical' END AS receiver,
      CAST(to_timestamp(s.f) AT TIME ZONE 'UTC' AS TIMESTAMP) AS notified_at, CAST(coalesce(sum(x.n), 0) AS BIGINT) AS n_new
    FROM spans s LEFT JOIN seconds x ON x.service_id = s.service_id AND x.alert_severity = s.alert_severity AND x.t > s.b AND x.t <= s.f
    GROUP BY s.service_id, s.alert_severity, s.f)""".replace("{alerts}", _ALERTS)


def grouped_alerts(spark, sf_dir):
    level = F.when(F.col("severity") == "BREAKING", "P1").when(F.col("severity") == "WARNING", "P2").otherwise("P3")
    return view(spark, sf_dir, "violations").select("service_id", "detected_at", level.alias("alert_severity"))


@query("alert_groups", "SELECT * FROM sent", ("violations",), _SECONDS)
def alert_groups(spark, sf_dir):
    """Notifications per service and severity: after 30 s, then every 5 minutes, repeated while an alert fires."""
    routed = M.route_alerts(grouped_alerts(spark, sf_dir), M.route_table(spark))
    sent = N.notifications(routed, ["service_id", "alert_severity", "receiver"], "detected_at")
    return sent.select("service_id", "alert_severity", "receiver", "notified_at", "n_new")


@query(
    "late_rows",
    """SELECT sample_id, sampled_at, b.batch FROM arrivals a JOIN (
         SELECT batch, max(max(sampled_at)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
         FROM arrivals GROUP BY batch) b ON a.batch = b.batch WHERE a.sampled_at < b.seen - INTERVAL 10 MINUTE""",
    TRAFFIC,
    """arrivals AS (SELECT sample_id, sampled_at,
         (sample_id + CASE WHEN sample_id % 97 = 0 THEN 500 ELSE 0 END) // 1000 AS batch FROM traffic_samples)""",
)
def late_rows(spark, sf_dir):
    """Each thousand arrivals is a batch; some samples arrive 500 places late."""
    arrivals = samples(spark, sf_dir).selectExpr(
        "sample_id", "sampled_at", "(sample_id + CASE WHEN sample_id % 97 = 0 THEN 500 ELSE 0 END) div 1000 AS batch"
    )
    return late_by_batch(arrivals, "batch", "sampled_at", "10 minutes")
