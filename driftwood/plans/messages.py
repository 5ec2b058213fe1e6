"""Registered queries over what messages carry: saga data, envelopes of other buses, trace headers, raw payloads, deferral."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, headers
from ..operators import dispatch, limits, routing, transport
from ..operators.saga import Then, carried
from ..sources.queues import read
from .catalog import _DISPATCH, _ENDPOINT, _RAW, _REG, _TYPE, DAY, FLOW, _inbound, _values, _walk, query

_CENTS = "CAST(floor(100 * coalesce(value, 0)) AS BIGINT)"
_VALUED = f"SELECT user_id AS k, ts, event_id AS id, event_type AS event, {_CENTS} AS cents FROM events"


@query(
    _walk("SELECT user_id AS k, ts, event_id AS id, event_type AS event FROM events", "purchase error")
    + f""",
handled AS (
  SELECT w.*, e.cents, sum(CASE WHEN was = 'Initial' THEN 1 ELSE 0 END) OVER (PARTITION BY w.k ORDER BY n) AS saga
  FROM walk w JOIN ({_VALUED}) e ON e.id = w.id
  WHERE (was = 'Initial' AND w.event = 'signup') OR (was = 'Processing' AND w.event IN ('purchase', 'error', 'view'))
)
SELECT k AS user_id, CAST(saga AS BIGINT) AS saga, max(CASE WHEN event = 'signup' THEN id END) AS opened_by, CAST(count(*) FILTER (WHERE event = 'view') AS BIGINT) AS views,
  CAST(coalesce(sum(cents) FILTER (WHERE event IN ('view', 'purchase')), 0) AS BIGINT) AS cents, arg_max(id, n) AS last_id FROM handled GROUP BY k, saga"""
)
def saga_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every saga of a user has gathered: counts and sums that its events add to, and ids that they put."""
    events = read(spark, sf_dir, "events").selectExpr("user_id AS key", "ts", "event_id AS id", "event_type AS event", f"{_CENTS} AS cents")
    fields = {"opened_by": Then("id", ("signup",)), "views": Then("1L", ("view",), "add"), "cents": Then("cents", ("view", "purchase"), "add"), "last_id": Then("id")}
    return carried(events, FLOW, DAY, fields).withColumnRenamed("key", "user_id")


_SAGAS = "('main', 'view', 'FlowSaga', 2), ('main', 'error', 'FlowSaga', 2), ('main', 'error', 'ErrorSaga', 1), ('audit', 'signup', 'AuditSaga', 1)"


@query(
    _DISPATCH
    + f""",
sagas(endpoint, message_type, saga, position) AS (VALUES {_SAGAS}),
s AS (SELECT endpoint, message_type, arg_min(saga, position) AS saga FROM sagas GROUP BY 1, 2),
x AS (SELECT t.*, s.saga, consumer IS NULL AND message_type IS NOT NULL AND body NOT LIKE 'not%' AND s.saga IS NOT NULL AS takes FROM t LEFT JOIN s USING (endpoint, message_type))
SELECT message_id, endpoint, saga AS handler FROM x WHERE takes
UNION ALL SELECT h.message_id, h.endpoint, h.handler FROM h JOIN x ON x.message_id = h.message_id WHERE NOT x.takes"""
)
def dispatch_sagas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed consumers first, then the first saga with an event of the type, then raw consumers."""
    reg = _values(spark, _REG, "endpoint, message_type, consumer, position")
    sagas = _values(spark, _SAGAS, "endpoint, message_type, saga, position")
    out = dispatch.fallback(dispatch.typed(_inbound(spark, sf_dir), reg), reg, _values(spark, _RAW, "endpoint, consumer"), sagas)
    return out.select("message_id", "endpoint", F.explode("handlers").alias("handler"))


@query(f"""
SELECT event_id AS message_id, 'main.wait' AS exchange, event_type AS routing_key, CASE WHEN event_id % 19 = 0 THEN 'Defer' ELSE 'Nack' END AS action FROM events
WHERE {_ENDPOINT} = 'main' AND event_id % 97 <> 0 AND (event_id % 19 = 0 OR (event_id % 17 <> 0 AND event_id % 7 = 0))""")
def settlement_defer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deferred messages go where nacked ones go, to wait there."""
    i = F.col("message_id")
    rows = read(spark, sf_dir, "events").selectExpr("event_id AS message_id", f"{_ENDPOINT} AS endpoint", "event_type AS routing_key")
    settled = rows.withColumn("action", dispatch.settlement(F.lit(True), i % 17 == 0, i % 7 == 0, i % 97 == 0, i % 19 == 0, defer_enabled=True))
    queues = _values(spark, "('main', 'main.wait', CAST(NULL AS STRING)), ('audit', '', 'x')", "endpoint, dead_letter_exchange, dead_letter_key")
    return transport.dead_lettered(settled, queues).select("message_id", "exchange", "routing_key", "action")


@query("SELECT event_id, concat('{\"messageId\":\"', event_id, '\",\"messageType\":[\"urn:message:shop:', event_type, '\"],\"sentTime\":\"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 'Z\",\"message\":', props, '}') AS json FROM events")
def interop_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    sent = F.expr("to_timestamp(concat(CAST(ts AS STRING), 'Z'))")  # the table's times are UTC, whatever the session's zone
    return e.select("event_id", codec.interop_envelope(F.col("event_id").cast("string"), F.lit("shop"), F.col("event_type"), sent, F.col("props")).alias("json"))


@query("SELECT event_id, CASE WHEN event_id % 6 > 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 6 > 2 AS is_read FROM events")
def interop_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes, some whose message is null or missing, and some texts that are none."""
    text = F.expr("CASE event_id % 6 WHEN 0 THEN 'not json' WHEN 1 THEN '{\"messageId\":\"x\",\"message\":null}' WHEN 2 THEN '{\"messageId\":\"x\"}' ELSE concat('{\"headers\":{},\"message\":', props, '}') END")
    out = read(spark, sf_dir, "events").select("event_id", codec.interop_message(text, "k bigint").alias("m"))
    return out.select("event_id", "m.k", F.col("m").isNotNull().alias("is_read"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'old' ELSE concat('00-', lower(hex(user_id + 1048576)), repeat('c', 26), '-', lpad(CAST(event_id AS VARCHAR), 16, '0'), CASE WHEN event_id % 2 = 0 THEN '-01' ELSE '-00' END) END AS traceparent,
  'y' AS custom, CASE WHEN event_id % 4 <> 0 THEN event_id % 2 = 0 END AS sampled FROM events""")
def trace_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers as a publish span leaves them, and what the consumer reads of them; a quarter of the messages has no span."""
    trace_id = F.expr("CASE WHEN event_id % 4 <> 0 THEN concat(hex(user_id + 1048576), repeat('C', 26)) END")
    caller = F.expr("map('custom', 'y', IF(event_id % 4 = 0, 'traceparent', 'TraceParent'), 'old')")
    sent = headers.inject(caller, trace_id, F.expr("lpad(event_id, 16, '0')"), F.col("event_id") % 2 == 0)
    out = read(spark, sf_dir, "events").select("event_id", sent.alias("h"))
    return out.select("event_id", F.col("h")["traceparent"].alias("traceparent"), F.col("h")["custom"].alias("custom"), headers.trace(F.col("h"))["sampled"].alias("sampled"))


@query("SELECT o_orderkey, '' AS exchange, concat('amq/q', o_custkey, '/') AS routing_key, CAST(0 AS INTEGER) AS n_headers FROM orders")
def send_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = routing.send_raw(F.expr("concat('rabbit://host:5672//amq/q', o_custkey, '/', IF(o_orderkey % 2 = 0, '?durable=true', ''))"))
    out = read(spark, sf_dir, "orders").select("o_orderkey", to.alias("a"))
    return out.select("o_orderkey", "a.exchange", "a.routing_key", F.size("a.headers").alias("n_headers"))


@query(f"SELECT event_id AS message_id, CASE WHEN {_TYPE} IS NULL THEN 'default.x' ELSE 'typed.x' END AS exchange, CASE WHEN {_TYPE} IS NULL THEN '' ELSE concat('driftwood.', event_type) END AS routing_key FROM events")
def publish_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages have no type: they go to the default exchange under an empty key."""
    m = read(spark, sf_dir, "events").selectExpr("event_id AS message_id", f"{_TYPE} AS message_type", "CAST(NULL AS STRING) AS header_exchange")
    exchanges = m.where("message_type IS NOT NULL").select("message_type").distinct().withColumn("exchange", F.lit("typed.x"))
    keys = _values(spark, "('none', 'none')", "message_type, routing_key")
    return routing.publish(m, exchanges, keys, "default.x").select("message_id", "exchange", "routing_key")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) x WHERE n > 10")
def queue_reject_dlx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.rejected(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10, DAY).select("user_id", "event_id")


_BYTES = "SELECT user_id % 7 AS endpoint, ts, event_id AS id, length(props) AS delta FROM events UNION ALL SELECT user_id % 7, ts + {later}, event_id, -length(props) FROM events"


@query(f"SELECT endpoint, id, CAST(delta AS BIGINT) AS delta, CAST(sum(delta) OVER (PARTITION BY endpoint ORDER BY ts, delta, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_flight_bytes FROM ({_BYTES.format(later='to_seconds(60 + event_id % 90)')}) x")
def flow_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("endpoint"), "ts", F.col("event_id").alias("id"), F.octet_length("props").cast("long").alias("delta"))
    ends = e.withColumns({"ts": F.expr("ts + make_dt_interval(0, 0, 0, 60 + id % 90)"), "delta": -F.col("delta")})
    return limits.level(e.unionByName(ends), ["endpoint"], ["ts", "delta", "id"], "delta", "date_trunc('hour', ts)", "in_flight_bytes").select("endpoint", "id", "delta", "in_flight_bytes")


@query("SELECT event_id, event_type IN ('view', 'purchase', 'signup') AND event_type <> 'signup' AND event_id % 5 < 3 AS again FROM events")
def retry_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as kinds of errors: view and purchase are seen, signup is a purchase; what is ignored wins over what is handled."""
    parents = {"view": "seen", "purchase": "seen", "signup": "purchase"}
    again = limits.retryable(F.col("event_type"), F.col("event_id") % 5, 3, limits.subtypes(["seen"], parents), limits.subtypes(["signup"], parents))
    return read(spark, sf_dir, "events").select("event_id", again.alias("again"))
