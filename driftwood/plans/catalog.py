"""The registered queries over the driver's tables, each with the same result in DuckDB's SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, headers
from ..operators import dispatch, limits, metrics, routing, slip, stores
from ..operators.ordered import running_sum
from ..operators.saga import MachineBuilder, fold, transitions, with_timeouts
from ..sources.queues import messages, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


# --- sagas -----------------------------------------------------------------------------------------------------------

#: A purchase flow: signup opens it, purchase completes it, error fails it, a view only touches it.
FLOW = (
    MachineBuilder()
    .initially("signup", to="Processing", emit="ProcessingStarted", timeout_ms=3_600_000)
    .during("Processing", "view")
    .during("Processing", "purchase", to="Completed", emit="FlowCompleted", finalize=True)
    .during("Processing", "error", to="Failed", emit="FlowFailed", finalize=True)
    .build()
)
TIMED = MachineBuilder().initially("signup", to="Processing", timeout_ms=3_600_000).during("Processing", "purchase", to="Completed", finalize=True).during("Processing", "timeout", to="TimedOut", finalize=True).build()
DAY = "date_trunc('day', ts)"


def saga_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("event"))


def _walk(source: str, finals: str, opens: str = "signup", touches: str = "'view'") -> str:
    """SQL: every event of `source` (k, ts, id, event) with the state before it, step by step."""
    done = " ".join(f"WHEN w.nxt = 'Processing' AND n.event = '{e}' THEN 'Initial'" for e in finals.split())
    return f"""
WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, id, event) AS n FROM ({source}) s),
walk AS (
  SELECT k, ts, id, event, n, 'Initial' AS was, CASE WHEN event = '{opens}' THEN 'Processing' ELSE 'Initial' END AS nxt, 0 AS version FROM ordered WHERE n = 1
  UNION ALL
  SELECT n.k, n.ts, n.id, n.event, n.n, w.nxt, CASE WHEN w.nxt = 'Initial' AND n.event = '{opens}' THEN 'Processing' {done} ELSE w.nxt END,
    CASE WHEN w.nxt = 'Processing' AND n.event IN ({touches}) THEN w.version + 1 WHEN w.nxt = 'Processing' AND n.event NOT IN ({", ".join(f"'{e}'" for e in finals.split())}) THEN w.version ELSE 0 END
  FROM walk w JOIN ordered n ON n.k = w.k AND n.n = w.n + 1
)"""


_EVENTS = "SELECT user_id AS k, ts, event_id AS id, event_type AS event FROM events"
_FLOW = _walk(_EVENTS, "purchase error")


@query(
    _FLOW
    + """
SELECT k AS user_id, arg_max(nxt, n) AS current_state, CAST(arg_max(version, n) AS INTEGER) AS version,
  CAST(count(*) FILTER (WHERE was = 'Processing' AND event = 'purchase') AS BIGINT) AS completed,
  CAST(count(*) FILTER (WHERE was = 'Processing' AND event = 'error') AS BIGINT) AS failed,
  CAST(count(*) FILTER (WHERE NOT ((was = 'Initial' AND event = 'signup') OR (was = 'Processing' AND event IN ('purchase', 'error', 'view')))) AS BIGINT) AS ignored
FROM walk GROUP BY k"""
)
def saga_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold(saga_events(spark, sf_dir), FLOW, DAY)
    return out.select(F.col("key").alias("user_id"), F.col("state").alias("current_state"), "version", F.col("ends.Completed").alias("completed"), F.col("ends.Failed").alias("failed"), "ignored")


@query(
    _FLOW
    + """
SELECT k AS user_id, id AS event_id, was AS from_state,
  CASE WHEN was = 'Initial' THEN 'Processing' WHEN event = 'purchase' THEN 'Completed' ELSE 'Failed' END AS to_state,
  CASE WHEN was = 'Initial' THEN 'ProcessingStarted' WHEN event = 'purchase' THEN 'FlowCompleted' ELSE 'FlowFailed' END AS emitted
FROM walk WHERE (was = 'Initial' AND event = 'signup') OR (was = 'Processing' AND event IN ('purchase', 'error'))"""
)
def saga_emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transitions(saga_events(spark, sf_dir), FLOW, DAY)
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "from_state", "to_state", F.explode("emitted").alias("emitted"))


@query(
    _FLOW
    + """
SELECT was AS state, event, CAST(count(*) AS BIGINT) AS messages FROM walk
WHERE NOT ((was = 'Initial' AND event = 'signup') OR (was = 'Processing' AND event IN ('purchase', 'error', 'view'))) GROUP BY was, event"""
)
def saga_unhandled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transitions(saga_events(spark, sf_dir), FLOW, DAY).where("NOT handled")
    return out.groupBy(F.col("from_state").alias("state"), "event").agg(F.count("*").alias("messages"))


@query(_FLOW + "\nSELECT k AS user_id, CAST(arg_max(version, n) AS INTEGER) AS version FROM walk GROUP BY k HAVING arg_max(nxt, n) = 'Processing'")
def saga_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(saga_events(spark, sf_dir), FLOW, DAY).where("state = 'Processing'").select(F.col("key").alias("user_id"), "version")


#: A purchase charges where a flow is open, and closes in any state: the step of the state first, then that of all states.
ANY = MachineBuilder().initially("signup", to="Processing", emit=("Started", "Welcomed")).during("Processing", "purchase", emit="Charged").during_any("purchase", to="Completed", emit="Closed", finalize=True).build()


@query(
    _walk(_EVENTS, "purchase", touches="''")
    + """
SELECT k AS user_id, id AS event_id, was AS from_state, e.emitted FROM walk JOIN (VALUES ('Initial', 'signup', 'Started'), ('Initial', 'signup', 'Welcomed'),
  ('Processing', 'purchase', 'Charged'), ('Processing', 'purchase', 'Closed'), ('Initial', 'purchase', 'Closed')) AS e(state, what, emitted) ON was = e.state AND event = e.what"""
)
def saga_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transitions(saga_events(spark, sf_dir), ANY, DAY)
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "from_state", F.explode("emitted").alias("emitted"))


#: Every signup that opens a saga schedules a timeout, which waits in a queue and comes whatever became of the saga.
@query(
    f"""
WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, id, event) AS n FROM ({_EVENTS}) s),
walk AS (
  SELECT k, CAST(0 AS BIGINT) AS n, 0 AS turn, 'Initial' AS state, CAST([] AS STRUCT(ts TIMESTAMP, id BIGINT, event VARCHAR)[]) AS waits, 0 AS done, 0 AS late FROM (SELECT DISTINCT k FROM ordered) x
  UNION ALL
  SELECT k, CASE WHEN fires THEN n ELSE n + 1 END, turn + 1,
    CASE WHEN fires THEN 'Initial' WHEN state = 'Initial' AND event = 'signup' THEN 'Processing' WHEN state = 'Processing' AND event = 'purchase' THEN 'Initial' ELSE state END,
    CASE WHEN fires THEN waits[2:] WHEN state = 'Initial' AND event = 'signup' THEN list_append(waits, {{'ts': ts + INTERVAL 1 HOUR, 'id': id, 'event': 'timeout'}}) ELSE waits END,
    done + CASE WHEN NOT fires AND state = 'Processing' AND event = 'purchase' THEN 1 ELSE 0 END, late + CASE WHEN fires AND state = 'Processing' THEN 1 ELSE 0 END
  FROM (
    SELECT w.*, o.ts, o.id, o.event, len(w.waits) > 0 AND (o.n IS NULL OR w.waits[1] < {{'ts': o.ts, 'id': o.id, 'event': o.event}}) AS fires
    FROM walk w LEFT JOIN ordered o ON o.k = w.k AND o.n = w.n + 1 WHERE o.n IS NOT NULL OR len(w.waits) > 0
  ) y
)
SELECT k AS user_id, arg_max(state, turn) AS current_state, CAST(max(done) AS BIGINT) AS completed, CAST(max(late) AS BIGINT) AS timed_out FROM walk GROUP BY k"""
)
def saga_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold(with_timeouts(saga_events(spark, sf_dir), TIMED), TIMED, DAY)
    return out.select(F.col("key").alias("user_id"), F.col("state").alias("current_state"), F.col("ends.Completed").alias("completed"), F.col("ends.TimedOut").alias("timed_out"))


@query("WITH m AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) SELECT conv_id, CAST(count(*) FILTER (WHERE before = 'user' AND role = 'assistant') AS BIGINT) AS answered, CAST(count(*) FILTER (WHERE before = 'user' AND role <> 'assistant') AS BIGINT) AS unanswered FROM m GROUP BY conv_id")
def saga_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events: a user's turn opens, the assistant's answers, anything else leaves it unanswered."""
    machine = MachineBuilder().initially("user", to="Asked").during("Asked", "assistant", to="Answered", finalize=True).during("Asked", "user", to="Asked", emit="Unanswered").during("Asked", "system", to="Dropped", emit="Unanswered", finalize=True).build()
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ts"), F.concat_ws("\u0001", "role", "text").alias("id"), F.col("role").alias("event"))
    out = transitions(turns, machine, "ts DIV 64")
    return out.groupBy(F.col("key").alias("conv_id")).agg(F.count(F.when((F.col("from_state") == "Asked") & (F.col("event") == "assistant"), 1)).alias("answered"), F.count(F.when(F.array_contains("emitted", "Unanswered"), 1)).alias("unanswered"))


# --- dispatch and settlement -----------------------------------------------------------------------------------------

_REG = "('main', 'click', 'ClickConsumer', 1), ('main', 'click', 'SecondClickConsumer', 2), ('main', 'purchase', 'PurchaseConsumer', 3), ('audit', 'error', 'ErrorConsumer', 1), ('main', 'signup', 'SignupConsumer', 4)"
_RAW = "('main', 'RawLogger'), ('audit', 'RawAudit'), ('audit', 'RawArchive')"
_ENDPOINT = "CASE WHEN user_id % 3 = 0 THEN 'audit' ELSE 'main' END"
_TYPE = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END"


def _inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id AS message_id", f"{_ENDPOINT} AS endpoint", f"{_TYPE} AS message_type", "CASE WHEN event_id % 13 = 0 THEN 'not json {{{' ELSE props END AS body", "user_id", "ts")


def _dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = _values(spark, _REG, "endpoint, message_type, consumer, position")
    return dispatch.fallback(dispatch.typed(_inbound(spark, sf_dir), reg), reg, _values(spark, _RAW, "endpoint, consumer"))


_DISPATCH = f"""
WITH m AS (SELECT event_id AS message_id, {_ENDPOINT} AS endpoint, {_TYPE} AS message_type, CASE WHEN event_id % 13 = 0 THEN 'not json {{{{{{' ELSE props END AS body FROM events),
reg(endpoint, message_type, consumer, position) AS (VALUES {_REG}), raw(endpoint, consumer) AS (VALUES {_RAW}),
f AS (SELECT endpoint, message_type, arg_min(consumer, position) AS consumer FROM reg GROUP BY 1, 2),
a AS (SELECT endpoint, arg_min(consumer, position) AS anyone FROM reg GROUP BY 1),
t AS (SELECT m.*, f.consumer, a.anyone FROM m LEFT JOIN f ON m.endpoint = f.endpoint AND m.message_type = f.message_type LEFT JOIN a ON a.endpoint = m.endpoint),
h AS (
  SELECT message_id, endpoint, consumer AS handler FROM t WHERE consumer IS NOT NULL
  UNION ALL SELECT message_id, endpoint, anyone FROM t WHERE consumer IS NULL AND message_type IS NULL AND body NOT LIKE 'not%' AND anyone IS NOT NULL
  UNION ALL SELECT t.message_id, t.endpoint, raw.consumer FROM t JOIN raw ON raw.endpoint = t.endpoint WHERE t.consumer IS NULL AND NOT (message_type IS NULL AND body NOT LIKE 'not%' AND anyone IS NOT NULL)
)"""


@query(_DISPATCH + "\nSELECT message_id, endpoint, message_type, consumer FROM t")
def dispatch_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.typed(_inbound(spark, sf_dir), _values(spark, _REG, "endpoint, message_type, consumer, position")).select("message_id", "endpoint", "message_type", "consumer")


@query(_DISPATCH + "\nSELECT message_id, endpoint, handler FROM h")
def dispatch_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispatched(spark, sf_dir).select("message_id", "endpoint", F.explode("handlers").alias("handler"))


_SETTLE = "CASE WHEN message_id % 97 = 0 THEN 'Requeue' WHEN message_id % 17 = 0 THEN 'Ack' WHEN endpoint = 'main' AND consumer IS NULL AND message_type IS NOT NULL THEN 'Reject' WHEN message_id % 7 = 0 THEN 'Nack' ELSE 'Ack' END"


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dispatch.typed(_inbound(spark, sf_dir), _values(spark, _REG, "endpoint, message_type, consumer, position"))
    handled = ~((F.col("endpoint") == "main") & F.col("consumer").isNull() & F.col("message_type").isNotNull())
    i = F.col("message_id")
    return rows.withColumn("action", dispatch.settlement(handled, i % 17 == 0, i % 7 == 0, i % 97 == 0))


@query(_DISPATCH + f"\nSELECT endpoint, action, CAST(count(*) AS BIGINT) AS messages FROM (SELECT endpoint, {_SETTLE} AS action FROM t) x GROUP BY 1, 2")
def settlement_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, sf_dir).groupBy("endpoint", "action").agg(F.count("*").alias("messages"))


@query(_DISPATCH + f"\nSELECT message_id, endpoint, action, endpoint = 'audit' AS lost FROM (SELECT *, {_SETTLE} AS action FROM t) x WHERE action IN ('Nack', 'Reject')")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    queues = _values(spark, "('main', 'main.dlx'), ('audit', '')", "endpoint, dead_letter_exchange")
    return dispatch.lost(_settled(spark, sf_dir), queues).select("message_id", "endpoint", "action", "lost")


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN false ELSE value > 5 END AS is_valid, CASE WHEN event_id % 9 = 0 THEN 'id is blank' WHEN NOT value > 5 THEN 'amount must be positive' END AS reason FROM events")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    checked = dispatch.valid_order(F.when(F.col("event_id") % 9 == 0, F.lit("  ")).otherwise(F.col("event_id").cast("string")), F.col("value") - 5)
    return e.select("event_id", checked.alias("v")).select("event_id", "v.*")


# --- routing ---------------------------------------------------------------------------------------------------------

_PUBLISHED = "SELECT event_id AS message_id, CASE event_id % 3 WHEN 0 THEN 'direct.x' WHEN 1 THEN 'fan.x' ELSE 'topic.x' END AS exchange, concat('shop.', event_type, CASE WHEN user_id % 2 = 0 THEN '.eu' ELSE '' END) AS routing_key FROM events"
_EXCHANGES = "('direct.x', 'direct'), ('fan.x', 'fanout'), ('topic.x', 'topic')"
_BINDINGS = "('direct.x', 'clicks', 'shop.click'), ('direct.x', 'clicks', 'shop.click'), ('direct.x', 'errors', 'shop.error.eu'), ('fan.x', 'mail', ''), ('fan.x', 'audit', ''), ('topic.x', 'eu', '#.eu'), ('topic.x', 'all', '#'), ('topic.x', 'shop2', 'shop.*'), ('topic.x', 'buy', 'shop.purchase.#'), ('topic.x', 'all', 'shop.#')"


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.selectExpr("event_id AS message_id", "CASE event_id % 3 WHEN 0 THEN 'direct.x' WHEN 1 THEN 'fan.x' ELSE 'topic.x' END AS exchange", "concat('shop.', event_type, CASE WHEN user_id % 2 = 0 THEN '.eu' ELSE '' END) AS routing_key")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(_published(spark, sf_dir), _values(spark, _EXCHANGES, "name, type"), _values(spark, _BINDINGS, "exchange, queue, binding_key"))


_ROUTES = f"""
WITH m AS ({_PUBLISHED}),
b(exchange, queue, binding_key, pattern) AS (VALUES ('direct.x', 'clicks', 'shop.click', '^shop\\.click$'), ('direct.x', 'errors', 'shop.error.eu', '^shop\\.error\\.eu$'), ('fan.x', 'mail', '', '.*'), ('fan.x', 'audit', '', '.*'), ('topic.x', 'eu', '#.eu', '(^|\\.)eu$'), ('topic.x', 'all', '#', '.*'), ('topic.x', 'shop2', 'shop.*', '^shop\\.[^.]+$'), ('topic.x', 'buy', 'shop.purchase.#', '^shop\\.purchase(\\.|$)')),
r AS (SELECT DISTINCT message_id, m.exchange, queue FROM m JOIN b ON m.exchange = b.exchange AND regexp_matches(routing_key, pattern))"""


@query(_ROUTES + "\nSELECT message_id, queue FROM r WHERE exchange = 'direct.x'")
def route_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).where("exchange = 'direct.x'").select("message_id", "queue")


@query(_ROUTES + "\nSELECT message_id, queue FROM r WHERE exchange = 'fan.x'")
def route_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).where("exchange = 'fan.x'").select("message_id", "queue")


@query(_ROUTES + "\nSELECT message_id, queue FROM r WHERE exchange = 'topic.x'")
def route_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).where("exchange = 'topic.x'").select("message_id", "queue")


_EDGES = "('direct.x', 'mid.x'), ('mid.x', 'end.x'), ('fan.x', 'end.x'), ('end.x', 'mid.x')"


@query(f"""
WITH RECURSIVE e(source, destination) AS (VALUES {_EDGES}), m AS ({_PUBLISHED}),
reach AS (SELECT source AS a, source AS b FROM e UNION SELECT destination, destination FROM e UNION SELECT reach.a, e.destination FROM reach JOIN e ON e.source = reach.b)
SELECT coalesce(reach.b, m.exchange) AS exchange, CAST(count(*) AS BIGINT) AS messages FROM m LEFT JOIN reach ON reach.a = m.exchange GROUP BY 1""")
def route_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.through_exchanges(_published(spark, sf_dir), _values(spark, _EDGES, "source, destination")).groupBy("exchange").agg(F.count("*").alias("messages"))


@query("""
SELECT event_id AS message_id, CASE WHEN event_id % 5 = 0 THEN 'override.x' WHEN event_type IN ('click', 'view') THEN 'web.x' WHEN event_type = 'purchase' THEN 'shop.x' ELSE 'default.x' END AS exchange,
  CASE event_type WHEN 'click' THEN 'web.click' WHEN 'purchase' THEN 'shop.buy' ELSE concat('driftwood.', event_type) END AS routing_key FROM events""")
def publish_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "events").selectExpr("event_id AS message_id", "event_type AS message_type", "CASE WHEN event_id % 5 = 0 THEN 'override.x' END AS header_exchange")
    xs, ks = _values(spark, "('click', 'web.x'), ('view', 'web.x'), ('purchase', 'shop.x')", "message_type, exchange"), _values(spark, "('click', 'web.click'), ('purchase', 'shop.buy')", "message_type, routing_key")
    return routing.publish(m, xs, ks, "default.x").select("message_id", "exchange", "routing_key")


@query("SELECT DISTINCT event_type AS message_type, concat(event_type, '.x') AS exchange FROM events WHERE event_type NOT IN ('click', 'view')")
def publish_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = read(spark, sf_dir, "events").selectExpr("event_type AS message_type", "IF(event_type IN ('click', 'view'), 'topic.x', concat(event_type, '.x')) AS exchange").distinct()
    return routing.undeclared(mapped, _values(spark, _EXCHANGES, "name, type"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN concat('ex', o_custkey) ELSE '' END AS exchange,
  CASE o_orderkey % 3 WHEN 0 THEN concat('orders-', o_custkey) WHEN 1 THEN '' ELSE concat('amq/q', o_custkey) END AS routing_key,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('c ', o_orderkey) END AS correlation_id FROM orders""")
def send_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat('queue:orders-', o_custkey, '?correlation-id=c%20', o_orderkey) WHEN 1 THEN concat('exchange:ex', o_custkey) ELSE concat('rabbit://host:5672/amq/q', o_custkey) END")
    return read(spark, sf_dir, "orders").select("o_orderkey", routing.address(uri).alias("a")).select("o_orderkey", "a.*")


@query("SELECT user_id, batch, CAST(count(*) AS BIGINT) AS messages, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 16) AS BIGINT) AS batch FROM events) x GROUP BY 1, 2")
def publish_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = routing.batches(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], DAY, 16)
    return out.groupBy("user_id", "batch").agg(F.count("*").alias("messages"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'publish' ELSE 'send' END AS mode, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('reply-', user_id) END AS target FROM events")
def respond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.reply_to(read(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('reply-', user_id) END AS reply_to")).select("event_id", "mode", "target")


# --- codecs, ids and headers -----------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 10 = 0 THEN 'oops {' END AS error FROM events")
def codec_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("CASE WHEN event_id % 10 = 0 THEN 'oops {' ELSE props END")
    out = read(spark, sf_dir, "events").select("event_id", body.alias("body")).withColumn("x", codec.decode(F.col("body"), "k bigint"))
    return out.select("event_id", "x.k", F.when(F.col("x").isNull(), codec.excerpt(F.col("body"))).alias("error"))


@query("""SELECT event_id, concat('{"eventId":', event_id, ',"eventType":"', event_type, CASE WHEN event_id % 2 = 0 THEN concat('","userId":', user_id, '}') ELSE '"}' END) AS json FROM events""")
def codec_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", codec.to_message_json(event_id=F.col("event_id"), event_type=F.col("event_type"), user_id=F.when(F.col("event_id") % 2 == 0, F.col("user_id"))).alias("json"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS message_id, concat('urn:message:driftwood:', event_type) AS urn, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def codec_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    whole = codec.envelope(F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type"), F.col("ts"), F.col("props"))
    out = e.select("event_id", whole.alias("json"))
    return out.select("event_id", codec.envelope_field(F.col("json"), "messageId").alias("message_id"), F.get_json_object("json", "$.messageType[0]").alias("urn"), codec.decode(codec.envelope_field(F.col("json"), "body"), "k bigint")["k"].alias("k"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'application/vnd.driftwood+json' WHEN 1 THEN 'application/vnd.masstransit+json' ELSE 'application/json' END AS decoder FROM events")
def codec_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE event_id % 4 WHEN 0 THEN 'Application/VND.driftwood+json; charset=utf-8' WHEN 1 THEN 'application/vnd.masstransit+json' WHEN 2 THEN 'text/odd' END")
    return read(spark, sf_dir, "events").select("event_id", codec.decoder_for(kind).alias("decoder"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('0a0b0c0d-0000-0000-0000-', lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) ELSE
  concat(substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2), '-', substr(h, 11, 2), substr(h, 9, 2), '-', substr(h, 15, 2), substr(h, 13, 2), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) END AS id
FROM (SELECT o_orderkey, sha256(concat('order-', o_orderkey)) AS h FROM orders) x""")
def id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN concat('{0A0B0C0D-0000-0000-0000-', lpad(o_orderkey, 12, '0'), '}') ELSE concat('order-', o_orderkey) END")
    return read(spark, sf_dir, "orders").select("o_orderkey", codec.normal_id(text).alias("id"))


@query("""
SELECT event_id, k AS name, v AS value FROM (
  SELECT event_id, 'message-id' AS k, CAST(event_id AS VARCHAR) AS v FROM events
  UNION ALL SELECT event_id, 'correlation-id', CAST(user_id AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'traceparent', concat('00-', repeat('ab', 16), '-', lpad(CAST(event_id AS VARCHAR), 16, '0'), '-01') FROM events
) x""")
def headers_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = F.expr("map('message-id', CAST(event_id AS STRING), 'X-Corr', CAST(user_id AS STRING), 'content-type', '', 'TraceParent', concat('00-', repeat('AB', 16), '-', lpad(event_id, 16, '0'), '-01'), 'x-other', 'y')")
    got = headers.inbound(wire, {"x-corr": "correlation-id"}, keep_unmapped=False)
    return read(spark, sf_dir, "events").select("event_id", F.explode(got).alias("name", "value"))


@query("""
SELECT event_id, k AS name, v AS value FROM (
  SELECT event_id, 'type' AS k, event_type AS v FROM events
  UNION ALL SELECT event_id, 'message-id', CAST(event_id AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'X-Corr', CAST(user_id AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'custom', 'y' FROM events
) x""")
def headers_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    caller = F.expr("map('correlation-id', CAST(user_id AS STRING), 'dw-MessageType', 'forged', 'dw-Internal', 'z', 'custom', 'y')")
    got = headers.outbound(headers.merged(caller, F.col("event_type"), F.col("event_id").cast("string")), {"correlation-id": "X-Corr"})
    return read(spark, sf_dir, "events").select("event_id", F.explode(got).alias("name", "value"))


# --- inbox and outbox ------------------------------------------------------------------------------------------------

_DELIVERIES = """
SELECT event_id AS message_id, event_type AS consumer, ts AS arrived, event_id * 10 AS delivery, event_id % 4 <> 0 AS succeeds FROM events
UNION ALL SELECT event_id, event_type, ts + INTERVAL 10 SECOND, event_id * 10 + 1, true FROM events WHERE event_id % 10 = 0
UNION ALL SELECT event_id, event_type, ts + INTERVAL 30 SECOND, event_id * 10 + 2, true FROM events WHERE event_id % 15 = 0
UNION ALL SELECT event_id, event_type, ts + INTERVAL 40 SECOND, event_id * 10 + 3, true FROM events WHERE event_id % 15 = 0"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, and some again after 10, 30 and 40 seconds; a quarter of the first attempts fail."""
    again = F.expr("filter(array(struct(0 AS s, 0 AS n), IF(event_id % 10 = 0, struct(10 AS s, 1 AS n), NULL), IF(event_id % 15 = 0, struct(30 AS s, 2 AS n), NULL), IF(event_id % 15 = 0, struct(40 AS s, 3 AS n), NULL)), x -> x IS NOT NULL)")
    rows = read(spark, sf_dir, "events").withColumn("x", F.explode(again))
    return rows.select(F.col("event_id").alias("message_id"), F.col("event_type").alias("consumer"), F.expr("ts + make_dt_interval(0, 0, 0, x.s)").alias("arrived"), (F.col("event_id") * 10 + F.col("x.n")).alias("delivery"), ((F.col("x.n") > 0) | (F.col("event_id") % 4 != 0)).alias("succeeds"))


@query(f"SELECT message_id, consumer, min(delivery) AS delivery FROM ({_DELIVERIES}) d GROUP BY 1, 2")
def inbox_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.first_deliveries(deliveries(spark, sf_dir)).select("message_id", "consumer", "delivery")


@query(f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY message_id, consumer ORDER BY arrived, delivery) AS n FROM ({_DELIVERIES}) d),
w AS (
  SELECT message_id, consumer, delivery, n, succeeds AS done, arrived + INTERVAL 30 SECOND AS until, CASE WHEN succeeds THEN 'processed' ELSE 'failed' END AS outcome FROM o WHERE n = 1
  UNION ALL
  SELECT o.message_id, o.consumer, o.delivery, o.n, w.done OR (NOT w.done AND w.until < o.arrived AND o.succeeds),
    CASE WHEN NOT w.done AND w.until < o.arrived THEN o.arrived + INTERVAL 30 SECOND ELSE w.until END,
    CASE WHEN w.done OR w.until >= o.arrived THEN 'filtered' WHEN o.succeeds THEN 'processed' ELSE 'failed' END
  FROM w JOIN o ON o.message_id = w.message_id AND o.consumer = w.consumer AND o.n = w.n + 1
)
SELECT message_id, consumer, delivery, outcome FROM w""")
def inbox_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.lock(deliveries(spark, sf_dir), 30).select("message_id", "consumer", "delivery", "outcome")


_LAST = "(SELECT max(ts) FROM events)"


@query(f"SELECT event_id AS message_id FROM events WHERE ts + INTERVAL 30 SECOND >= {_LAST} - INTERVAL 1 DAY")
def inbox_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    inbox = e.select(F.col("event_id").alias("message_id"), F.expr("ts + make_dt_interval(0, 0, 0, 30)").alias("expires_at"))
    return stores.inbox_kept(inbox, F.lit(e.agg(F.max("ts")).first()[0]), 86_400).select("message_id")


_OUTBOX = "SELECT event_id AS id, event_type AS destination, ts AS created_at, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 5 SECOND END AS delivered_at FROM events"


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("destination"), F.col("ts").alias("created_at"), F.expr("CASE WHEN event_id % 3 <> 0 THEN ts + make_dt_interval(0, 0, 0, 5) END").alias("delivered_at"))


@query(f"SELECT id, destination FROM ({_OUTBOX}) o WHERE delivered_at IS NULL ORDER BY id LIMIT 100")
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.pending(outbox(spark, sf_dir), 100).select("id", "destination")


@query(f"SELECT id, CASE WHEN delivered_at IS NULL AND id % 2 = 0 THEN TIMESTAMP '2030-01-01 00:00:00' ELSE delivered_at END AS delivered_at FROM ({_OUTBOX}) o")
def outbox_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outbox(spark, sf_dir)
    sent = o.where("delivered_at IS NULL").select("id", (F.col("id") % 2 == 0).alias("is_confirmed"))
    return stores.mark_delivered(o, sent.where("is_confirmed"), F.expr("TIMESTAMP_NTZ '2030-01-01 00:00:00'")).select("id", "delivered_at")


@query(f"SELECT id FROM ({_OUTBOX}) o WHERE delivered_at IS NULL OR delivered_at >= {_LAST} - INTERVAL 2 DAY")
def outbox_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return stores.outbox_kept(outbox(spark, sf_dir), F.lit(now), 2 * 86_400).select("id")


@query(f"SELECT destination, CAST(count(*) AS BIGINT) AS waiting FROM ({_OUTBOX}) o WHERE delivered_at IS NULL GROUP BY 1")
def outbox_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox(spark, sf_dir).where("delivered_at IS NULL").groupBy("destination").agg(F.count("*").alias("waiting"))


@query("SELECT id, count(*) = 1 AS known_once, CAST(max(CASE WHEN source = 'old' THEN 1 ELSE 0 END) AS INTEGER) AS was_there FROM (SELECT event_id AS id, 'old' AS source FROM events UNION ALL SELECT event_id * 2, 'new' FROM events WHERE event_id * 2 NOT IN (SELECT event_id FROM events)) x GROUP BY 1")
def outbox_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows whose ids are twice the old ones: those that are there already are passed over."""
    o = outbox(spark, sf_dir)
    both = stores.append(o.withColumn("old", F.lit(1)), o.drop("delivered_at").withColumns({"id": F.col("id") * 2, "old": F.lit(0)}))
    return both.groupBy("id").agg((F.count("*") == 1).alias("known_once"), F.max("old").alias("was_there"))


@query("SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id) AS version FROM events GROUP BY 1")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.last_of_key(read(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select("user_id", F.col("event_type").alias("state"), F.col("event_id").alias("version"))


_REQ = "SELECT o_orderkey AS request_id, o_orderdate AS sent FROM orders"
_RESP = "SELECT l_orderkey AS correlation_id, l_shipdate AS replied, l_linenumber AS reply FROM lineitem"


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey AS request_id", "o_orderdate AS sent"), read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS correlation_id", "l_shipdate AS replied", "l_linenumber AS reply")


@query(f"""
SELECT request_id, arg_min(replied, (replied, reply)) AS replied, CAST(arg_min(reply, (replied, reply)) AS INTEGER) AS reply FROM
(SELECT q.request_id, r.replied, r.reply FROM ({_REQ}) q LEFT JOIN ({_RESP}) r ON r.correlation_id = q.request_id AND r.replied >= q.sent AND r.replied <= q.sent + INTERVAL 90 DAY) x GROUP BY 1""")
def reqrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.request_response(*_requests(spark, sf_dir), 90 * 86_400).select("request_id", "replied", "reply")


@query("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS replies FROM lineitem l WHERE l_returnflag = 'R' OR NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l.l_orderkey) GROUP BY 1")
def reqrep_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of returned lines have lost their correlation id; others may answer orders that were never placed."""
    q, _ = _requests(spark, sf_dir)
    r = read(spark, sf_dir, "lineitem").selectExpr("IF(l_returnflag = 'R', NULL, l_orderkey) AS correlation_id", "l_orderkey")
    return stores.orphans(q, r).groupBy("l_orderkey").agg(F.count("*").alias("replies"))


# --- retries, queues, flow -------------------------------------------------------------------------------------------


@query("""
SELECT event_id, CAST(attempt AS INTEGER) AS attempt, CAST(250 AS BIGINT) AS interval_ms, CAST(greatest(0, 1000 - 300 * attempt) AS BIGINT) AS incremental_ms,
  CAST(least(5000, 100 * pow(2, attempt)) AS BIGINT) AS exponential_ms FROM events CROSS JOIN range(1, 6) AS r(attempt) WHERE event_type = 'error'""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attempt")
    rows = limits.attempts(read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id"), 5)
    return rows.select("event_id", "attempt", limits.interval_delay(a, 250).alias("interval_ms"), limits.incremental_delay(a, 1000, -300).alias("incremental_ms"), limits.exponential_delay(a, 100, 5000).alias("exponential_ms"))


@query("SELECT event_id, event_type IN ('click', 'error') AND event_type <> 'click' AND event_id % 5 < 3 AS again FROM events")
def retry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", limits.retryable(F.col("event_type"), F.col("event_id") % 5, 3, ["click", "error"], ["click"]).alias("again"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n <= 10")
def queue_drop_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.keep_newest(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) x WHERE n <= 10")
def queue_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.keep_oldest(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id")


@query("SELECT user_id, event_id, bytes_so_far FROM (SELECT user_id, event_id, CAST(sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes_so_far FROM events) x WHERE bytes_so_far <= 200")
def queue_max_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.keep_bytes(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.octet_length("props"), 200, DAY).select("user_id", "event_id", "bytes_so_far")


@query("SELECT event_id, ts + INTERVAL 60 SECOND < ts + to_seconds(event_id % 120) AS expired FROM events")
def queue_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", limits.expired(F.col("ts"), 60_000, F.expr("ts + make_dt_interval(0, 0, 0, event_id % 120)")).alias("expired"))


@query("SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS keys, CAST(count(*) AS BIGINT) AS messages, CAST(0 AS BIGINT) AS split_keys FROM events")
def partition_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = limits.lanes(read(spark, sf_dir, "events"), "user_id", 16)
    by_key = dealt.groupBy("user_id").agg(F.count("*").alias("n"), F.min("lane").alias("lo"), F.max("lane").alias("hi"))
    return by_key.agg(F.count("*").alias("keys"), F.sum("n").alias("messages"), F.count(F.when(F.col("lo") != F.col("hi"), 1)).alias("split_keys"))


_FLIGHT = """
WITH b AS (SELECT event_type AS endpoint, ts, event_id AS id, 1 AS delta FROM events UNION ALL SELECT event_type, ts + to_seconds(300 + event_id % 600), event_id, -1 FROM events),
f AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY endpoint ORDER BY ts, delta, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_flight FROM b)"""


def _flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), "ts", F.col("event_id").alias("id"))
    return limits.in_flight(e, e.withColumn("ts", F.expr("ts + make_dt_interval(0, 0, 0, 300 + id % 600)")), DAY)


@query(_FLIGHT + "\nSELECT endpoint, id, CAST(delta AS INTEGER) AS delta, in_flight FROM f")
def flow_inflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flight(spark, sf_dir).select("endpoint", "id", "delta", "in_flight")


@query(_FLIGHT + "\nSELECT endpoint, CASE max(CASE WHEN in_flight >= 4 THEN 2 WHEN in_flight / 4.0 >= 0.9 THEN 1 ELSE 0 END) WHEN 2 THEN 'Unhealthy' WHEN 1 THEN 'Degraded' ELSE 'Healthy' END AS status FROM f GROUP BY 1")
def flow_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _flight(spark, sf_dir)
    return limits.worst(now.select("endpoint", limits.health(F.col("in_flight"), F.lit(0), 4, 1).alias("status")), ["endpoint"])


@query(_FLIGHT + "\nSELECT endpoint, id, CAST(greatest(0, least(2, 3 - in_flight)) AS BIGINT) AS credits FROM f WHERE delta = 1")
def flow_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flight(spark, sf_dir).where("delta = 1").select("endpoint", "id", limits.granted(F.lit(2).cast("long"), F.col("in_flight"), 3).alias("credits"))


@query("WITH p AS (SELECT event_id, CAST(sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b FROM events) SELECT event_id, b < 500 AS accepts, b / 500.0 >= 0.9 AS alert FROM p")
def flow_back_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = running_sum(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.octet_length("props").cast("long"), DAY, "b")
    return rows.select("event_id", limits.back_pressure(F.lit(0), F.col("b"), 100, 500).alias("x")).select("event_id", "x.*")


# --- metrics, traces, slips ------------------------------------------------------------------------------------------


@query(_DISPATCH + f"\nSELECT endpoint, message_type, action AS outcome, CAST(count(*) AS BIGINT) AS messages FROM (SELECT endpoint, message_type, {_SETTLE} AS action FROM t) x GROUP BY 1, 2, 3")
def metrics_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(_settled(spark, sf_dir).withColumnRenamed("action", "outcome"))


@query("SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most, CAST(count(*) FILTER (WHERE value <= 5) AS BIGINT) AS le_5, CAST(count(*) FILTER (WHERE value <= 20) AS BIGINT) AS le_20 FROM events GROUP BY 1")
def metrics_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(read(spark, sf_dir, "events"), ["event_type"], F.col("value"), [5, 20]).withColumn("total", F.round("total", 2))


@query("SELECT s.event_id AS span, p.event_type AS parent_name FROM events s LEFT JOIN events p ON p.event_id = s.event_id - s.event_id % 5 AND s.event_id % 5 <> 0")
def trace_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    head = F.expr("map('traceparent', concat('00-', lpad('1', 32, '0'), '-', lpad(event_id - event_id % 5, 16, '0'), '-01'))")
    spans = e.select("event_id", headers.trace(head).alias("t"), F.expr("lpad(event_id, 16, '0')").alias("span_id"), F.col("event_type").alias("name"))
    tree = spans.select("event_id", "t.trace_id", "span_id", F.when(F.col("t.span_id") != F.col("span_id"), F.col("t.span_id")).alias("parent_id"), "name")
    return metrics.parents(tree).select(F.col("event_id").alias("span"), "parent_name")


@query("""
SELECT o_orderkey AS slip_id, CASE WHEN o_orderkey % 5 < 4 THEN 'Faulted' ELSE 'Completed' END AS outcome,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'reserve' WHEN 2 THEN 'reserve,charge' WHEN 3 THEN 'reserve,charge,ship' ELSE 'reserve,charge,ship,notify' END AS log,
  CASE o_orderkey % 5 WHEN 1 THEN 'reserve' WHEN 2 THEN 'charge,reserve' WHEN 3 THEN 'ship,charge,reserve' ELSE '' END AS compensated FROM orders""")
def routing_slip(spark: SparkSession, sf_dir: str) -> DataFrame:
    slips = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS slip_id", "array('reserve', 'charge', 'ship', 'notify') AS steps", "CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderkey % 5 AS INT) END AS failing")
    return slip.run(slips).select("slip_id", "outcome", F.array_join("log", ",").alias("log"), F.array_join("compensated", ",").alias("compensated"))


@query("SELECT event_type AS message_type, CAST(count(*) AS BIGINT) AS messages, round(sum(value), 2) AS amount FROM events WHERE value BETWEEN 2 AND 40 AND event_type IN ('click', 'purchase', 'signup') GROUP BY 1")
def consume_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(read(spark, sf_dir, "events")).where(F.col("amount").between(2, 40) & F.col("message_type").isin("click", "purchase", "signup"))
    return m.groupBy("message_type").agg(F.count("*").alias("messages"), F.round(F.sum("amount"), 2).alias("amount"))
