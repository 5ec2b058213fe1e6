"""Literal cases, and a random check of the sliced fold against a plain reducer."""

import random
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwood.functions import codec, headers
from driftwood.operators import dispatch, limits, routing, slip, stores
from driftwood.operators.saga import INITIAL, MachineBuilder, Then, carried, fold, transitions, with_timeouts
from driftwood.plans.catalog import FLOW, TIMED
from driftwood.sources.queues import deliver, stream, upsert_sink
from driftwood.streaming import twins

T0 = datetime(2024, 1, 1)


def reduce(machine, events):
    state, version, ends = INITIAL, 0, {}
    for _, _, e in sorted(events):
        step = machine.table().get((state, e))
        if step is None:
            continue
        to = step.to or state
        version = 0 if step.finalize or state == INITIAL else version + 1
        if step.finalize:
            ends[to] = ends.get(to, 0) + 1
        state = INITIAL if step.finalize else to
    return state, version, ends


@pytest.mark.parametrize("slices", ["date_trunc('hour', ts)", "date_trunc('day', ts)", "date_trunc('year', ts)"])
def test_sliced_fold_is_the_plain_fold(spark, slices):
    rng = random.Random(7)
    rows = [(k % 5 if k % 3 else 0, T0 + timedelta(minutes=rng.randrange(3000)), k, rng.choice(["signup", "view", "purchase", "error", "click"])) for k in range(600)]
    got = fold(spark.createDataFrame(rows, "key long, ts timestamp_ntz, id long, event string"), FLOW, slices).collect()
    for r in got:
        state, version, ends = reduce(FLOW, [x[1:] for x in rows if x[0] == r.key])
        assert (r.state, r.version) == (state, version)
        assert (r.ends.Completed, r.ends.Failed) == (ends.get("Completed", 0), ends.get("Failed", 0))


def test_saga_restarts_after_its_end_and_ignores_what_it_does_not_know(spark):
    rows = [(1, T0 + timedelta(seconds=i), i, e) for i, e in enumerate(["purchase", "signup", "view", "purchase", "view", "signup"])]
    out = {r.id: r for r in transitions(spark.createDataFrame(rows, "key long, ts timestamp_ntz, id long, event string"), FLOW, "date_trunc('minute', ts)").collect()}
    assert [out[i].handled for i in range(6)] == [False, True, True, True, False, True]
    assert (out[3].to_state, out[3].finalized, out[5].from_state) == ("Completed", True, "Initial")


def test_during_any_holds_in_every_state(spark):
    machine = MachineBuilder().initially("a", to="X").during("X", "b", to="Y").during_any("stop", to="Stopped", finalize=True).build()
    rows = [(k, T0 + timedelta(seconds=i), i, e) for k, es in enumerate([["a", "stop"], ["a", "b", "stop"], ["stop"]]) for i, e in enumerate(es)]
    got = fold(spark.createDataFrame(rows, "key long, ts timestamp_ntz, id long, event string"), machine, "date_trunc('day', ts)").collect()
    assert all(r.state == INITIAL and r.ends.Stopped == 1 for r in got)


def test_during_any_comes_after_a_states_own_step(spark):
    machine = MachineBuilder().initially("a", to="X", emit=("One", "Two")).during("X", "stop", to="Y", emit="Own").during_any("stop", emit="Any", to="Z").build()
    rows = [(1, T0, 0, "a"), (1, T0 + timedelta(seconds=1), 1, "stop")]
    out = {r.id: r for r in transitions(spark.createDataFrame(rows, "key long, ts timestamp_ntz, id long, event string"), machine, "date_trunc('day', ts)").collect()}
    assert (out[0].emitted, out[1].emitted, out[1].to_state) == (["One", "Two"], ["Own", "Any"], "Z")


def timed(rows):
    """(state, ends) of one key, step by step, with a queue of timeouts."""
    state, waits, ends, events, table = INITIAL, [], {}, sorted((ts, i, e) for _, ts, i, e in rows), TIMED.table()
    while events or waits:
        late = waits and (not events or waits[0] < events[0])
        ts, i, e = waits.pop(0) if late else events.pop(0)
        step = table.get((state, e))
        if step:
            waits = sorted([*waits, *((ts + timedelta(milliseconds=d), i, "timeout") for d in step.delays)])
            if step.finalize:
                ends[step.to] = ends.get(step.to, 0) + 1
            state = INITIAL if step.finalize else step.to or state
    return state, ends


def test_timeouts_are_events_of_the_machine(spark):
    rng = random.Random(8)
    rows = [(0, T0, 0, "signup"), (0, T0 + timedelta(hours=2), 1, "signup"), (0, T0 + timedelta(hours=3, minutes=30), 2, "purchase")]
    rows += [(k, T0 + timedelta(minutes=rng.randrange(0, 600, 10)), 100 * k + i, rng.choice(["signup", "view", "purchase"])) for k in range(1, 40) for i in range(rng.randrange(1, 30))]
    events = spark.createDataFrame(rows, "key long, ts timestamp_ntz, id long, event string")
    got = {r.key: r for r in fold(with_timeouts(events, TIMED), TIMED, "date_trunc('hour', ts)").collect()}
    assert (got[0].ends.TimedOut, got[0].ends.Completed) == (2, 0)
    for k, r in got.items():
        state, ends = timed([x for x in rows if x[0] == k])
        assert (r.state, r.ends.TimedOut, r.ends.Completed) == (state, ends.get("TimedOut", 0), ends.get("Completed", 0))
    assert with_timeouts(events.limit(0), TIMED).count() == 0


def test_raw_messages_and_redeliveries_are_routed(spark):
    none = spark.createDataFrame([], "message_type string, exchange string, routing_key string")
    raw = spark.sql("SELECT 1L AS message_id, CAST(NULL AS STRING) AS message_type, 'x' AS header_exchange")
    assert routing.publish(raw, none, none).first().routing_key == ""
    exchanges, bindings = spark.sql("SELECT 'x' AS name, 'topic' AS type"), spark.sql("SELECT 'x' AS exchange, 'q' AS queue, explode(array('a.*', '#')) AS binding_key")
    twice = spark.sql("SELECT 7L AS message_id, 'x' AS exchange, 'a.b' AS routing_key FROM range(2)")
    assert routing.route(twice, exchanges, bindings).count() == 2


def test_ten_interleaved_sagas_all_finish(spark):
    machine = MachineBuilder().initially("Created", to="Processing").during("Processing", "Paid", to="Done", finalize=True).build()
    rows = [(k, T0 + timedelta(seconds=k), k, "Created") for k in range(10)] + [(k, T0 + timedelta(seconds=100 - k), 10 + k, "Paid") for k in range(10)]
    got = fold(spark.createDataFrame(rows, "key long, ts timestamp_ntz, id long, event string"), machine, "date_trunc('minute', ts)").collect()
    assert len(got) == 10 and all(r.state == INITIAL and r.ends.Done == 1 for r in got)


def test_batch_and_stream_agree(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k % 7, T0 + timedelta(minutes=k), k, rng.choice(["signup", "view", "purchase", "error"])) for k in range(300)]
    df = spark.createDataFrame(rows, "key long, ts timestamp, id long, event string")
    for part in range(3):
        deliver(df.where(f"id DIV 100 = {part}").coalesce(1), str(tmp_path / "queue"))
    twins.state_in_rocksdb(spark)
    out = twins.run_to_end(twins.saga_stream(stream(spark, str(tmp_path / "queue"), df.schema, 1), FLOW), str(tmp_path / "run"))
    want = transitions(df, FLOW, "date_trunc('hour', ts)").where("handled")
    pick = ["key", "id", "from_state", "to_state", "finalized"]
    assert sorted(map(tuple, out.select(pick).collect())) == sorted(map(tuple, want.select(pick).collect()))


def test_upsert_sink_replaces_a_batch(spark, tmp_path):
    sink = upsert_sink(str(tmp_path), "id")
    for _ in range(2):
        sink(spark.range(3), 7)
    assert spark.read.parquet(str(tmp_path)).count() == 3


def matches(pattern, key):
    def at(p, k):
        if not p:
            return not k
        if p[0] == "#":
            return any(at(p[1:], k[i:]) for i in range(len(k) + 1))
        return bool(k) and (p[0] == "*" or p[0] == k[0]) and at(p[1:], k[1:])

    return at(pattern.split("."), key.split("."))


@given(st.lists(st.sampled_from(["a", "b", "c", "z"]), min_size=1, max_size=5), st.lists(st.sampled_from(["a", "b", "*", "#", "z"]), min_size=1, max_size=4))
def test_topic_patterns(key, pattern):
    key, pattern = ".".join(key), ".".join(pattern)
    assert bool(re.match(routing.topic_regex(pattern), "." + key)) == matches(pattern, key)


def test_guid_of_other_text(spark):
    got = spark.range(1).select(codec.normal_id(F.lit("order-1")), codec.normal_id(F.lit("{0A0B0C0D-0000-0000-0000-000000000001}"))).first()
    assert tuple(got) == ("21e2af0b-d256-8c69-143b-86040446d366", "0a0b0c0d-0000-0000-0000-000000000001")


def test_decoding(spark):
    rows = spark.createDataFrame([("",), (None,), ("not valid json {{{{",), ('{"name":null,"value":0}',), ("null",), ("[1]",)], "b string")
    got = [r[0] for r in rows.select(codec.decode(F.col("b"), "name string, value int")).collect()]
    assert got[:3] == [None] * 3 and got[3].value == 0 and got[4:] == [None, None]


def test_large_payloads_survive(spark):
    for n in (256_000, 512_000, 1_048_576):
        text = spark.range(1).select(codec.to_message_json(payload=F.repeat(F.lit("x"), n)).alias("j")).select(codec.decode(F.col("j"), "payload string")["payload"]).first()[0]
        assert text == "x" * n


def test_bad_traceparent_is_null(spark):
    got = spark.range(1).select(headers.trace(F.create_map(F.lit("traceparent"), F.lit("00-xyz")))).first()[0]
    assert got is None


def test_inbox_lock_edges(spark):
    rows = [(1, "c", T0, 1, False), (1, "c", T0 + timedelta(seconds=30), 2, True), (1, "c", T0 + timedelta(seconds=31), 3, True), (1, "c", T0 + timedelta(seconds=500), 4, True), (1, "d", T0, 5, True)]
    got = {r.delivery: r.outcome for r in stores.lock(spark.createDataFrame(rows, "message_id long, consumer string, arrived timestamp_ntz, delivery long, succeeds boolean"), 30).collect()}
    assert got == {1: "failed", 2: "filtered", 3: "processed", 4: "filtered", 5: "processed"}


def test_only_confirmed_rows_are_marked(spark):
    box = spark.createDataFrame([(1, None), (2, None), (3, T0)], "id long, delivered_at timestamp_ntz")
    got = {r.id: r.delivered_at for r in stores.mark_delivered(box, spark.createDataFrame([(1,), (3,)], "id long"), F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")).collect()}
    assert got == {1: datetime(2025, 1, 1), 2: None, 3: T0}


def test_exponential_delay_stays_in_bounds(spark):
    rows = spark.range(0, 70).crossJoin(spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "j double"))
    got = rows.select("id", "j", limits.exponential_delay(F.col("id"), 100, 5000, F.col("j")).alias("ms")).collect()
    assert all(100 <= r.ms <= 5000 and abs(r.ms - min(5000, 100 * 2**r.id)) <= 0.1 * min(5000, 100 * 2**r.id) + 1 for r in got)


def test_slip_compensates_in_reverse(spark):
    got = slip.run(spark.createDataFrame([(1, ["a", "b", "c"], 2), (2, ["a"], None)], "slip_id int, steps array<string>, failing int")).collect()
    assert (got[0].outcome, got[0].compensated, got[1].outcome, got[1].compensated) == ("Faulted", ["b", "a"], "Completed", [])


def test_settlement_is_total(spark):
    rows = spark.range(16).selectExpr("id % 2 = 1 a", "(id DIV 2) % 2 = 1 b", "(id DIV 4) % 2 = 1 c", "id DIV 8 = 1 d")
    got = rows.select("*", dispatch.settlement(*(F.col(c) for c in "abcd")).alias("s")).collect()
    assert {r.s for r in got} == {"Ack", "Nack", "Reject", "Requeue"}
    assert all(r.s == "Reject" for r in got if not r.a and not r.b and not r.d)


def test_bad_limits_are_refused(spark):
    with pytest.raises(ValueError):
        limits.expired(F.lit(T0), 0, F.lit(T0))
    with pytest.raises(ValueError):
        stores.pending(spark.range(1), 0)


def test_options_know_their_limits():
    from driftwood.operators import config

    for make in (lambda: config.OutboxOptions(batch=10_001), lambda: config.OutboxOptions(retention_seconds=10), lambda: config.FlowOptions(max_in_flight=0), lambda: config.RetryPolicy("exponential", 3, 100, max_ms=1), lambda: config.RetryPolicy("odd", 3, 100)):
        with pytest.raises(ValueError):
            make()


def test_single_refuses_two(spark):
    assert stores.single(spark.range(3), F.col("id") == 1).id == 1
    assert stores.single(spark.range(3), F.col("id") == 9) is None
    with pytest.raises(ValueError):
        stores.single(spark.range(3), F.col("id") > 0)


def test_order_is_checked_within_and_between_slices(spark):
    from driftwood.operators import transport

    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 6), (2, 1, 5), (2, 2, 4), (3, 1, 9), (3, 4, 8)], "k int, o int, t int")
    assert {r.k: r.ordered for r in transport.in_order(rows, "k", "o", "t", "o DIV 3").collect()} == {1: True, 2: False, 3: False}


def test_null_keys_and_times_are_kept(spark):
    rows = spark.createDataFrame([(1, T0, 1), (None, T0, 2), (1, None, 3), (None, None, 4)], "q long, ts timestamp_ntz, id long")
    got = {r.id: r.n for r in limits.running_sum(rows, ["q"], ["ts", "id"], F.lit(1), "date_trunc('day', ts)", "n").collect()}
    assert got == {3: 1, 1: 2, 4: 1, 2: 2}
    events = rows.withColumn("event", F.lit("signup")).withColumnRenamed("q", "key")
    assert transitions(events, FLOW, "date_trunc('day', ts)").count() == 4


def test_saga_data_belongs_to_one_saga_of_a_key(spark):
    """Two sagas of a key, an event that none takes, nulls put and added, ties in time, and an empty table."""
    machine = MachineBuilder().initially("open", to="Open").initially("touch").during("Open", "add").during("Open", "close", to="Done", finalize=True).build()
    rows = [("a", 1, 1, "open", 5), ("a", 2, 2, "add", 7), ("a", 2, 3, "add", None), ("a", 3, 4, "close", 1), ("a", 4, 5, "touch", 99), ("a", 5, 6, "add", 99), ("a", 6, 7, "open", None), (None, 1, 8, "open", 3), ("b", 1, 9, "touch", 1)]
    events = spark.createDataFrame(rows, "key string, ts long, id long, event string, v long")
    fields = {"total": Then("v", ("add",), "add"), "first": Then("v", ("open",)), "last": Then("v"), "all": Then("v", kind="add")}
    got = {tuple(r) for r in carried(events, machine, "ts DIV 2", fields).select("key", "saga", *fields).collect()}
    assert got == {("a", 1, 7, 5, 1, 13), ("a", 2, 0, None, None, 0), (None, 1, 0, 3, 3, 3)}
    assert carried(events.limit(0), machine, "ts DIV 2", fields).count() == 0
    with pytest.raises(ValueError):
        Then("v", kind="multiply")


def test_deferring_must_be_enabled(spark):
    no = F.lit(False)
    with pytest.raises(ValueError):
        dispatch.settlement(F.lit(True), no, no, no, F.lit(True))
    actions = spark.range(1).select(dispatch.settlement(F.lit(True), F.lit(True), no, no, F.lit(True), True), dispatch.settlement(F.lit(True), no, no, F.lit(True), F.lit(True), True)).first()
    assert tuple(actions) == ("Defer", "Requeue")


def test_interop_messages_of_odd_texts(spark):
    texts = spark.createDataFrame([(t,) for t in (None, "", "null", "{}", "[1]", '{"message":null}', '{"message":{"k":1},"extra":2}')], "t string")
    assert [r[0] for r in texts.select(codec.interop_message(F.col("t"), "k int")["k"]).collect()] == [None] * 6 + [1]


def test_subtypes_of_all_depths():
    parents = {"b": "a", "c": "b", "d": "x"}
    assert (limits.subtypes(["a"], parents), limits.subtypes([], parents), limits.subtypes(["d", "d"], parents)) == (["a", "b", "c"], [], ["d"])
