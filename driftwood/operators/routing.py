"""Publishing and routing: messages as rows, exchanges, queues and bindings as small tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered


def topic_regex(pattern: str) -> str:
    """A topic pattern as a regular expression for a dot and the key: * is one word, # any number of words."""
    words = {"*": r"\.[^.]+", "#": r"(\.[^.]+)*"}
    dotted = "".join(words.get(w, r"\." + re.escape(w)) for w in pattern.split("."))
    return rf"^({dotted}|\.)$" if set(pattern.split(".")) == {"#"} else f"^{dotted}$"  # # alone takes the empty key too


def regex_column(pattern: str, df: DataFrame) -> DataFrame:
    """df with pattern_regex for its column of topic patterns; bindings are a small table, so this is a driver-side mapping."""
    found = [r[0] for r in df.select(pattern).distinct().limit(10_001).collect()]
    if len(found) > 10_000:
        raise ValueError("more than 10000 topic patterns")
    table = F.create_map(*[F.lit(x) for p in found if p is not None for x in (p, topic_regex(p))]) if found else F.create_map()
    return df.withColumn("pattern_regex", F.try_element_at(table, F.col(pattern)))


def route(messages: DataFrame, exchanges: DataFrame, bindings: DataFrame) -> DataFrame:
    """(message columns, queue): one row for each queue that a message reaches, however many bindings lead there; a
    message that is there twice reaches it twice.

    messages has exchange and routing_key; exchanges has name and type; bindings has exchange, queue, binding_key. The
    two tables are joined first; direct and fanout bindings meet messages by equality, so that only topic bindings are
    compared by pattern, within their exchange.
    """
    kinds = bindings.join(exchanges.select(F.col("name").alias("exchange"), "type"), "exchange").select("exchange", "type", "binding_key", "queue").distinct()
    direct = messages.join(kinds.where("type = 'direct'").select("exchange", F.col("binding_key").alias("routing_key"), "queue"), ["exchange", "routing_key"])
    fanout = messages.join(kinds.where("type = 'fanout'").select("exchange", "queue").distinct(), "exchange")
    topics = regex_column("binding_key", kinds.where("type = 'topic'")).groupBy("exchange", "queue").agg(F.array_join(F.array_sort(F.collect_set("pattern_regex")), "|").alias("pattern_regex"))
    topic = messages.join(topics, "exchange").where("concat('.', routing_key) RLIKE pattern_regex").drop("pattern_regex")
    columns = [*messages.columns, "queue"]
    return direct.select(columns).unionByName(fanout.select(columns)).unionByName(topic.select(columns))  # an exchange has one type


def closure(edges: DataFrame, most: int = 10_000) -> list[tuple[str, str]]:
    """All (source, destination) pairs of exchange bindings, and each exchange with itself; edges are a small table."""
    rows = [tuple(r) for r in edges.select("source", "destination").distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} exchange bindings")
    reach = {x: {x} for e in rows for x in e}
    grown = True
    while grown:
        grown = False
        for a, b in rows:
            for s in reach.values():
                if a in s and b not in s:
                    s.add(b)
                    grown = True
    return sorted((a, b) for a, s in reach.items() for b in s)


def through_exchanges(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """messages once for each exchange that they reach over bindings between exchanges."""
    pairs = closure(edges)
    if not pairs:
        return messages
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(y) for y in x]) for a in dict.fromkeys(a for a, _ in pairs) for x in (a, [d for s, d in pairs if s == a])])
    reached = F.coalesce(F.try_element_at(table, F.col("exchange")), F.array("exchange"))
    return messages.withColumn("exchange", F.explode(reached))


def publish(messages: DataFrame, exchange_map: DataFrame, key_map: DataFrame, default_exchange: str = "", namespace: str = "driftwood") -> DataFrame:
    """messages (message_id, message_type, header_exchange) with the exchange and the routing key that they are published with.

    A header names the exchange first, then the map of types; the key is mapped by type or is the full type name. A raw
    message, which has no type, has an empty key.
    """
    out = messages.join(F.broadcast(exchange_map.select("message_type", F.col("exchange").alias("_x"))), "message_type", "left").join(F.broadcast(key_map.select("message_type", F.col("routing_key").alias("_k"))), "message_type", "left")
    exchange = F.coalesce(F.nullif("header_exchange", F.lit("")), "_x", F.lit(default_exchange))
    return out.withColumns({"exchange": exchange, "routing_key": F.coalesce("_k", F.concat(F.lit(f"{namespace}."), "message_type"), F.lit(""))}).drop("_x", "_k")


def undeclared(exchange_map: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Mapped exchanges that nobody declares: an error of configuration."""
    return exchange_map.join(exchanges.select(F.col("name").alias("exchange")), "exchange", "left_anti").select("message_type", "exchange")


def address(uri: Column) -> Column:
    """(exchange, routing_key, correlation_id) that a send address stands for.

    queue:x goes to the default exchange with key x, exchange:x to exchange x without a key, any other to its path.
    """
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    path = F.regexp_replace(F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?/*([^?#]*)", 1), "/+$", "")
    found = F.regexp_extract(uri, r"[?&]correlation-id=([^&#]*)", 1)
    return F.struct(F.when(scheme == "exchange", path).otherwise(F.lit("")).alias("exchange"), F.when(scheme == "exchange", F.lit("")).otherwise(path).alias("routing_key"), F.nullif(F.url_decode(found), F.lit("")).alias("correlation_id"))


def send_raw(uri: Column) -> Column:
    """(exchange, routing_key, headers) of a payload that is sent as it is: the key is the path of the address, headers are empty."""
    path = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?/*([^?#]*)", 1)
    return F.struct(F.lit("").alias("exchange"), path.alias("routing_key"), F.create_map().cast("map<string,string>").alias("headers"))


def batches(messages: DataFrame, keys: list[str], order: list[str], slice_by: str, size: int = 64) -> DataFrame:
    """messages with the number of the publisher batch, of size at most, that they leave in."""
    return numbered(messages, keys, order, slice_by, "_n").withColumn("batch", F.expr(f"CAST((_n - 1) DIV {size} AS BIGINT)")).drop("_n")


def reply_to(requests: DataFrame) -> DataFrame:
    """Where a response goes: to the reply queue with the correlation id, else it is published."""
    direct = F.col("reply_to").isNotNull() & (F.col("reply_to") != "")
    return requests.withColumns({"mode": F.when(direct, F.lit("send")).otherwise(F.lit("publish")), "target": F.when(direct, F.col("reply_to")).otherwise(F.lit(""))})
