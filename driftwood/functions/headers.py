"""Header maps between the wire and the engine. Keys are ordinal; aliases are matched without regard to case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE_TYPE, RESERVED = "dw-MessageType", "dw-"
#: Wire properties with a canonical header of their own.
PROPERTIES = ["message-id", "correlation-id", "content-type", "reply-to"]


def _text_map(pairs: dict[str, str]) -> Column:
    keys, values = F.array(*[F.lit(k.lower()) for k in pairs]), F.array(*[F.lit(v) for v in pairs.values()])
    return F.map_from_arrays(keys, values)


def inbound(headers: Column, aliases: dict[str, str] | None = None, keep_unmapped: bool = True) -> Column:
    """Wire headers as canonical ones: empty values dropped, aliases renamed, traceparent in lower case."""
    named = F.map_filter(headers, lambda k, v: v.isNotNull() & (v != ""))
    known = _text_map(aliases or {"": ""})
    other = lambda k: F.try_element_at(known, F.lower(k))
    if not keep_unmapped:
        named = F.map_filter(named, lambda k, v: k.isin(*PROPERTIES, MESSAGE_TYPE) | other(k).isNotNull() | (F.lower(k) == "traceparent"))
    renamed = F.transform_keys(named, lambda k, v: F.coalesce(other(k), F.when(F.lower(k) == "traceparent", F.lit("traceparent")), k))
    return F.transform_values(renamed, lambda k, v: F.when(k == "traceparent", F.lower(v)).otherwise(v))


def outbound(headers: Column, aliases: dict[str, str] | None = None, keep_unmapped: bool = True) -> Column:
    """Canonical headers as wire ones: the engine's own are dropped but the type, aliases renamed."""
    kept = F.map_filter(headers, lambda k, v: v.isNotNull() & ((k == MESSAGE_TYPE) | ~k.startswith(RESERVED)))
    known = _text_map(aliases or {"": ""})
    other = lambda k: F.try_element_at(known, F.lower(k))
    if not keep_unmapped:
        kept = F.map_filter(kept, lambda k, v: k.isin(*PROPERTIES, MESSAGE_TYPE, "traceparent") | other(k).isNotNull())
    return F.transform_keys(kept, lambda k, v: F.coalesce(other(k), F.when(k == MESSAGE_TYPE, F.lit("type")), k))


def merged(caller: Column, message_type: Column, message_id: Column) -> Column:
    """The caller's headers, then the type and the id, which always win."""
    own = F.create_map(F.lit(MESSAGE_TYPE), message_type, F.lit("message-id"), message_id)
    return F.map_concat(F.map_filter(caller, lambda k, v: ~k.isin(MESSAGE_TYPE, "message-id")), own)


def inject(headers: Column, trace_id: Column, span_id: Column, sampled: Column) -> Column:
    """headers with the W3C traceparent of a span, in place of any that they carry; as they are where there is no span."""
    parent = F.concat(F.lit("00-"), F.lower(trace_id), F.lit("-"), F.lower(span_id), F.when(sampled, F.lit("-01")).otherwise(F.lit("-00")))
    others = F.map_filter(headers, lambda k, v: F.lower(k) != "traceparent")
    return F.when(parent.isNull(), headers).otherwise(F.map_concat(others, F.create_map(F.lit("traceparent"), parent)))


def trace(headers: Column) -> Column:
    """(trace_id, span_id, sampled) of a W3C traceparent, or null."""
    text = F.try_element_at(headers, F.lit("traceparent"))
    form = r"^[0-9a-f]{2}-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
    return F.when(text.rlike(form), F.struct(F.regexp_extract(text, form, 1).alias("trace_id"), F.regexp_extract(text, form, 2).alias("span_id"), (F.regexp_extract(text, form, 3).substr(2, 1).isin(*"13579bdf")).alias("sampled")))
