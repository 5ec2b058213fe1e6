"""Encoding, decoding and identity of messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GUID = r"^\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?$"
# Names on the wire.
ENVELOPE, INTEROP, RAW = "application/vnd.driftwood+json", "application/vnd.masstransit+json", "application/json"
EXCERPT = 500


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head[:1].lower() + head[1:] + "".join(r[:1].upper() + r[1:] for r in rest)


def to_message_json(**fields: Column) -> Column:
    """A JSON object with camelCase names, without nulls."""
    return F.to_json(F.struct(*[c.alias(camel(k)) for k, c in fields.items()]), {"ignoreNullFields": "true"})


def decode(body: Column, schema: StructType | str) -> Column:
    """A struct; null for an empty body, for JSON null and for what is no JSON object."""
    text = F.trim(body.cast("string"))
    sound = text.startswith("{") & F.get_json_object(text, "$").isNotNull()
    return F.when(sound, F.from_json(text, schema if isinstance(schema, str) else schema.simpleString()))


def excerpt(body: Column) -> Column:
    """What an error shows of a body that cannot be decoded: the first 500 bytes."""
    raw = body.cast("binary")
    return F.substring(raw, 1, EXCERPT).cast("string")


def envelope(message_id: Column, correlation_id: Column, message_type: Column, sent: Column, body: Column, namespace: str = "driftwood") -> Column:
    """The native envelope; body is JSON and stands in it as it is."""
    head = F.to_json(F.struct(message_id.alias("messageId"), correlation_id.alias("correlationId"), F.array(urn(F.lit(namespace), message_type)).alias("messageType"), F.date_format(sent, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("sentTime"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("headers")), {"ignoreNullFields": "true"})
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"body":'), body, F.lit("}"))


def interop_envelope(message_id: Column, namespace: Column, message_type: Column, sent: Column, message: Column) -> Column:
    """The envelope that other buses read: the message, which is JSON, stands in it under `message`."""
    head = F.to_json(F.struct(message_id.alias("messageId"), F.array(urn(namespace, message_type)).alias("messageType"), F.date_format(sent, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("sentTime")))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"message":'), message, F.lit("}"))


def interop_message(envelope_json: Column, schema: StructType | str) -> Column:
    """The message of an interop envelope as a struct; null for no envelope and for one whose message is missing or null."""
    return decode(F.get_json_object(F.trim(envelope_json), "$.message"), schema)


def envelope_field(envelope_json: Column, name: str) -> Column:
    return F.get_json_object(envelope_json, f"$.{name}")


def decoder_for(content_type: Column, default: str = RAW) -> Column:
    """The decoder that a content type names; parameters and case do not count, unknown types get the default."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return F.when(kind.isin(ENVELOPE, INTEROP, RAW), kind).otherwise(F.lit(default))


def parse_guid(text: Column) -> Column:
    """Lower-case GUID text, or null."""
    return F.when(text.rlike(GUID), F.lower(F.translate(text, "{}", "")))


def normal_id(text: Column) -> Column:
    """A GUID as it is; of other text, the first 16 bytes of its SHA-256 in mixed-endian GUID layout."""
    h = F.sha2(F.encode(text, "UTF-8"), 256)
    pair = lambda i: F.substring(h, i, 2)
    order = [[7, 5, 3, 1], [11, 9], [15, 13]]
    hashed = F.concat_ws("-", *[F.concat(*[pair(i) for i in g]) for g in order], F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.coalesce(parse_guid(text), hashed)


def urn(namespace: Column, name: Column) -> Column:
    return F.concat(F.lit("urn:message:"), namespace, F.lit(":"), name)
