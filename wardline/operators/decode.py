"""Topic values (JSON text) to typed events and alerts, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.schemas import ALERT, EVENT

_FIELDS = EVENT.fieldNames()
_TEXT = {name: f"_{name}_text" for name in _FIELDS}


def decode_events(
    raw: DataFrame,
    mode: str = "strict",
    value: str = "value",
    default_ts: Column | None = None,
    schema: T.StructType = EVENT,
) -> DataFrame:
    """Typed event columns next to the other columns of ``raw``.

    ``lenient`` reads with the declared schema: a value of another type, a missing field and every
    field of a broken text become NULL. ``strict`` coerces instead: numbers may come as text or be
    fractional, a missing or nested text is ``''``, a missing amount ``0.0`` and ``true`` 1.0, a missing ``ts`` is
    ``default_ts`` (the current time unless given). Broken texts are left out; take them from
    :func:`broken_values`.
    """
    others = [name for name in raw.columns if name != value]
    if mode == "lenient":
        # As a generated row, so that a filter on a field does not parse the value a second time.
        return raw.select(*others, F.inline_outer(F.array(F.from_json(value, schema))))
    if mode != "strict":
        raise ValueError(f"unknown decode mode {mode!r}")
    if default_ts is None:
        default_ts = F.unix_millis(F.current_timestamp())
    parsed = _with_field_texts(raw, value)
    return parsed.where(_is_json(value)).select(
        *others,
        _or_empty("type", value),
        _or_empty("cardId", value),
        F.when(_is_kind("amount", value, "BOOLEAN", F.col(_TEXT["amount"]) == "true"), 1.0)
        .otherwise(F.coalesce(F.col(_TEXT["amount"]).try_cast("double"), F.lit(0.0))).alias("amount"),
        _or_empty("actor", value),
        F.coalesce(
            F.col(_TEXT["ts"]).try_cast("bigint"),
            F.col(_TEXT["ts"]).try_cast("double").try_cast("bigint"),
            default_ts,
        ).alias("ts"),
    )


def broken_values(raw: DataFrame, value: str = "value") -> DataFrame:
    """The rows strict decoding leaves out, unchanged."""
    return _with_field_texts(raw, value).where(~_is_json(value)).select(*raw.columns)


def _with_field_texts(raw: DataFrame, value: str) -> DataFrame:
    """Each field as text whatever its JSON type, from one parse; all NULL if the value is broken."""
    return raw.select("*", F.json_tuple(value, *_FIELDS).alias(*_TEXT.values()))


def _is_json(value: str) -> Column:
    """JSON of any kind, or empty: a list or a bare number is an event without fields, not broken.
    Only values without any field need the second look."""
    text = F.col(value)
    has_field = F.coalesce(*_TEXT.values()).isNotNull()
    return has_field | F.coalesce((F.trim(text) == "") | F.try_parse_json(text).isNotNull(), F.lit(False))


def _is_kind(name: str, value: str, kind: str, looks: Column) -> Column:
    """Whether a field is of a JSON ``kind``; only where its text ``looks`` so is the value parsed again."""
    field = F.try_variant_get(F.try_parse_json(value), f"$.{name}", "variant")
    return F.coalesce(looks & F.when(looks, F.schema_of_variant(field) == kind), F.lit(False))


def _or_empty(name: str, value: str) -> Column:
    """The field's text; a missing field, an object and a list have none."""
    text = F.col(_TEXT[name])
    looks = text.startswith("{") | text.startswith("[")
    nested = F.coalesce(looks, F.lit(False)) & ~_is_kind(name, value, "STRING", looks)
    return F.when(nested, "").otherwise(F.coalesce(text, F.lit(""))).alias(name)


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_millis("ts"))


def decode_alerts(raw: DataFrame, value: str = "value") -> DataFrame:
    """``id, rule, ts`` next to the other columns of ``raw``."""
    return decode_events(raw, "lenient", value, schema=ALERT)


def encode_alerts(alerts: DataFrame, key: bool = True) -> DataFrame:
    """One JSON ``value`` per alert, keyed by its id so that a topic keeps an entity's order."""
    value = F.to_json(F.struct("id", "rule", "ts")).alias("value")
    return alerts.select(F.col("id").alias("key"), value) if key else alerts.select(value)
