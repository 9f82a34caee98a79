"""The transaction contract as Column expressions: strict JSON, typed fields, event time and the ordered list of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of contract version 1.0.
SCHEMA_VERSION = "1.0"
CURRENCY = "PYG"
TRANSACTION_TYPES = ("card_purchase", "cash_deposit", "cash_withdrawal", "transfer")
CHANNELS = ("api", "atm", "branch", "mobile", "web")
ERROR_STAGE = "ingestion_validation"
MAX_AMOUNT = 9223372036854775807
ISO_USUAL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"
ISO_DATE_TIME = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?|\d{8}[T ]\d{2}(\d{2}(\d{2}([.,]\d{1,9})?)?)?)(Z|[+-]\d{2}(:?\d{2})?)$"
ISO_LOCAL = r"^(\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?)?Z?|\d{8}([T ]\d{2}(\d{2}(\d{2}([.,]\d{1,9})?)?)?)?Z?)$"

# Error texts.
KEY_NULL = "Kafka key must not be null"
KEY_NOT_UTF8 = "Kafka key must contain valid UTF-8"
KEY_BLANK = "Kafka key must be a non-empty string"
VALUE_NOT_BYTES = "Kafka value must be UTF-8 bytes"
VALUE_NOT_UTF8 = "Kafka value must contain valid UTF-8"
VALUE_NOT_JSON = "Kafka value must be valid JSON"
NOT_AN_OBJECT = "event must be a JSON object"
VERSION_WRONG = "schema_version must be '1.0'"
EVENT_ID_BLANK = "event_id must be a non-empty string"
CUSTOMER_ID_BLANK = "customer_id must be a non-empty string"
TIME_BLANK = "event_time must be a non-empty ISO 8601 string"
TIME_NO_ZONE = "event_time must include timezone information"
PAYLOAD_NOT_OBJECT = "payload must be a JSON object"
AMOUNT_WRONG = "payload.amount must be a positive integer"
AMOUNT_LARGE = "payload.amount exceeds the supported range"
CURRENCY_WRONG = "payload.currency must be 'PYG'"
TYPE_WRONG = "payload.transaction_type must be one of ['card_purchase', 'cash_deposit', 'cash_withdrawal', 'transfer']"
CHANNEL_WRONG = "payload.channel must be one of ['api', 'atm', 'branch', 'mobile', 'web']"
KEY_MISMATCH = "Kafka key must match customer_id"


def present(text: Column) -> Column:
    """Whether a string has a character that is not white space, by Unicode's meaning of it."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def strict_json(text: Column) -> Column:
    """An array of the text's one JSON document (element 0), or null.

    The parser ignores what trails a document, so the text is parsed within brackets with its own hash behind it: only
    if the hash comes out as element 1 was the text one document and nothing else. unwrapped() takes it out.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text), F.lit("]")))


def unwrapped(parsed: Column, text: Column) -> Column:
    return F.when(F.try_variant_get(parsed, "$[1]", "bigint") == F.xxhash64(text), F.try_variant_get(parsed, "$[0]", "variant"))


def kind(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant), F.lit("MISSING"))


def text_of(variant: Column) -> Column:
    """A value if it is a string, else null."""
    return F.when(F.schema_of_variant(variant) == "STRING", F.try_variant_get(variant, "$", "string"))


def instant(text: Column) -> Column:
    """The instant that an ISO 8601 text with an offset names; null otherwise. The usual form goes to the cast as it is."""
    tidy = F.regexp_replace(text, ",", ".")
    tidy = F.regexp_replace(tidy, r"^(\d{4})(\d{2})(\d{2})([T ])", "$1-$2-$3$4")
    tidy = F.regexp_replace(tidy, r"([T ]\d{2})(\d{2})(\d{2})", "$1:$2:$3")
    tidy = F.regexp_replace(tidy, r"([T ]\d{2})(\d{2})(Z|[+-])", "$1:$2$3")
    tidy = F.regexp_replace(tidy, r"([T ]\d{2})(Z|[+-])", "$1:00$2")
    tidy = F.regexp_replace(tidy, r"([T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    tidy = F.regexp_replace(F.regexp_replace(tidy, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"([+-]\d{2})$", "$1:00")
    return F.when(text.rlike(ISO_USUAL), text).when(text.rlike(ISO_DATE_TIME), tidy).try_cast("timestamp")


def in_range(at: Column) -> Column:
    """An instant in years 1 to 9999, else null."""
    return F.when(at.between(F.lit("0001-01-01 00:00:00Z").cast("timestamp"), F.lit("9999-12-31 23:59:59.999999Z").cast("timestamp")), at)


def check_utc(spark) -> None:
    """Texts of instants and windows are in UTC by the session's time zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")


def format_event_time(at: Column) -> Column:
    """ISO 8601 in UTC with milliseconds; the session's time zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_millis(millis: Column) -> Column:
    return format_event_time(F.timestamp_millis(millis))


def collected(*rules: tuple[Column, Column | str]) -> Column:
    """The texts of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(rule, F.lit(text) if isinstance(text, str) else text) for rule, text in rules]), lambda e: e.isNotNull())


#: Parts of an event and of its payload, each taken out in one pass; null for what is not an object.
EVENT = "struct<schema_version:variant,event_id:variant,customer_id:variant,event_time:variant,payload:variant>"
PAYLOAD = "struct<amount:variant,currency:variant,transaction_type:variant,channel:variant>"


def fields(event: Column, payload: Column, amount: Column) -> dict[str, Column]:
    """What the rules look at, of the structs EVENT and PAYLOAD and the kind of the amount."""
    number = payload["amount"]
    return {
        "f_object": event.isNotNull(),
        "f_version": text_of(event["schema_version"]),
        "f_event_id": text_of(event["event_id"]),
        "f_customer_id": text_of(event["customer_id"]),
        "f_time": text_of(event["event_time"]),
        "f_payload": payload.isNotNull(),
        "f_amount": F.when(amount == "BIGINT", F.try_variant_get(number, "$", "bigint")),
        "f_large": F.coalesce(amount.startswith("DECIMAL") & (F.try_variant_get(number, "$", "decimal(38,0)") > F.lit(MAX_AMOUNT).cast("decimal(38,0)")), F.lit(False)),
        "f_currency": text_of(payload["currency"]),
        "f_type": text_of(payload["transaction_type"]),
        "f_channel": text_of(payload["channel"]),
    }


def event_errors() -> Column:
    """Errors of an event, in contract order, over the columns that fields() names and f_at, the parsed time."""
    c = F.col
    true = lambda x: F.coalesce(x, F.lit(False))
    is_object, time = c("f_object"), c("f_time")
    has_payload = is_object & c("f_payload")
    local = true(time.rlike(ISO_LOCAL) & ~time.rlike(ISO_DATE_TIME))
    return collected(
        (~is_object, NOT_AN_OBJECT),
        (is_object & ~true(c("f_version") == SCHEMA_VERSION), VERSION_WRONG),
        (is_object & ~present(c("f_event_id")), EVENT_ID_BLANK),
        (is_object & ~present(c("f_customer_id")), CUSTOMER_ID_BLANK),
        (is_object & ~present(time), TIME_BLANK),
        (is_object & present(time) & local, TIME_NO_ZONE),
        (is_object & present(time) & ~local & c("f_at").isNull(), F.concat(F.lit("Invalid isoformat string: '"), time, F.lit("'"))),
        (is_object & ~has_payload, PAYLOAD_NOT_OBJECT),
        (has_payload & c("f_large"), AMOUNT_LARGE),
        (has_payload & ~c("f_large") & ~true(c("f_amount") > 0), AMOUNT_WRONG),
        (has_payload & ~true(c("f_currency") == CURRENCY), CURRENCY_WRONG),
        (has_payload & ~true(c("f_type").isin(*TRANSACTION_TYPES)), TYPE_WRONG),
        (has_payload & ~true(c("f_channel").isin(*CHANNELS)), CHANNEL_WRONG),
    )
