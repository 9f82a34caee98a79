"""Validation of raw records: texts and order of errors, and the traps of JSON and time."""

import json

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import contract as c
from tidegauge.functions.serde import invalid_records
from tidegauge.operators.ingest import invalid_events, valid_events, validated
from tidegauge.sources.envelope import ENVELOPE

GOOD = {
    "schema_version": "1.0", "event_id": "evt-test-001", "customer_id": "cust-test-001", "event_time": "2026-08-08T19:14:11.000Z",
    "payload": {"amount": 2500000, "currency": "PYG", "transaction_type": "transfer", "channel": "mobile"},
}


def changed(**fields):
    payload = GOOD["payload"] | {k: v for k, v in fields.items() if k in GOOD["payload"]}
    return json.dumps(GOOD | {k: v for k, v in fields.items() if k not in GOOD["payload"]} | ({} if "payload" in fields else {"payload": payload}))


CASES = [
    (b"cust-test-001", json.dumps(GOOD), []),
    (b"cust-test-001", changed(note="x"), []),
    (b"cust-test-001", '{"schema_version":', [c.VALUE_NOT_JSON]),
    (b"cust-test-001", json.dumps(GOOD) + " x", [c.VALUE_NOT_JSON]),
    (b"cust-test-001", changed(amount=0, currency="USD"), [c.AMOUNT_WRONG, c.CURRENCY_WRONG]),
    (b"another-customer", json.dumps(GOOD), [c.KEY_MISMATCH]),
    (None, json.dumps(GOOD), [c.KEY_NULL]),
    (b"\xff", b"\xff", [c.KEY_NOT_UTF8, c.VALUE_NOT_UTF8]),
    (b" ", json.dumps(GOOD), [c.KEY_BLANK, c.KEY_MISMATCH]),
    (b"k", None, [c.VALUE_NOT_BYTES]),
    (b"k", "[1]", [c.NOT_AN_OBJECT]),
    (b"cust-test-001", changed(payload=[]), [c.PAYLOAD_NOT_OBJECT]),
    (b"cust-test-001", changed(schema_version=1.0), [c.VERSION_WRONG]),
    (b"cust-test-001", changed(event_id=" "), [c.EVENT_ID_BLANK]),
    (b"cust-test-001", changed(amount=True), [c.AMOUNT_WRONG]),
    (b"cust-test-001", changed(amount=5.0), [c.AMOUNT_WRONG]),
    (b"cust-test-001", json.dumps(GOOD).replace("2500000", "1e3"), [c.AMOUNT_WRONG]),
    (b"cust-test-001", changed(amount=10**20), [c.AMOUNT_LARGE]),
    (b"cust-test-001", changed(amount=2**63 - 1), []),
    (b"cust-test-001", changed(transaction_type=[]), [c.TYPE_WRONG]),
    (b"cust-test-001", changed(channel="fax"), [c.CHANNEL_WRONG]),
    (b"cust-test-001", changed(event_time="2026-08-08T19:14:11"), [c.TIME_NO_ZONE]),
    (b"cust-test-001", changed(event_time="2026-08-08"), [c.TIME_NO_ZONE]),
    (b"cust-test-001", changed(event_time="not-a-date"), ["Invalid isoformat string: 'not-a-date'"]),
    (b"cust-test-001", changed(event_time="2026-13-08T19:14:11Z"), ["Invalid isoformat string: '2026-13-08T19:14:11Z'"]),
    (b"cust-test-001", changed(event_time="0001-01-01T00:00:00+05:00"), ["Invalid isoformat string: '0001-01-01T00:00:00+05:00'"]),
    (b"cust-test-001", changed(event_time=" "), [c.TIME_BLANK]),
    (b"x", json.dumps({"schema_version": "2", "event_id": 1, "customer_id": " ", "event_time": 3, "payload": {"amount": "a", "currency": None, "transaction_type": {}, "channel": 1}}),
     [c.VERSION_WRONG, c.EVENT_ID_BLANK, c.CUSTOMER_ID_BLANK, c.TIME_BLANK, c.AMOUNT_WRONG, c.CURRENCY_WRONG, c.TYPE_WRONG, c.CHANNEL_WRONG]),
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, v.encode() if isinstance(v, str) else v, "raw", 0, i, None) for i, (k, v, _) in enumerate(CASES)]
    return validated(spark.createDataFrame(data, ENVELOPE))


def test_errors_in_order(rows):
    found = {r.offset: list(r.errors) for r in rows.select("offset", "errors").collect()}
    for i, (_, _, errors) in enumerate(CASES):
        assert found[i] == errors, CASES[i]


def test_every_record_comes_out_once(rows):
    assert valid_events(rows).count() + invalid_events(rows).count() == len(CASES)


def test_last_of_duplicate_keys_holds(spark):
    text = json.dumps(GOOD).replace('"amount": 2500000', '"amount": 1, "amount": 9')
    row = valid_events(validated(spark.createDataFrame([(b"cust-test-001", text.encode(), "raw", 0, 0, None)], ENVELOPE))).first()
    assert row.amount == 9


def test_time_is_normalised(spark):
    times = ["2026-08-08T19:14:11.123456Z", "2026-08-08 21:14:11,5+02:00", "2026-08-08T19:14+0000", "2026-08-08T14:14:11-05"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(c.format_event_time(c.in_range(c.instant(F.col("t"))))).collect()]
    assert out == ["2026-08-08T19:14:11.123Z", "2026-08-08T19:14:11.500Z", "2026-08-08T19:14:00.000Z", "2026-08-08T19:14:11.000Z"]


def test_invalid_records_are_keyed(rows):
    keys = {bytes(r.key).decode() for r in invalid_records(invalid_events(rows)).collect()}
    assert "invalid|evt-test-001" in keys and any(k.startswith("invalid|sha256:") for k in keys)
    value = json.loads(bytes(invalid_records(invalid_events(rows)).where(F.col("key").cast("string").startswith("invalid|sha256")).first().value))
    assert list(value) == sorted(value) and value["event_id"] is None and value["error_stage"] == "ingestion_validation"
