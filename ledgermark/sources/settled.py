"""Settled lines of a payment processor, from a fetch function that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "entity_id string, settlement_id string, type string, credit long, debit long, fee long, currency string, settled_at long"
#: Only test keys are taken, and so many lines at once.
TEST_PREFIX, MOST = "rzp_test_", 1000


def fetch_settled(spark: SparkSession, key_id: str, key_secret: str, *, year: int, month: int, day: int | None = None, count: int = 100, fetch: Callable[[str, tuple[str, str]], dict], base: str) -> DataFrame:
    """Lines with a settlement; ``fetch(url, auth)`` returns the parsed answer with ``items``."""
    if not key_id.startswith(TEST_PREFIX) or not key_secret:
        raise ValueError("only test keys are allowed")
    if not 1 <= month <= 12 or day is not None and not 1 <= day <= 31 or not 1 <= count <= MOST:
        raise ValueError("month, day or count out of range")
    url = f"{base}?year={year}&month={month}" + (f"&day={day}" if day else "") + f"&count={count}"
    items = fetch(url, (key_id, key_secret)).get("items") or []
    rows = [(str(x.get("entity_id")), x["settlement_id"], x.get("type"), int(x.get("credit") or 0), int(x.get("debit") or 0), int(x.get("fee") or 0), x.get("currency"), int(x["settled_at"]) if x.get("settled_at") else None) for x in items[:MOST] if x.get("settlement_id")]
    return spark.createDataFrame(rows, SCHEMA)
