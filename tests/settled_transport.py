"""A made-up processor that workers can import: seven lines on the 1st, none on the 2nd, pages on the 3rd."""

from urllib.parse import parse_qs, urlparse

LINES = {1: 7, 2: 0, 3: 25}


def fetch(url, auth):
    q = {k: int(v[0]) for k, v in parse_qs(urlparse(url).query).items()}
    assert auth == ("rzp_test_x", "s") and (q["year"], q["month"]) == (2024, 2)
    every = [{"entity_id": f"e{q['day']}-{i}", "settlement_id": f"s{q['day']}" if i % 5 else None, "type": "payment", "credit": i * 100, "settled_at": 0 if i % 2 else 1_700_000_000} for i in range(LINES[q["day"]])]
    return {"items": every[q["skip"] : q["skip"] + q["count"]]}
