"""The data source of settled lines, read at once and as a stream that starts again."""

import pytest

from ledgermark.sources import settled_source
from tests.settled_transport import LINES

OPTIONS = {"transport": "tests.settled_transport:fetch", "base": "http://none", "key_id": "rzp_test_x", "key_secret": "s", "first": "2024-02-01", "last": "2024-02-03", "count": "10"}
WANT = sorted(f"e{d}-{i}" for d, n in LINES.items() for i in range(n) if i % 5)


def test_days_are_partitions_and_pages_are_read_to_the_end(spark):
    settled_source.register(spark)
    df = spark.read.format("settled_lines").options(**OPTIONS).load()
    got = df.collect()
    assert sorted(r["entity_id"] for r in got) == WANT and df.rdd.getNumPartitions() == 3
    one = next(r for r in got if r["entity_id"] == "e3-4")
    assert (one["settlement_id"], one["credit"], one["debit"], one["settled_at"]) == ("s3", 400, 0, 1_700_000_000)
    # full pages, of which the last is followed by an empty one
    assert spark.read.format("settled_lines").options(**OPTIONS | {"count": "25"}).load().count() == len(WANT)


@pytest.mark.parametrize("wrong, says", [({"key_id": "live_x"}, "test keys"), ({"count": "0"}, "count"), ({"count": "1001"}, "count"), ({"base": ""}, "base"), ({"last": ""}, "last")])
def test_guards(spark, wrong, says):
    settled_source.register(spark)
    with pytest.raises(Exception, match=says):
        spark.read.format("settled_lines").options(**OPTIONS | wrong).load().collect()


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    settled_source.register(spark)

    def run(last):
        stream = spark.readStream.format("settled_lines").options(**OPTIONS | {"last": last}).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r["entity_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run("2024-02-01") == [x for x in WANT if x.startswith("e1-")]
    assert run("2024-02-03") == WANT
    assert run("2024-02-03") == WANT
