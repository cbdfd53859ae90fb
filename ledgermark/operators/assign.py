"""One key for each record and one record for each key, of greatest total weight: an auction in rounds of joins.

Records without a key bid in each round for the key that is worth most to them at present
prices: the price rises by how much the second best (or to go without) is worth less, and
by ``epsilon``. The highest bid for a key wins; who held it before is without a key
again. A record to which no key is worth its price goes without for good, as prices only
rise. At the end every record holds a key that is within ``epsilon`` of its best, and keys
nobody holds cost nothing, so the total is less than the greatest possible by at most
``epsilon`` for each record that has a key; with whole weights and ``epsilon`` under one by
the number of records it is the greatest.

A round reads the edges of records that bid, which soon are few, and sums up to two rows
a record and one a key; prices and holders are a written table. Nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed


def assign(edges: DataFrame, epsilon: float, rounds: int = 10_000) -> DataFrame:
    """``edges(record_id, key, weight)`` -> ``record_id, key, weight, price``.

    Edges without a weight above 0, a record or a key take no part; of repeated edges the
    greatest weight counts. Equal bids go to the record that is first by id, equal values
    to the first key. More than ``rounds`` rounds are an error, never a result.
    """
    if not epsilon > 0:
        raise ValueError("epsilon must be above 0")
    edges = edges.where("weight > 0 and not isnan(cast(weight AS double)) and record_id is not null and key is not null")
    edges = checkpointed(edges.groupBy("record_id", "key").agg(F.max("weight").cast("double").alias("weight")))
    held = None  # key, record_id, weight, price
    bidding = edges
    for _ in range(rounds):
        worth = F.col("weight") if held is None else F.col("weight") - F.coalesce("price", F.lit(0.0))
        at = bidding if held is None else bidding.join(held.select("key", "price"), "key", "left")
        order = Window.partitionBy("record_id").orderBy(F.col("worth").desc(), "key")
        two = at.withColumn("worth", worth).where("worth > 0").withColumn("_r", F.row_number().over(order)).where("_r <= 2")
        first, second = (lambda c: F.max(F.when(F.col("_r") == 1, F.col(c)))), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("worth"))), F.lit(0.0))
        bids = two.groupBy("record_id").agg(first("key").alias("key"), first("weight").alias("weight"), (first("weight") - second + epsilon).alias("bid"))
        # the highest bid; of equal ones the first record's
        best = checkpointed(bids.groupBy("key").agg(F.min(F.struct((-F.col("bid")).alias("less"), "record_id", "weight")).alias("b")).select("key", "b.record_id", "b.weight", (-F.col("b.less")).alias("price")))
        if best.isEmpty():
            break
        lost = edges.limit(0).select("record_id") if held is None else held.join(best.select("key"), "key", "left_semi").select("record_id")
        held = checkpointed(best if held is None else best.unionByName(held.join(best.select("key"), "key", "left_anti")))
        # who bid and didn't win bids again, and so does who was outbid
        again = checkpointed(bids.select("record_id").join(best.select("record_id"), "record_id", "left_anti").union(lost))
        bidding = edges.join(again, "record_id", "left_semi")
    else:
        raise RuntimeError(f"no assignment after {rounds} rounds; raise epsilon")
    if held is None:
        return edges.withColumn("price", F.lit(0.0)).limit(0)
    return held.select("record_id", "key", "weight", "price")
