"""Exact top-k inner products: tiled products of query blocks and shards, merged as a tree.

Vectors become integers ``floor(scale * x)``. Shards of ``shard`` rows and blocks of
``block`` queries are packed by a hash of their key; each tile is one matrix product
with a partial selection of k; lists meet in groups of ``fan`` shards until one is
left for each query. A tile's memory is ``block * shard`` scores, whatever the input.
Blocks go to the shards through a shuffle; nothing is broadcast.

Cases: vectors that are null, empty or hold null or non-finite components take no
part, as query or candidate; vectors of other lengths than the query's are no
candidates of it; every row but the query's own is a candidate, repeats of it and rows
that share its key included, and each query row has a list of its own. Equal rows travel
once, with their number. A null key is a candidate, behind equal scores, but no query.
Sums past 64 bits saturate. Ties go to the smaller key. An empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermark.llm.common import table, written


def quantized(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & good)
    # floor() of a double is a long in Spark; beyond that range it saturates
    whole = rows.select(F.col(key).cast("long").alias("key"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("q"))
    return whole.groupBy("key", "q").agg(F.count("*").alias("n")).withColumn("row", F.unhex(F.md5(F.to_json(F.struct("key", "q")))))


def _pack(pdf):
    import numpy as np
    import pandas as pd

    ids = pdf["key"].to_numpy(dtype="float64", na_value=np.nan)
    keys = pdf["key"].astype("Int64").fillna(0).to_numpy(dtype="int64")
    matrix = np.stack(pdf["q"].to_numpy()).astype("int64")
    kind = next(k for k in ("i2", "i4", "i8") if matrix.min() >= np.iinfo(k).min and matrix.max() <= np.iinfo(k).max)
    rows, n = b"".join(bytes(r) for r in pdf["row"]), pdf["n"].to_numpy(dtype="int64").tobytes()
    return pd.DataFrame([{"dim": int(pdf["dim"].iloc[0]), "part": int(pdf["part"].iloc[0]), "keys": keys.tobytes(), "rows": rows, "n": n, "nulls": np.isnan(ids).tobytes(), "kind": kind, "matrix": matrix.astype(kind).tobytes()}])


def scores(a, b):
    """Exact integer products of two int64 matrices, saturated at 64 bits."""
    import numpy as np

    bound = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if bound < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _tiles(k: int):
    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                q_keys, q_n, c_keys, c_n = (np.frombuffer(row[n], np.int64) for n in ("q_keys", "q_n", "keys", "n"))
                q_rows, c_rows = (np.frombuffer(row[n], "V16") for n in ("q_rows", "rows"))
                c_null = np.frombuffer(row["nulls"], bool)
                got = scores(*(np.frombuffer(row[f"{side}matrix"], row[f"{side}kind"]).reshape(-1, dim).astype(np.int64) for side in ("q_", "")))
                out = []
                for i, key in enumerate(q_keys):
                    s = got[i]
                    copies = c_n - (c_rows == q_rows[i])  # not the query's own row
                    other = np.flatnonzero(copies)
                    if len(other) > k:  # all that may be among the k best, ties included
                        least = np.partition(s[other], len(other) - k)[len(other) - k]
                        other = other[s[other] >= least]
                    best = other[np.lexsort((c_keys[other], c_null[other], ~s[other]))][:k]  # ~s orders as -s, without overflow
                    best = np.repeat(best, np.minimum(copies[best], k))[:k]
                    out += [(q_rows[i].tobytes(), int(key), int(q_n[i]), None if c_null[j] else int(c_keys[j]), int(s[j]), row["part"]) for j in best]
                cols = list(zip(*out, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if at else pa.binary()) for at, c in enumerate(cols)], names=["row", "query_id", "n", "vec_id", "score", "part"])

    return work


def top_k(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", *, k: int = 5, scale: int = 256, shard: int = 2048, block: int = 1024, fan: int = 32) -> DataFrame:
    """-> ``(query_id, rank, vec_id, score)`` for the rows where the condition ``is_query`` on the key holds."""
    rows = written(quantized(vectors, key, vector, scale).withColumn("dim", F.size("q")), "topk-rows")
    n_all, n_query = rows.agg(F.count("*"), F.count_if(is_query(F.col("key")))).first()
    shards, blocks = max(1, -(-n_all // shard)), max(1, -(-n_query // block))
    schema = "dim int, part long, keys binary, rows binary, n binary, nulls binary, kind string, matrix binary"

    def packed(df, parts):
        return df.withColumn("part", F.pmod(F.xxhash64("key", "q"), F.lit(parts))).groupBy("dim", "part").applyInPandas(_pack, schema)

    packs = packed(rows, shards)
    asks = packed(rows.where(is_query(F.col("key"))), blocks).select("dim", *(F.col(c).alias(f"q_{c}") for c in ("keys", "rows", "n", "kind", "matrix")), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("part"))
    # copied to every shard, the queries are far larger than what is read of them, by which Spark would send them to the driver
    tiles = asks.join(packs.hint("shuffle_hash"), ["dim", "part"]).mapInArrow(_tiles(k), "row binary, query_id long, n long, vec_id long, score long, part long")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    while shards > 1:
        shards = -(-shards // fan)
        tiles = tiles.withColumn("part", F.floor(F.col("part") / fan))
        tiles = tiles.withColumn("rank", F.row_number().over(Window.partitionBy("row", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    last = Window.partitionBy("row").orderBy(*order)
    best = tiles.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda key: key % 50 == 0)


OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
