"""Smallest unique subset of a record's pool that sums to its amount.

A record's pool comes as an array, which ``cap`` bounds, so nothing is paired by a join.
Up to three parts without tolerance, records of an Arrow batch whose pools are of one size
are summed together, and three parts are tried only where fewer do not explain the record.
Anything else runs per record in a bounded dynamic programme. Pools over ``cap`` entries
and targets over ``ceiling`` are ``too_large``.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP = 64
CEILING = 5_000_000_000


def pools(cand: DataFrame, ledger: DataFrame) -> DataFrame:
    """Distinct (key, amount) of each record's candidate keys: ``record_id, key, amount``."""
    return cand.join(ledger.select("key", F.col("amount_minor").alias("amount")).distinct(), "key").select("record_id", "key", "amount")


def pools_by_key(cand: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of :func:`pools` with a key's amounts as an array: ``record_id, key, amounts``."""
    by = ledger.groupBy("key").agg(F.collect_set(F.struct(F.col("amount_minor").alias("amount"))).alias("amounts"))
    return cand.join(by, "key").select("record_id", "key", "amounts")


def solve(targets: DataFrame, pool: DataFrame, cap: int = CAP, ceiling: int = CEILING) -> DataFrame:
    """``targets(record_id, target)`` -> ``record_id, target, n_pool, status, k, members`` (sorted keys joined by commas).

    ``pool`` as made by :func:`pools` or :func:`pools_by_key`.
    """
    if "amounts" not in pool.columns:
        pool = pool.select("record_id", "key", F.array(F.struct("amount")).alias("amounts"))
    wanted = F.collect_list(F.when(F.col("_n") <= cap, F.struct("key", "amounts")))
    # dealt out once: a pool over the cap is counted and not gathered
    sized = pool.repartition("record_id").withColumn("_n", F.sum(F.size("amounts")).over(Window.partitionBy("record_id")))
    held = sized.groupBy("record_id").agg(F.sum(F.size("amounts")).alias("n_pool"), wanted.alias("items"))
    todo = targets.join(held, "record_id", "left").withColumn("n_pool", F.coalesce("n_pool", F.lit(0)).cast("long"))
    fits = (F.col("n_pool") <= cap) & (F.col("target") > 0) & (F.col("target") <= ceiling)
    todo = todo.select("record_id", "target", "n_pool", F.when(fits, F.col("items")).alias("items"))
    schema = f"record_id {todo.schema['record_id'].dataType.simpleString()}, target {todo.schema['target'].dataType.simpleString()}, n_pool long, ways long, k int, members string"
    out = todo.mapInArrow(_fewest, schema)
    status = F.when(F.col("target") < 0, "invalid").when(F.col("target") == 0, "solved").when((F.col("n_pool") > cap) | (F.col("target") > ceiling), "too_large").when(F.coalesce("ways", F.lit(0)) == 0, "infeasible").when(F.col("ways") == 1, "solved").otherwise("ambiguous")
    out = out.withColumn("status", status)
    solved = (F.col("status") == "solved") & (F.col("target") > 0)
    return out.select("record_id", "target", "n_pool", "status", F.when(solved, F.col("k")).when(F.col("target") == 0, 0).alias("k"), F.when(solved, F.col("members")).when(F.col("target") == 0, "").alias("members"))


def _fewest(batches):
    """The fewest parts, up to three, of each row's ``items`` that make its ``target``: in how many ways, and the keys where there is one."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        n = batch.num_rows
        target = batch.column("target").fill_null(0).to_numpy(zero_copy_only=False)
        lists = batch.column("items")
        by_key = lists.flatten()
        sets = by_key.field("amounts")
        amounts, keys = sets.flatten().field("amount").fill_null(0).to_numpy(zero_copy_only=False), by_key.field("key")
        of_key = np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy(zero_copy_only=False))
        of = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[of_key]
        use = np.flatnonzero((amounts > 0) & (amounts <= target[of]))
        flat, size = amounts[use], np.bincount(of[use], minlength=n)
        begin = np.cumsum(size) - size
        ways, parts, chosen = np.zeros(n, np.int64), np.zeros(n, np.int32), np.full((n, 3), -1)
        for m in np.unique(size[size > 0]).tolist():
            for k in range(1, min(m, 3) + 1):
                every = _parts(m, k)
                rows = np.flatnonzero((size == m) & (ways == 0))
                step = max(1, 200_000 // len(every))
                for lo in range(0, len(rows), step):
                    at = rows[lo : lo + step]
                    part = flat[begin[at] + np.arange(m)[:, None]]  # a row for each place
                    total = sum(part[every[:, j]] for j in range(k))
                    which, row = np.nonzero(total == target[at])
                    ways[at] = np.bincount(row, minlength=len(at))
                    found = at[row]
                    parts[found] = k
                    chosen[found, :k] = begin[found][:, None] + every[which]
        members = [None] * n
        for r in np.flatnonzero(ways == 1).tolist():
            members[r] = ",".join(sorted(keys[int(of_key[use[i]])].as_py() for i in chosen[r, : parts[r]].tolist()))
        cols = [batch.column("record_id"), batch.column("target"), batch.column("n_pool"), pa.array(ways), pa.array(parts), pa.array(members, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["record_id", "target", "n_pool", "ways", "k", "members"])


def solve_one(target: int, amounts: list[int], *, tolerance: int = 0, most: int = 3, cap: int = CAP, ceiling: int = CEILING, unique: bool = True) -> tuple[str, list[int], int]:
    """Status, positions and residual (target less sum) for one pool, of any size and tolerance.

    Sums are kept by number of parts; each holds up to two ways, enough to tell whether
    it is unique. An exact sum with fewest parts wins; else the nearest, the lower of
    two, with fewest parts.
    """
    if target < 0 or any(a < 0 for a in amounts):
        raise ValueError("amounts must not be negative")
    if target == 0:
        return "solved", [], 0
    if len(amounts) > cap or target > ceiling:
        return "too_large", [], target
    usable = [(i, a) for i, a in enumerate(amounts) if 0 < a <= target + tolerance]
    ways: list[dict[int, list[tuple[int, ...]]]] = [{0: [()]}] + [{} for _ in range(most)]
    for i, a in usable:
        for k in range(most, 0, -1):
            for total, sets in list(ways[k - 1].items()):
                # nothing builds on a sum of all the parts, so only those in reach are kept
                if total + a <= target + tolerance and (k < most or total + a >= target - tolerance):
                    have = ways[k].setdefault(total + a, [])
                    have += [(*s, i) for s in sets][: 2 - len(have)]
    hits = [(abs(target - total), total > target, k, total) for k in range(1, most + 1) for total in ways[k] if abs(target - total) <= tolerance]
    if not hits:
        return "infeasible", [], target
    _, _, k, total = min(hits)
    sets = ways[k][total]
    if unique and len(sets) > 1:
        return "ambiguous", [], target - total
    return "solved", list(sets[0]), target - total


def solve_general(targets: DataFrame, pool: DataFrame, **options) -> DataFrame:
    """:func:`solve_one` for each record, where tolerance or more than three parts are wanted.

    Records come in Arrow batches with their pools as arrays; up to three parts, those with
    pools of one size are tried together.
    """
    cap = options.get("cap", CAP)
    sized = pool.join(targets, "record_id").withColumn("n", F.count("*").over(Window.partitionBy("record_id")))
    held = sized.where(F.col("n") <= cap).groupBy("record_id", "target").agg(F.array_sort(F.collect_list(F.struct("key", "amount"))).alias("i"))
    held = held.select("record_id", "target", F.transform("i", lambda x: x["key"]).alias("keys"), F.transform("i", lambda x: x["amount"]).alias("amounts"))

    def work(batches):
        import pandas as pd

        for pdf in batches:
            got = solve_many(pdf["target"].tolist(), pdf["amounts"].tolist(), **options)
            yield pd.DataFrame({"record_id": pdf["record_id"], "status": [g[0] for g in got], "members": [",".join(sorted(keys[i] for i in g[1])) for keys, g in zip(pdf["keys"], got, strict=True)], "residual": [g[2] for g in got]})

    small = held.mapInPandas(work, f"record_id {held.schema['record_id'].dataType.simpleString()}, status string, members string, residual long")
    large = sized.where(F.col("n") > cap).select("record_id", F.lit("too_large").alias("status"), F.lit("").alias("members"), F.col("target").alias("residual")).distinct()
    return small.union(large)


@lru_cache(maxsize=256)
def _parts(n: int, k: int):
    """All choices of ``k`` of ``n``, in the order in which :func:`solve_one` comes upon them: by the last part, then the one before."""
    import numpy as np

    every = np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k)
    return every[np.lexsort(every.T)]


def solve_many(targets: list[int], pools: list, *, tolerance: int = 0, most: int = 3, cap: int = CAP, ceiling: int = CEILING, unique: bool = True) -> list[tuple[str, list[int], int]]:
    """:func:`solve_one` of each; pools of one size are summed as one array where parts are few."""
    import numpy as np

    out: list = [None] * len(targets)
    sizes: dict[int, list] = {}
    for r, (target, amounts) in enumerate(zip(targets, pools, strict=True)):
        target, amounts = int(target), np.asarray(amounts, np.int64)
        if most > 3 or len(amounts) > CAP or target <= 0 or target > ceiling or len(amounts) > cap or (amounts < 0).any():
            out[r] = solve_one(target, amounts.tolist(), tolerance=tolerance, most=most, cap=cap, ceiling=ceiling, unique=unique)
            continue
        usable = np.flatnonzero((amounts > 0) & (amounts <= target + tolerance))
        sizes.setdefault(len(usable), []).append((r, target, usable, amounts[usable]))
    for n, rows in sizes.items():
        ways = [_parts(n, k) for k in range(1, min(most, n) + 1)]
        step = max(1, 2_000_000 // max([len(w) for w in ways], default=1))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            target = np.array([x[1] for x in part])
            amounts = np.array([x[3] for x in part], np.int64).reshape(len(part), n)
            best = [None] * len(part)
            for k, w in enumerate(ways):
                total = sum(amounts[:, w[:, j]] for j in range(k + 1))
                # nearest first, the lower of two sums that are as near
                cost = 2 * np.abs(target[:, None] - total) + (total > target[:, None])
                least, at = cost.min(1), cost.argmin(1)
                many = (cost == least[:, None]).sum(1)
                for i in range(len(part)):
                    if least[i] // 2 <= tolerance and (best[i] is None or least[i] < best[i][0]):
                        best[i] = (least[i], w[at[i]], many[i], int(target[i] - total[i, at[i]]))
            for (r, t, usable, _), b in zip(part, best, strict=True):
                out[r] = ("infeasible", [], t) if b is None else ("ambiguous", [], b[3]) if unique and b[2] > 1 else ("solved", usable[b[1]].tolist(), b[3])
    return out


def brute(target: int, amounts: list[int], most: int = 3) -> str:
    """The same statuses by trying every subset; for tests."""
    if target == 0:
        return "solved"
    for k in range(1, most + 1):
        n = sum(sum(c) == target for c in combinations([a for a in amounts if a > 0], k))
        if n:
            return "solved" if n == 1 else "ambiguous"
    return "infeasible"
