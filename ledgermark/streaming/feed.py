"""Decisions over streams: the same plan in micro-batches, and a band join of two streams."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgermark.operators import decide, features
from ledgermark.operators.cases import ROUNDING

#: From a cell to itself and its neighbours.
STEPS = list(itertools.product((-1, 0, 1), repeat=3))


def decide_batch(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Decisions by rules; a record's decision depends on no other record."""
    return decide.decided(decide.looked_up(features.brief(bank), ledger, features.key_stats(ledger)))


def decision_feed(bank_stream: DataFrame, ledger: DataFrame, path: str, checkpoint: str):
    """Streams records against a static ledger; each micro-batch is one append to ``path/batch=n``.

    A batch that runs again after a failure replaces its own part, so records are decided once.
    """

    def batch(rows: DataFrame, n: int) -> None:
        decide_batch(rows, ledger).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return bank_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def near_in_time(left: DataFrame, right: DataFrame, key: str, days: int = 7, lateness: str = "7 days", how: str = "inner") -> DataFrame:
    """Band join of streams ``(key, lt, ...)`` and ``(key, rt, ...)``: rt within ``days`` of lt; watermarks bound the state.

    With ``how="left"`` a row that nothing met follows with nulls, once the watermark is
    past the last moment at which anything could have: both streams must have gone on by
    ``days`` and ``lateness``. Rows later than that are dropped; :func:`late_rows` counts them.
    """
    a = left.withWatermark("lt", lateness)
    b = right.withWatermark("rt", lateness).withColumnRenamed(key, "_k")
    band = F.expr(f"rt BETWEEN lt - INTERVAL {days} DAYS AND lt + INTERVAL {days} DAYS")
    return a.join(b, (F.col(key) == F.col("_k")) & band, {"inner": "inner", "left": "leftOuter"}[how]).drop("_k")


def late_rows(query) -> int:
    """Rows that a query's stateful operators dropped because they came after the watermark, over the progress it still holds."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def distinct_situations(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each situation once while the watermark holds it."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["situation"])


class Opened:
    """Cases of a locus that a micro-batch has read or kept, as arrays that grow."""

    def __init__(self, dims: int):
        import numpy as np

        self.n, self.ids, self.cells = 0, np.empty(64, object), np.empty(64, object)
        self.counts, self.turns, self.units = np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros((64, dims))

    def put(self, cell: str, case_id, count: int, turn: int, v) -> int:
        import numpy as np

        if self.n == len(self.ids):
            self.ids, self.cells, self.counts, self.turns, self.units = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ids, self.cells, self.counts, self.turns, self.units))
        at, self.n = self.n, self.n + 1
        self.ids[at], self.cells[at], self.counts[at], self.turns[at], self.units[at] = case_id, cell, count, turn, v
        return at

    def drop(self, at: int) -> None:
        last = self.n = self.n - 1
        for x in (self.ids, self.cells, self.counts, self.turns, self.units):
            x[at] = x[last]


def in_turn(arrivals):
    """Arrivals by seq, then case_id; names are compared only where seq is tied, as they are long."""
    import numpy as np

    if arrivals["seq"].isna().any():
        return arrivals.sort_values(["seq", "case_id"])
    arrivals = arrivals.iloc[np.argsort(arrivals["seq"].to_numpy(), kind="stable")]
    seq = arrivals["seq"].to_numpy()
    same = seq[1:] == seq[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    if len(tied):
        order = np.arange(len(seq))
        order[tied] = tied[arrivals[["seq", "case_id"]].iloc[tied].reset_index(drop=True).sort_values(["seq", "case_id"]).index]
        arrivals = arrivals.iloc[order]
    return arrivals


class CaseKeeper(StatefulProcessor):
    """The cases of a locus: a map from cell to the cases in it, so that arrivals meet those of their own and the neighbouring cells.

    Arrivals are taken in blocks. One product compares a block with the cases that were
    there before it; what matched none of them is worked through in order, against what
    the block itself has kept. Where a case must leave, the block ends.
    """

    def __init__(self, duplicate: float, most: int):
        self.duplicate, self.most = duplicate, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "cell string", "ids array<string>, counts array<bigint>, turns array<bigint>, units array<double>")
        self.totals = handle.getValueState("totals", "n bigint, turn bigint")

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        n, turn = self.totals.get() if self.totals.exists() else (0, 0)
        occupied = {k[0] for k in self.cells.keys()} if n else set()
        arrivals = in_turn(pd.concat(list(rows)))
        seqs, names = arrivals["seq"].to_numpy(), arrivals["case_id"].to_numpy(object)
        units = np.stack(arrivals["situation"].to_numpy()).astype(float)
        del arrivals
        norms = np.linalg.norm(units, axis=1)
        some = norms != 0  # a vector of length 0 is like no other
        units[some] /= norms[some, None]
        dims, width, least = units.shape[1], math.sqrt(2 - 2 * self.duplicate) + 1e-9, self.duplicate - ROUNDING
        signs = np.random.default_rng(dims).choice([-1.0, 1.0], (3, dims)) / math.sqrt(dims)
        at = np.floor(units @ signs.T / width).astype(int)
        held, read, changed = Opened(dims), set(), set()

        def open_(cell):
            if cell in occupied and cell not in read:
                read.add(cell)
                ids, counts, turns, flat = self.cells.getValue((cell,))
                for case in zip(ids, counts, turns, np.asarray(flat, float).reshape(len(ids), -1), strict=True):
                    held.put(cell, *case)

        lo, out = 0, []
        while lo < len(seqs):
            block = slice(lo, min(len(seqs), lo + max(64, min(2048, 8_000_000 // max(1, held.n)))))
            near = np.unique(at[block][some[block]], axis=0)
            for cell in {",".join(map(str, c)) for c in np.unique((near[:, None] + np.array(STEPS)).reshape(-1, 3), axis=0)}:
                open_(cell)
            part, before = units[block], np.argsort(held.turns[: held.n])
            before = before[held.units[before].any(1)]
            first = np.full(len(part), -1)
            if len(before):
                met = (part @ held.units[before].T >= least) & some[block, None]
                first = np.where(met.any(1), before[met.argmax(1)], -1)
            fresh, full, entered = [], None, np.zeros(len(part), bool)
            for i in np.flatnonzero(first < 0):
                if some[lo + i] and fresh:
                    met = held.units[fresh] @ part[i] >= least
                    if met.any():
                        first[i] = fresh[met.argmax()]
                        continue
                turn += 1
                entered[i] = True
                if n >= self.most:
                    full = i
                    break
                n += 1
                cell = ",".join(map(str, at[lo + i])) if some[lo + i] else "none"
                if not some[lo + i]:
                    open_(cell)
                occupied.add(cell)
                read.add(cell)
                changed.add(cell)
                first[i] = held.put(cell, names[lo + i], 0, turn, part[i])
                if some[lo + i]:
                    fresh.append(first[i])
            done = len(part) if full is None else full
            here = first[:done]
            again = here[~entered[:done]]
            np.add.at(held.counts, again, 1)
            changed.update(held.cells[np.unique(again)])
            out.append((seqs[lo : lo + done], held.ids[here], np.where(entered[:done], "kept", "confirmed")))
            lo += done
            if full is not None:  # of all cases the least confirmed leaves, the earliest of several
                for cell in occupied:
                    open_(cell)
                seq, name = seqs[lo], names[lo]
                i = int(np.lexsort((held.turns[: held.n], held.counts[: held.n]))[0])
                stays = held.counts[i] > 0
                out.append(([seq, seq], [name, name if stays else held.ids[i]], ["kept", "left"]))
                if not stays:
                    changed.add(held.cells[i])
                    held.drop(i)
                    cell = ",".join(map(str, at[lo])) if some[lo] else "none"
                    occupied.add(cell)
                    read.add(cell)
                    changed.add(cell)
                    held.put(cell, name, 0, turn, units[lo])
                lo += 1
            if sum(len(x[0]) for x in out[-64:]) > 50_000 or len(out) > 4096:
                yield self.events(key[0], out)
                out = []
        cells = held.cells[: held.n]
        for cell in changed:
            there = np.flatnonzero(cells == cell)
            there = there[np.argsort(held.turns[there])]
            if len(there):
                self.cells.updateValue((cell,), (held.ids[there].tolist(), held.counts[there].tolist(), held.turns[there].tolist(), held.units[there].ravel().tolist()))
            elif self.cells.containsKey((cell,)):
                self.cells.removeKey((cell,))
        self.totals.update((n, turn))
        yield self.events(key[0], out)

    @staticmethod
    def events(locus, parts):
        import numpy as np
        import pandas as pd

        seq, case_id, event = (np.concatenate([np.asarray(p[k], kind) for p in parts]) if parts else np.empty(0, kind) for k, kind in enumerate((None, object, object)))
        return pd.DataFrame({"locus": np.full(len(seq), locus, object), "seq": seq, "case_id": case_id, "event": event})

    def close(self) -> None:
        pass


def retain_feed(arrivals: DataFrame, duplicate: float = 0.95, most: int = 50_000) -> DataFrame:
    """Streams ``(seq, case_id, locus, situation)`` -> ``locus, seq, case_id, event``.

    The rule of :func:`ledgermark.operators.cases.retain`: a near copy of a case that its
    locus holds is ``confirmed`` for the first such case, anything else is ``kept`` and,
    over ``most``, another has ``left``. Arrivals of a micro-batch are taken in the order of
    seq. The state is a map for each locus, read and written by cell; it needs the RocksDB
    store, which is set for the session.
    """
    arrivals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    named = arrivals.where("situation is not null").select(F.col("locus").cast("string").alias("locus"), "seq", F.col("case_id").cast("string").alias("case_id"), F.col("situation").cast("array<double>").alias("situation"))
    return named.groupBy("locus").transformWithStateInPandas(CaseKeeper(duplicate, most), "locus string, seq long, case_id string, event string", "Append", "None")


def kept_cases(events: DataFrame) -> DataFrame:
    """Events of :func:`retain_feed` -> the cases held now and their confirmations."""
    by = events.groupBy("locus", "case_id").agg(F.count_if(F.col("event") == "confirmed").alias("confirmations"), F.count_if(F.col("event") == "left").alias("gone"))
    return by.where("gone = 0").select("locus", "case_id", "confirmations")
