"""The case base: which corrections are kept as cases, and which cases are like a new record.

Retention is order-dependent: an arrival confirms the earliest kept case of its locus that is
a near copy, or else is kept. That is the lexicographically first independent set of the
near-copy relation, so it can be found in blocks: the first undecided arrivals of a locus
(at most ``block``) are worked through in order, what they keep is sent to tiles of all the
rest, where a matrix product compares them, and matched arrivals leave. Each round decides
a block and everything like it; no task holds a locus and no pairs among arrivals are
made. Only a locus that keeps more than ``most`` cases, where each further case drives one
out, goes through one task that holds ``most`` cases and takes its arrivals as they come.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed
from ledgermark.functions.similarity import dot

DIRECTIONS = 3
#: Arrivals that are compared with kept cases in one go.
TILE = 16_384
#: By how much sums in another order may differ.
ROUNDING = 1e-12
#: Rows of a block of retrieval, cases of a run in it, and queries that visit a block together.
BLOCK, RUN, VISITS = 4096, 16, 20_000


def unit(situation: Column) -> Column:
    """The vector at length 1; null where its length is 0."""
    # bound as a variable, or it would be computed again for each component
    norm = F.array(F.sqrt(dot(situation, situation)))
    return F.get(F.transform(norm, lambda n: F.when(n > 0, F.transform(situation, lambda x: x.cast("double") / n))), F.lit(0))


def _in_block(duplicate: float):
    """Works through the first arrivals of a locus in order; returns those that are kept."""

    def work(pdf):
        import numpy as np

        pdf = pdf.sort_values(["seq", "case_id", "_id"])
        vectors = np.stack(pdf["_unit"].to_numpy())
        places = np.empty(0, np.int64)
        for lo in range(0, len(vectors), 256):
            part = vectors[lo : lo + 256]
            met = (part @ vectors[places].T >= duplicate - ROUNDING).any(1)
            alike = part @ part.T >= duplicate - ROUNDING
            here: list[int] = []
            for i in np.flatnonzero(~met):
                if not alike[i, here].any():
                    here.append(i)
            places = np.concatenate([places, lo + np.array(here, np.int64)])
        return pdf.iloc[places]

    return work


def _first_met(duplicate: float):
    """Of a tile of arrivals: the first of the cases just kept, by ``_r``, that each matches; a kept case is its own, whatever rounding says."""

    def work(pdf, new):
        import numpy as np
        import pandas as pd

        if pdf.empty or new.empty:
            return pd.DataFrame({"_l": [], "_at": [], "_id": []})
        new = new.sort_values("_r")
        ids, names = new["_id"].to_numpy(), pdf["_id"].to_numpy()
        kept, step, by = np.stack(new["_unit"].to_numpy()).T, max(1, 4_000_000 // len(new)), []
        for lo in range(0, len(pdf), step):
            near = np.stack(pdf["_unit"].to_numpy()[lo : lo + step]) @ kept >= duplicate - ROUNDING
            by.append(np.where(near.any(1), ids[near.argmax(1)], -1))
        by = np.where(np.isin(names, ids), names, np.concatenate(by))
        met = by >= 0
        return pd.DataFrame({"_l": pdf["_l"].to_numpy()[met], "_at": names[met], "_id": by[met]})

    return work


def retain(arrivals: DataFrame, duplicate: float = 0.95, most: int = 50_000, block: int = 4096) -> DataFrame:
    """``arrivals(seq, case_id, locus, situation)`` in order of seq, then case_id -> ``locus, case_id, confirmations`` of kept cases.

    A near copy confirms the first kept case of its locus that it matches instead of
    entering; over ``most`` in a locus the least confirmed leaves, the earliest of several.
    Arrivals without a situation take no part; a situation of length 0 is like no other;
    null is a locus of its own; repeated rows are arrivals of their own.
    """
    rows = arrivals.where("situation is not null").select("seq", "case_id", "locus", F.coalesce(F.concat(F.lit("="), F.col("locus").cast("string")), F.lit("null")).alias("_l"), "situation").withColumn("_unit", unit(F.col("situation")))
    rows = checkpointed(rows.withColumn("_id", F.monotonically_increasing_id()))
    left = rows.where("_unit is not null").select("_l", "seq", "case_id", "_id", "_unit")
    # which tile of its locus an arrival is in, for good
    tiles = checkpointed(left.groupBy("_l").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_n")))
    left = left.join(tiles, "_l").withColumn("_t", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int")).drop("_n")
    schema = f"{left.schema.simpleString()[7:-1]},_r:int"
    lone = rows.where("_unit is null").select("_l", "_id", F.lit(0).cast("long").alias("confirmations"))
    kept, done, over = lone, lone.select("_l"), None
    while not left.isEmpty():
        first = Window.partitionBy("_l").orderBy("seq", "case_id", "_id")
        head = left.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= block)
        new = checkpointed(head.groupBy("_l").applyInPandas(_in_block(duplicate), schema))
        sent = new.join(tiles, "_l").select("_l", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_t"), "_id", "_unit", "_r")
        met = left.select("_l", "_t", "_id", "_unit").groupBy("_l", "_t").cogroup(sent.groupBy("_l", "_t")).applyInPandas(_first_met(duplicate), "_l string, _at long, _id long")
        met = checkpointed(met)
        kept = kept.union(met.groupBy("_l", "_id").agg((F.count("*") - 1).alias("confirmations")))
        done = checkpointed(done.union(new.select("_l")))
        full = done.groupBy("_l").count().where(F.col("count") > most).select("_l")
        over = checkpointed(full)
        left = checkpointed(left.join(met.select("_at"), F.col("_id") == F.col("_at"), "left_anti").join(over, "_l", "left_anti"))
    out = rows.select("_id", "locus", "case_id")
    if over is None or over.isEmpty():
        return out.join(kept.select("_id", "confirmations"), "_id").select(F.col("locus").cast("string").alias("locus"), "case_id", "confirmations")
    few = out.join(kept.join(over, "_l", "left_anti").select("_id", "confirmations"), "_id")
    # every locus that is over stays so, as kept cases only grow in number
    many = rows.join(over, "_l", "left_semi").repartition("_l").sortWithinPartitions("_l", "seq", "case_id", "_id")
    many = many.select("_l", "locus", "case_id", "situation").mapInPandas(_in_turn(duplicate, most), "locus string, case_id string, confirmations long")
    return few.select(F.col("locus").cast("string").alias("locus"), F.col("case_id").cast("string").alias("case_id"), "confirmations").union(many)


class Shelf:
    """Cases of one locus within a task, in slots that are used again."""

    def __init__(self, most: int):
        import numpy as np

        self.most, self.n, self.turn = most, 0, 0
        self.ids: list = []
        self.counts, self.turns, self.units = np.zeros(64, np.int64), np.zeros(64, np.int64), None

    def take(self, case_id, v, duplicate: float) -> None:
        import numpy as np

        v = np.asarray(v, float)
        norm = float(np.linalg.norm(v))
        if self.units is None:
            self.units = np.zeros((64, len(v)))
        hits = np.flatnonzero(self.units[: self.n] @ (v / norm) >= duplicate - ROUNDING) if self.n and norm else []
        if len(hits):
            self.counts[hits[np.argmin(self.turns[hits])]] += 1
            return
        self.turn += 1
        if self.n < self.most:
            if self.n == len(self.counts):
                self.counts, self.turns, self.units = (np.concatenate([x, np.zeros_like(x)]) for x in (self.counts, self.turns, self.units))
            slot, self.n = self.n, self.n + 1
            self.ids.append(case_id)
        else:
            least = np.flatnonzero(self.counts == self.counts.min()) if self.n == len(self.counts) else np.flatnonzero(self.counts[: self.n] == self.counts[: self.n].min())
            slot = least[np.argmin(self.turns[least])]
            if self.counts[slot] > 0:
                return  # the new case is the least confirmed itself
            self.ids[slot] = case_id
        self.counts[slot], self.turns[slot] = 0, self.turn
        self.units[slot] = v / norm if norm else v

    def frame(self, locus):
        import pandas as pd

        return pd.DataFrame({"locus": [locus] * self.n, "case_id": self.ids, "confirmations": self.counts[: self.n]})


def _in_turn(duplicate: float, most: int):
    def work(batches):
        key = shelf = locus = None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row[0] != key:
                    if shelf is not None:
                        yield shelf.frame(locus)
                    key, locus, shelf = row[0], row[1], Shelf(most)
                shelf.take(row[2], row[3], duplicate)
        if shelf is not None:
            yield shelf.frame(locus)

    return work


# retrieval

def retrieve(queries: DataFrame, cases: DataFrame, k: int = 5, least: float = 0.85, also: Column | None = None, pivots: int = 32, compared=None, own: bool = True, digits: int | None = None) -> DataFrame:
    """``queries(query_id, locus, situation)`` against ``cases(case_id, locus, situation, retired)`` -> ``query_id, case_id, similarity, rank``: the ``k`` most similar of the locus at ``least`` or more, ties by case_id, of pairs that ``also`` allows (of ``query_id`` and ``case_id``).

    Exact, in two looks. Queries and cases are sorted along a curve through their places on
    three directions and cut into blocks. A query is compared with ``pivots`` cases on either
    side of it, then with the cases of its block that this leaves; the k-th similarity there,
    or ``least``, bounds how far off any better case is. Then it visits the blocks whose box
    this distance reaches, and there the runs of cases whose box it reaches, so the denser the
    cases lie the fewer are compared. Each case is held by one block, and travels once for
    each :data:`VISITS` queries that come to it. Vectors of length 0 have similarity 0 to all.

    Without ``also``, equal vectors are searched for once, and of equal cases only the first
    few are looked at, as later ones can't be among the ``k``. ``own`` is whether a query may
    find the case of its own id. With ``digits`` similarities that are equal when rounded are
    ties. ``compared``, if given, is called with the number of pairs compared at most.
    """
    usable = cases.where("not retired and situation is not null and locus is not null").select("case_id", "locus", "situation")
    asked = queries.where("situation is not null and locus is not null").select("query_id", "locus", "situation")
    allowed = F.lit(True) if also is None else also
    if not own:
        allowed = allowed & (F.col("query_id") != F.col("case_id"))
    if least <= 0:  # every case of the locus may count, those of length 0 too
        pairs = asked.alias("q").join(usable.alias("c"), (F.col("q.locus") == F.col("c.locus")) & allowed)
        return _top(pairs.select("query_id", "case_id", F.coalesce(dot(unit(F.col("q.situation")), unit(F.col("c.situation"))), F.lit(0.0)).alias("similarity")).where(F.col("similarity") >= least), k, digits)
    usable, asked = (d.withColumn("u", unit(F.col("situation"))).where(F.col("u").isNotNull() & ~F.exists("u", F.isnan)).drop("situation") for d in (usable, asked))
    if also is not None:
        held = usable.select("locus", "u", F.array("case_id").alias("ids"))
        wanted = asked.select(F.col("query_id").alias("_q"), "locus", "u")
        need, fits = k, allowed
    else:
        need, fits = k + (not own), F.lit(True)
        first = Window.partitionBy("locus", "u").orderBy("case_id")
        held = usable.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= need).groupBy("locus", "u").agg(F.collect_list("case_id").alias("ids"))
        asked = checkpointed(asked)
        wanted = asked.select("locus", "u").distinct().withColumn("_q", F.monotonically_increasing_id())
    held, wanted = checkpointed(held.withColumn("at", places(F.col("u")))), checkpointed(wanted.withColumn("at", places(F.col("u"))))
    equal = 1e-12 + (2 * 10.0**-digits if digits is not None else 0.0)

    sides = held.select("locus", "u", "ids", F.lit(None).cast(wanted.schema["_q"].dataType).alias("_q"), "at").union(wanted.select("locus", "u", F.lit(None).cast(held.schema["ids"].dataType), "_q", "at"))
    sides = sides.withColumn("_z", along_curve(F.col("at"))).withColumn("_n", F.size("u")).repartitionByRange("locus", "_n", "_z").sortWithinPartitions("locus", "_n", "_z")
    ids, names, locus = (x.dataType.simpleString() for x in (held.schema["ids"], wanted.schema["_q"], held.schema["locus"]))
    bounds = [f"{side}{i}" for i in range(DIRECTIONS) for side in ("lo", "hi")]
    packs = checkpointed(sides.select("locus", "_n", "u", "at", "_z", "ids", "_q").mapInArrow(_blocks, f"block bigint, locus {locus}, _n int, held binary, places binary, ids array<{ids}>, wanted binary, asked binary, before binary, names array<{names}>, {', '.join(f'{b} double' for b in bounds)}"))

    looks = packs.where(F.size("names") > 0).select("block", "locus", "_n", "held", "places", "ids", "wanted", "asked", "before", "names")
    looks = looks.mapInArrow(_own(pivots, need, least, equal, 0 if also is None else 2 * need), f"block bigint, locus {locus}, _n int, _q {names}, u binary, at array<double>, _least double, _pairs bigint, _near array<{ids}>, _sims array<double>")
    if also is not None:
        looks = checkpointed(looks)
        near = looks.select(F.col("_q").alias("query_id"), F.inline(F.arrays_zip("_near", "_sims"))).select("query_id", F.explode("_near").alias("case_id"), F.col("_sims").alias("similarity")).where((F.col("similarity") >= least) & fits)
        bound = _top(near, need).where(F.col("rank") == need).select(F.col("query_id").alias("_q"), (F.col("similarity") - equal).alias("_bound"))
        looks = looks.join(bound, "_q", "left").withColumn("_least", F.greatest("_least", F.coalesce("_bound", F.lit(least)))).drop("_bound")
    # vectors that are as near as that are no further apart along any direction
    far = F.least(F.lit(math.sqrt(2 - 2 * least) + 1e-9), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("_least"))) + 1e-9)
    looks = checkpointed(looks.drop("_near", "_sims").withColumn("_far", far))

    # blocks whose queries reach into others, then the queries themselves
    reach = looks.groupBy("block", "locus", "_n").agg(F.count("*").alias("n"), *[x for i in range(DIRECTIONS) for x in (F.min(F.col("at")[i] - F.col("_far")).alias(f"_lo{i}"), F.max(F.col("at")[i] + F.col("_far")).alias(f"_hi{i}"))])
    boxes = packs.where(F.col("lo0").isNotNull()).select(F.col("block").alias("to"), "locus", "_n", *bounds)
    ways = reach.join(boxes, ["locus", "_n"])
    for i in range(DIRECTIONS):
        ways = ways.where((F.col(f"_lo{i}") <= F.col(f"hi{i}")) & (F.col(f"_hi{i}") >= F.col(f"lo{i}")))
    ways = checkpointed(ways.select("block", "to", "n", *bounds))
    parts = checkpointed(ways.groupBy("to").agg(F.ceil(F.sum("n") / VISITS).cast("int").alias("parts")))
    visits = looks.select("block", "_q", "u", "at", "_far", "_least").join(ways.drop("n").join(parts, "to"), "block")
    for i in range(DIRECTIONS):
        visits = visits.where((F.col("at")[i] - F.col("_far") <= F.col(f"hi{i}")) & (F.col("at")[i] + F.col("_far") >= F.col(f"lo{i}")))
    visits = visits.select("to", F.pmod(F.xxhash64("_q"), F.col("parts")).cast("int").alias("part"), "_q", "u", "at", "_far", "_least")
    visited = packs.select(F.col("block").alias("to"), "held", "places", "ids").join(parts, "to").select("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "held", "places", "ids")
    met = visits.groupBy("to", "part").cogroup(visited.groupBy("to", "part")).applyInArrow(_visit(bool(compared)), f"_q {names}, ids {ids}, similarity double, _pairs bigint")
    if compared:
        met = checkpointed(met)
        compared(sum(d.agg(F.coalesce(F.sum("_pairs"), F.lit(0))).first()[0] for d in (met, looks)))
    met = met.where((F.col("similarity") >= least)).select(F.col("_q").alias("query_id"), F.explode("ids").alias("case_id"), "similarity")
    if also is not None:
        return _top(met.where(fits), k, digits)
    found = _top(met, need, digits).drop("rank").withColumnRenamed("query_id", "_q")
    named = asked.join(wanted.select("locus", "u", "_q"), ["locus", "u"]).select("query_id", "_q").join(found, "_q").drop("_q").where(allowed)
    return _top(named, k, digits)


def places(unit_vector: Column) -> Column:
    """The places of a unit vector on :data:`DIRECTIONS` fixed directions; no further apart than the vectors."""

    def along(k: int) -> Column:
        signed = F.transform(unit_vector, lambda x, i: F.when(F.pmod(F.xxhash64(i, F.lit(k)), F.lit(2)) == 0, x).otherwise(-x))
        return F.aggregate(signed, F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.size(unit_vector))

    return F.array(*[along(k) for k in range(DIRECTIONS)])


def along_curve(at: Column) -> Column:
    """Three places from -1 to 1 as one number that keeps near ones near: their bits in turn."""

    def spread(x: Column) -> Column:
        for by, mask in ((16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask).cast("long"))
        return x

    bits = [spread(F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at[k])) + 1) * 32767).cast("long")) for k in range(DIRECTIONS)]
    return bits[0].bitwiseOR(F.shiftleft(bits[1], 1)).bitwiseOR(F.shiftleft(bits[2], 2))


def _blocks(batches):
    """Rows sorted by locus, length and curve -> blocks of one locus and length, at most :data:`BLOCK` rows, as one row each with the box of its cases' places."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    def end(rows):
        few = rows.slice(0, BLOCK)
        locus, n, z = (few.column(c).to_numpy(zero_copy_only=False) for c in ("locus", "_n", "_z"))
        other = np.flatnonzero((locus != locus[0]) | (n != n[0]))
        if len(other):
            return int(other[0])
        if rows.num_rows <= BLOCK:
            return rows.num_rows
        # where the curve leaves the largest cube, so that boxes are small
        half = len(z) // 2
        return half + int(np.argmax(z[half:] ^ z[half - 1 : -1]))

    def packed(rows, number):
        n = rows.column("_n")[0].as_py()
        u, at = (_flat(rows.column(c)).reshape(-1, d) for c, d in (("u", n), ("at", DIRECTIONS)))
        is_case = rows.column("ids").is_valid().to_numpy(zero_copy_only=False)
        ids, names = rows.column("ids").filter(pa.array(is_case)).combine_chunks(), rows.column("_q").filter(pa.array(~is_case)).combine_chunks()
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (u[is_case], at[is_case], u[~is_case], at[~is_case], np.cumsum(is_case)[~is_case].astype(np.int64))]
        listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, names)]
        box = at[is_case]
        box = [pa.array([f(box[:, i]) if len(box) else None], pa.float64()) for i in range(DIRECTIONS) for f in (np.min, np.max)]
        cols = [pa.array([number], pa.int64()), rows.column("locus").slice(0, 1).combine_chunks(), pa.array([n], pa.int32()), *binary[:2], listed[0], *binary[2:], listed[1], *box]
        return pa.RecordBatch.from_arrays(cols, names=["block", "locus", "_n", "held", "places", "ids", "wanted", "asked", "before", "names", *[f"{side}{i}" for i in range(DIRECTIONS) for side in ("lo", "hi")]])

    rest, number = None, TaskContext.get().partitionId() << 33
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rest = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        while rest.num_rows > BLOCK:
            at = end(rest)
            yield packed(rest.slice(0, at), number)
            rest, number = rest.slice(at), number + 1
    while rest is not None and rest.num_rows:
        at = end(rest)
        yield packed(rest.slice(0, at), number)
        rest, number = rest.slice(at), number + 1


def _flat(column):
    """The numbers of an Arrow column of lists, one after the other."""
    return (column.combine_chunks() if hasattr(column, "combine_chunks") else column).flatten().to_numpy(zero_copy_only=False)


class _Cases:
    """A block's cases in runs along the curve, whose boxes tell which runs a query must be compared with."""

    def __init__(self, held, places):
        import numpy as np

        self.held, n = held, len(held)
        first = np.arange(0, n, RUN)
        self.lo, self.hi = (f.reduceat(places, first) if n else places for f in (np.minimum, np.maximum))

    def near(self, u, at, far, least):
        """Pairs (query, case, similarity) at the query's ``least`` or more, and the number of pairs compared."""
        import numpy as np

        out, pairs, dims = [], 0, self.held.shape[1]
        step = max(1, 2_000_000 // max(1, len(self.held)))
        for a in range(0, len(u) if len(self.held) else 0, step):
            v, p, d, bar = u[a : a + step], at[a : a + step], far[a : a + step, None], least[a : a + step]
            meets = np.ones((len(v), len(self.lo)), bool)
            for i in range(DIRECTIONS):
                meets &= (p[:, i, None] - d <= self.hi[:, i]) & (p[:, i, None] + d >= self.lo[:, i])
            row, run = np.nonzero(meets)
            if len(row) * 4 > meets.size:
                pairs += len(v) * len(self.held)
                q, c = np.nonzero(v @ self.held.T >= bar[:, None] - ROUNDING)
                out.append((a + q, c))
                continue
            pairs += len(row) * RUN
            some = max(1, 2_000_000 // (RUN * dims))
            for b in range(0, len(row), some):
                c = run[b : b + some, None] * RUN + np.arange(RUN)
                q = np.broadcast_to(row[b : b + some, None], c.shape)
                sims = np.einsum("pd,ped->pe", v[row[b : b + some]], self.held[np.minimum(c, len(self.held) - 1)])
                good = (sims >= bar[row[b : b + some], None] - ROUNDING) & (c < len(self.held))
                out.append((a + q[good], c[good]))
        q, c = (np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in (0, 1))
        # summed in the order of the components, so that equal cases have equal similarities
        sims = np.zeros(len(q))
        for j in range(dims):
            sims += u[q, j] * self.held[c, j]
        good = sims >= least[q]
        return q[good], c[good], sims[good], pairs


def _reach(least):
    import numpy as np

    return np.sqrt(np.maximum(0.0, 2 - 2 * least)) + 1e-9


def _own(each: int, need: int, least: float, equal: float, most: int):
    """Queries of a block with a bound of the ``need``-th similarity, from ``each`` cases on either side along the curve, then from the block's cases that this bound leaves.

    With ``most`` over 0 they come with their ``most`` best cases of the block instead, as only the caller knows which of them may be found.
    """

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def bounded(q, sims, copies, n):
            """For each query the similarity at which it has ``need`` cases, less what makes a tie."""
            out = np.full(n, least)
            order = np.lexsort((-sims, q))
            q, total = q[order], np.cumsum(copies[order])
            first = np.searchsorted(q, np.arange(n))
            before = np.concatenate([[0], total])[first]
            at = np.searchsorted(total, before + need)
            there = (at < len(q)) & (at >= first)
            there[there] = q[at[there]] == np.flatnonzero(there)
            out[there] = np.maximum(least, sims[order][at[there]] - equal)
            return out

        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                dims = row["_n"].as_py()
                held, places, u, at = (np.frombuffer(row[c].as_buffer(), np.float64).reshape(-1, d) for c, d in (("held", dims), ("places", DIRECTIONS), ("wanted", dims), ("asked", DIRECTIONS)))
                before, n, ids = np.frombuffer(row["before"].as_buffer(), np.int64), len(u), row["ids"].values
                copies = np.ones(len(held), np.int64) if most else ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                bars, pairs = np.full(n, least), 0
                step = max(1, 2_000_000 // (2 * each * dims))
                for lo in range(0, n if len(held) and not most else 0, step):
                    c = before[lo : lo + step, None] + np.arange(-each, each)
                    there = (c >= 0) & (c < len(held))
                    sims = np.einsum("qd,qed->qe", u[lo : lo + step], held[np.clip(c, 0, len(held) - 1)])
                    q, _ = np.nonzero(there)
                    bars[lo : lo + step] = bounded(q, sims[there], copies[c[there]], len(c))
                    pairs += int(there.sum())
                cases = _Cases(held, places)
                if most:  # some of them are tried at once, as any of them may be barred
                    q, c, sims, pairs = _best(cases, u, at, before, each, least, most)
                else:
                    q, c, sims, more = cases.near(u, at, _reach(bars), bars)
                    pairs += more
                    bars = np.maximum(bars, bounded(q, sims, copies[c], n))
                    q, c, sims = q[:0], c[:0], sims[:0]
                order = np.argsort(q, kind="stable")
                ends = pa.array(np.searchsorted(q[order], np.arange(n + 1)).astype(np.int32))
                same = lambda x: pa.array([x.as_py()] * n, x.type)
                count = np.zeros(n, np.int64)
                count[:1] = pairs
                yield pa.RecordBatch.from_arrays(
                    [same(row["block"]), same(row["locus"]), same(row["_n"]), row["names"].values, pa.array([x.tobytes() for x in u], pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), DIRECTIONS).cast(pa.list_(pa.float64())), pa.array(bars), pa.array(count), pa.ListArray.from_arrays(ends, ids.take(pa.array(c[order]))), pa.ListArray.from_arrays(ends, pa.array(sims[order]))],
                    names=["block", "locus", "_n", "_q", "u", "at", "_least", "_pairs", "_near", "_sims"],
                )

    return work


def _best(cases: _Cases, u, at, before, each: int, least: float, most: int):
    """The ``most`` best cases of a block for each query, at ``least`` or more."""
    import numpy as np

    found, pairs, n = [], 0, len(u)
    for lo in range(0, n if len(cases.held) else 0, step := max(1, 2_000_000 // (2 * max(each, most) * cases.held.shape[1]))):
        c = np.clip(before[lo : lo + step, None] - max(each, most), 0, max(0, len(cases.held) - 2 * max(each, most))) + np.arange(min(len(cases.held), 2 * max(each, most)))
        sims = np.einsum("qd,qed->qe", u[lo : lo + step], cases.held[c])
        pairs += sims.size
        bar = np.full(len(c), least)
        if sims.shape[1] >= most:
            bar = np.maximum(bar, np.partition(sims, sims.shape[1] - most, 1)[:, sims.shape[1] - most] - ROUNDING)
        q, c, sims, more = cases.near(u[lo : lo + step], at[lo : lo + step], _reach(bar), bar)
        order = np.lexsort((-sims, q))
        q, c, sims = q[order], c[order], sims[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < most
        found.append((lo + q[first], c[first], sims[first]))
        pairs += more
    return *(np.concatenate([f[i] for f in found]) if found else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, float))), pairs


def _visit(counted: bool):
    """Queries that reach into a block, or a part of them, against its cases."""

    def work(asked, block):
        import numpy as np
        import pyarrow as pa

        names = ["_q", "ids", "similarity", "_pairs"]
        if not asked.num_rows or not block.num_rows:
            return pa.table([asked.column("_q").slice(0, 0), pa.chunked_array([], block.column("ids").type.value_type), pa.array([], pa.float64()), pa.array([], pa.int64())], names=names)
        at, far, least = _flat(asked.column("at")).reshape(-1, DIRECTIONS), asked.column("_far").to_numpy(), asked.column("_least").to_numpy()
        u = np.frombuffer(b"".join(asked.column("u").to_pylist()), np.float64).reshape(len(at), -1)
        held, places = (np.frombuffer(block.column(c)[0].as_buffer(), np.float64).reshape(-1, d) for c, d in (("held", u.shape[1]), ("places", DIRECTIONS)))
        q, c, sims, pairs = _Cases(held, places).near(u, at, far, least)
        out = pa.table([asked.column("_q").take(pa.array(q)).combine_chunks(), block.column("ids")[0].values.take(pa.array(c)), pa.array(sims), pa.array(np.zeros(len(q), np.int64))], names=names)
        if counted:
            count = pa.table([asked.column("_q").slice(0, 1), block.column("ids")[0].values.slice(0, 1), pa.array([-2.0]), pa.array([pairs], pa.int64())], names=names)
            out = pa.concat_tables([out, count])
        return out

    return work


def _top(found: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    by = F.col("similarity") if digits is None else F.round("similarity", digits)
    best = Window.partitionBy("query_id").orderBy(by.desc(), "case_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
