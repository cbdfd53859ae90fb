"""Gradient boosting over binned features, with gradients of a record's ranking (LambdaRank).

Pairs are binned once and packed, whole records together, into blocks that later passes
read as arrays. A level of a tree is one pass: each task scores its blocks with the trees
so far, takes gradients, and adds them up by node, feature and bin; a grouped sum over
tasks gives at most ``2 ** depth * features * BINS`` rows, from which splits are chosen.
Gradients are summed as whole numbers, so the same rows give the same trees whatever
order the sums arrive in.

With one right key for each record, the gradient of a wrong candidate is the chance that
it outranks the right one under the present scores, times by how much swapping the two
would change the discounted gain; the right one gets the sum of these, negated.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed
from ledgermark.operators.features import PAIR

BINS = 32
#: Rows of a block, but for the last record's.
ROWS = 65_536
#: Gradients are summed in steps of one in so many.
UNIT = 1 << 20
SMOOTH = 1.0


@dataclass
class Forest:
    """Cuts of each feature and trees as heaps: feature, bin (larger goes right) and values of leaves."""

    columns: tuple[str, ...]
    cuts: list
    trees: list = field(default_factory=list)

    def bins(self, values):
        """Rows of feature values -> bins; what is no number is in the first."""
        import numpy as np

        out = np.empty(values.shape, np.uint8)
        for k, cut in enumerate(self.cuts):
            out[:, k] = np.searchsorted(cut, np.nan_to_num(values[:, k], nan=-np.inf), "left")
        return out

    def nodes(self, bins, tree, levels: int):
        import numpy as np

        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            at = 2 * at + 1 + (bins[rows, tree[0][at]] > tree[1][at])
        return at

    def margins(self, bins):
        import numpy as np

        out = np.zeros(len(bins))
        for tree in self.trees:
            depth = (len(tree[0]) + 1).bit_length() - 1
            out += tree[2][self.nodes(bins, tree, depth) - len(tree[0])]
        return out

    def scores(self, pairs: DataFrame) -> DataFrame:
        """``record_id, key, score``; higher is better within a record, and means nothing across records."""

        @F.pandas_udf("double")
        def margin(*columns):
            import numpy as np
            import pandas as pd

            return pd.Series(self.margins(self.bins(np.stack([np.asarray(c, float) for c in columns], 1))))

        return pairs.select("record_id", "key", margin(*self.columns).alias("score"))

    def text(self) -> str:
        return json.dumps({"columns": self.columns, "cuts": [list(map(float, c)) for c in self.cuts], "trees": [[x.tolist() for x in t] for t in self.trees]})

    @staticmethod
    def read(text: str) -> Forest:
        import numpy as np

        d = json.loads(text)
        return Forest(tuple(d["columns"]), [np.array(c) for c in d["cuts"]], [(np.array(f, np.int64), np.array(b, np.int64), np.array(v, float)) for f, b, v in d["trees"]])


def empty_forest(pairs: DataFrame, columns=PAIR, sample: int = 100_000) -> Forest:
    """Cuts at the quantiles of about ``sample`` rows, drawn by a hash of record and key."""
    import numpy as np

    some = -(-max(1, pairs.count()) // sample)
    drawn = pairs.where(F.pmod(F.xxhash64("record_id", "key"), F.lit(some)) == 0)
    marks = [k / BINS for k in range(1, BINS)]
    row = drawn.agg(*[F.percentile(c, marks).alias(c) for c in columns]).first()
    return Forest(tuple(columns), [np.unique(np.array(row[c] if row[c] is not None else [], float)) for c in columns])


def packed(pairs: DataFrame, forest: Forest, weight: str | None = None) -> DataFrame:
    """Training pairs ``(record_id, key, is_label, features)`` as a written table of blocks of whole records."""
    columns = list(forest.columns)
    rows = pairs.select("record_id", "key", F.col("is_label").cast("int").alias("is_label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), *columns)
    rows = rows.repartition("record_id").sortWithinPartitions("record_id", "key")

    def work(batches):
        import numpy as np
        import pandas as pd

        def block(part):
            change = np.flatnonzero(part["record_id"].to_numpy()[1:] != part["record_id"].to_numpy()[:-1]) + 1
            first = np.r_[0, change]
            bins = forest.bins(part[columns].to_numpy(float))
            sizes = np.diff(np.r_[first, len(part)])
            return {"n": len(part), "bins": bins.tobytes(), "sizes": sizes.astype(np.int32).tobytes(), "labels": part["is_label"].to_numpy(np.uint8).tobytes(), "weights": part["weight"].to_numpy(float)[first].tobytes()}

        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) >= ROWS:
                last = held["record_id"].iloc[-1]
                cut = int(np.flatnonzero(held["record_id"].to_numpy() != last)[-1]) + 1 if (held["record_id"] != last).any() else 0
                if cut:
                    yield pd.DataFrame([block(held.iloc[:cut].reset_index(drop=True))])
                    held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield pd.DataFrame([block(held)])

    return checkpointed(rows.mapInPandas(work, "n long, bins binary, sizes binary, labels binary, weights binary"))


def rank_gradients(score, sizes, labels, weights):
    """First and second derivatives of a record-wise ranking loss; records without a right row have none."""
    import numpy as np

    record = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    order = np.lexsort((-score, record))
    place = np.empty(len(score), np.int64)
    place[order] = np.arange(len(score)) - first[record]
    gain = 1 / np.log2(place + 2.0)
    right = np.flatnonzero(labels)
    right = right[np.r_[True, record[right[1:]] != record[right[:-1]]][: len(right)]]
    at = np.full(len(sizes), -1)
    at[record[right]] = right
    mine = at[record]
    other = (mine >= 0) & (np.arange(len(score)) != mine) & (labels == 0)
    behind = np.where(other, score[mine] - score, 0.0)
    chance = 1 / (1 + np.exp(np.clip(behind, -50, 50)))
    swap = np.abs(gain[mine] - gain) * weights[record]
    g = np.where(other, chance * swap, 0.0)
    h = np.where(other, chance * (1 - chance) * swap, 0.0)
    g_right, h_right = np.bincount(record, g, len(sizes)), np.bincount(record, h, len(sizes))
    g[right], h[right] = -g_right[record[right]], h_right[record[right]]
    return g, h


def point_gradients(score, sizes, labels, weights):
    """Of the log loss of each pair by itself, right ones weighing as much as all others together."""
    import numpy as np

    p = 1 / (1 + np.exp(-score))
    w = np.where(labels == 1, np.repeat(np.maximum(sizes - 1, 1), sizes), 1.0) * np.repeat(weights, sizes)
    return (p - labels) * w, p * (1 - p) * w


GRADIENTS = {"rank": rank_gradients, "point": point_gradients}


def _sums(forest: Forest, tree, level: int, objective: str):
    n_features = len(forest.columns)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        nodes = 1 << level
        total = np.zeros((3, nodes * n_features * BINS), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                bins = np.frombuffer(row["bins"], np.uint8).reshape(row["n"], n_features)
                sizes, labels = np.frombuffer(row["sizes"], np.int32).astype(np.int64), np.frombuffer(row["labels"], np.uint8).astype(np.int64)
                g, h = GRADIENTS[objective](forest.margins(bins), sizes, labels, np.frombuffer(row["weights"], float))
                g, h = np.rint(g * UNIT), np.rint(h * UNIT)
                node = forest.nodes(bins, tree, level) - (nodes - 1)
                for k in range(n_features):
                    at = (node * n_features + k) * BINS + bins[:, k]
                    for sums, x in zip(total, (g, h, None), strict=True):
                        sums += np.bincount(at, x, sums.size).astype(np.int64)
        hit = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), *[pa.array(x[hit], pa.int64()) for x in total]], names=["slot", "g", "h", "n"])

    return work


def grow(forest: Forest, blocks: DataFrame, trees: int = 12, depth: int = 4, rate: float = 0.3, objective: str = "rank", least_rows: int = 20) -> Forest:
    """``forest`` with ``trees`` more trees, grown on ``blocks`` level by level."""
    import numpy as np

    out = Forest(forest.columns, forest.cuts, list(forest.trees))
    n_features = len(forest.columns)
    for _ in range(trees):
        inner = (1 << depth) - 1
        tree = (np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(1 << depth))
        for level in range(depth):
            nodes = 1 << level
            found = blocks.mapInArrow(_sums(out, tree, level, objective), "slot long, g long, h long, n long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
            sums = np.zeros((3, nodes * n_features * BINS))
            sums[:, found["slot"].to_numpy(np.int64)] = found[["g", "h", "n"]].to_numpy(float).T
            g, h, n = sums.reshape(3, nodes, n_features, BINS) / np.array([UNIT, UNIT, 1])[:, None, None, None]
            left = np.cumsum(np.stack([g, h, n]), 3)
            whole = left[:, :, :, -1:]
            right = whole - left
            worth = left[0] ** 2 / (left[1] + SMOOTH) + right[0] ** 2 / (right[1] + SMOOTH) - whole[0] ** 2 / (whole[1] + SMOOTH)
            worth = np.where((left[2] >= least_rows) & (right[2] >= least_rows), worth, -np.inf).reshape(nodes, -1)
            best = worth.argmax(1)
            for node in range(nodes):
                f, b = divmod(int(best[node]), BINS)
                at = nodes - 1 + node
                split = worth[node, best[node]] > 1e-9
                if split:
                    tree[0][at], tree[1][at] = f, b
                if level == depth - 1:  # a node without a split sends all to the left
                    sides = (left[:, node, f, b], right[:, node, f, b]) if split else (whole[:, node, 0, 0], np.zeros(3))
                    for side, s in enumerate(sides):
                        tree[2][2 * node + side] = -rate * s[0] / (s[1] + SMOOTH)
        out.trees.append(tree)
    return out


def fit_ranker(training: DataFrame, trees: int = 12, depth: int = 4, rate: float = 0.3, objective: str = "rank") -> Forest:
    """From :func:`ledgermark.operators.rank.training_pairs`."""
    training = checkpointed(training.select("record_id", "key", "is_label", *PAIR))
    forest = empty_forest(training)
    return grow(forest, packed(training, forest), trees, depth, rate, objective)
