"""The streamed case keeper by itself, on a store of plain dictionaries, and the parts of its query."""

import os

import numpy as np
import pandas as pd
import pytest

from ledgermark.operators.cases import Shelf
from ledgermark.plans import queries
from ledgermark.streaming import feed
from tests.conftest import DATA


class Store:
    def __init__(self):
        self.held, self.reads, self.total = {}, 0, None

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        store = self

        class Value:
            exists = lambda _: store.total is not None
            get = lambda _: store.total

            def update(self, x):
                store.total = x

        return Value()

    def keys(self):
        return [(k,) for k in self.held]

    def getValue(self, key):
        self.reads += 1
        return self.held[key[0]]

    def updateValue(self, key, value):
        self.held[key[0]] = value

    def containsKey(self, key):
        return key[0] in self.held

    def removeKey(self, key):
        del self.held[key[0]]


@pytest.mark.parametrize(("most", "spread", "n"), [(50_000, 0.0, 6000), (40, 0.0, 1500), (40, 0.05, 3000), (7, 0.3, 800)])
def test_blocks_keep_what_turns_keep(most, spread, n):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 4))
    vectors = centres[rng.integers(0, 60, n)] + spread * rng.normal(size=(n, 4))
    vectors[:: n // 5] = 0
    rows = pd.DataFrame({"seq": np.arange(n) // 3, "case_id": [f"c{i:05d}" for i in range(n)], "situation": list(vectors)})
    keeper, store = feed.CaseKeeper(0.95, most), Store()
    keeper.init(store)
    cut = n // 6 * 3
    batches = [rows.iloc[:cut].sample(frac=1, random_state=1), rows.iloc[cut:].sample(frac=1, random_state=2)]
    events = pd.concat([e for b in batches for e in keeper.handleInputRows(("x",), iter([b.iloc[::2], b.iloc[1::2]]), None)])
    shelf = Shelf(most)
    for r in rows.itertuples():
        shelf.take(r.case_id, r.situation, 0.95)
    want = dict(zip(shelf.ids, shelf.counts[: shelf.n].tolist(), strict=True))
    assert {i: c for ids, counts, *_ in store.held.values() for i, c in zip(ids, counts, strict=True)} == want
    counts = events["event"].value_counts().to_dict()
    assert counts["kept"] + counts.get("confirmed", 0) == n and counts["kept"] - counts.get("left", 0) == len(want)
    # a cell is read once in a micro-batch, however many arrivals come near it
    assert store.reads <= 60 + 5


def test_tied_arrivals_go_by_name():
    rows = pd.DataFrame({"seq": [5, 2, 5, 1, 2, 5], "case_id": ["b", "z", None, "q", "a", "a"]})
    got = feed.in_turn(rows)
    assert got["case_id"].where(got["case_id"].notna(), None).tolist() == ["q", "a", "z", "a", "b", None]


def test_a_larger_table_makes_more_micro_batches_of_several_files(spark, monkeypatch):
    want = sorted(map(tuple, queries.QUERIES["dispute_cases_streamed"](spark, DATA).collect()))
    monkeypatch.setattr(queries, "ARRIVALS", 400)
    roots = []
    monkeypatch.setattr(queries, "scratch_path", lambda s, real=queries.scratch_path: roots.append(real(s)) or roots[-1])
    assert sorted(map(tuple, queries.QUERIES["dispute_cases_streamed"](spark, DATA).collect())) == want
    # the stream's commits have a file for each micro-batch
    commits = [f for f in os.listdir(f"{roots[0].removeprefix('file://')}/state/commits") if f.isdigit()]
    assert len(commits) >= 5
