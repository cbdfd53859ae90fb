"""Near copies of the pipeline's stage, against brute force."""

import random
import re

import pytest

import corpus_pipeline as cp
from ledgermark.llm import jaccard
from tests.conftest import DATA


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def grouped(sets):
    """The first of each set's group, by brute force."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [256, 3])
def test_groups_equal_brute_force(spark, block):
    random.seed(9)
    texts = ["", " \t", None, "one two", "ONE two", "one two three"]
    for _ in range(12):
        base = [random.choice("abcdefghijkl") + str(random.randrange(40)) for _ in range(random.randint(8, 150))]
        for _ in range(6):
            words = list(base)
            for _ in range(random.randint(0, 4)):
                words[random.randrange(len(words))] = random.choice(["x", "y", "z"])
            texts.append(" ".join(words))
    want = grouped([shingles(t) for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component"] for r in jaccard.groups(df, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == want and 20 < len(set(want)) < len(texts) - 10


def test_stage_finds_copies_many_bits_apart(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:20], "other", *base[21:]]), " ".join([*base[:10], "an", "other", *base[30:]])]
    kind = spark.read.parquet(f"{DATA}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], kind)
    assert sorted(r["doc_id"] for r in cp.near_dedup(spark, docs, DATA).collect()) == [0, 2]
