"""Line dedup of lines without small Latin letters, against brute force."""

import random

import pytest

from ledgermark.llm import lines
from tests.llm.test_operators import edits

ALPHABETS = {"digits": "0123456789", "cyrillic": "абвгдежзийклмнопЯЮЩ", "greek": "αβγδεζηςσΣΩ", "han": "".join(map(chr, range(0x4E00, 0x4E40))), "capitals": "ETAOINSR İı", "mixed": "a1б σ9Ω中é"}


@pytest.mark.parametrize("kind", sorted(ALPHABETS))
def test_brute_force(spark, kind):
    rng = random.Random(7)
    some = ALPHABETS[kind]
    base = ["".join(rng.choice(some) for _ in range(rng.randint(4, 14))) for _ in range(25)]

    def edited(s):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice(some) + s[i:], s[:i] + rng.choice(some) + s[i + 1 :]])
        return s

    texts = ["\n".join(edited(rng.choice(base)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), short=True).collect()}
    first = {}
    for k, t in enumerate(texts):
        for pos, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (k, pos))
    gone = {a for a in first if len(a) > 2 and any(len(b) > 2 and first[b] < first[a] and edits(a, b) <= 2 for b in first)}
    assert len(gone) > 5
    for k, t in enumerate(texts):
        assert got[k] == "\n".join(line for pos, line in enumerate(t.split("\n")) if not line.strip() or (first[line] == (k, pos) and line not in gone))
