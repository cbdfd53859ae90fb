"""Language identification: held-out accuracy, Viterbi against brute force, mixed texts and edge cases."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermark.llm import languages
from tests.conftest import DATA

DOCS = "doc_id long, text string, lang string, score int, spans string"
SAMPLE = {
    "en": "the of and to in that with which from were this have their been there what when",
    "de": "der die und das nicht mit eine auch sich werden durch zwischen für über haben schön",
    "ru": "что как это все они был она так его только мне было вот меня ещё нет",
    "ja": "これは日本語の文章です そして私たちはここにいます",
}


def made(rng, lang, n):
    return " ".join(rng.choice(SAMPLE[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    rows = [(i, made(rng, lang, 60), lang, 1, "x") for i, lang in enumerate([*SAMPLE] * 10)] + [(900, None, "en", 1, ""), (901, "zzz qqq", None, 1, ""), (902, "123", "xx", 1, "")]
    return languages.learned(spark.createDataFrame(rows, DOCS).repartition(3))


def test_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = languages.op13_language(spark, DATA).join(docs, "doc_id").where("held_out").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert got[0] > 40
    assert got[1] > 0.97


def test_folds(spark):
    import zlib

    got = spark.range(50).select("id", languages.fold_of(F.col("id")).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(str(r.id).encode()) % 3 for r in got]


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = [0, 6, 1, 3, 0, 5, 2]
    score, prior = -rng.random((sum(sizes), 3)).astype(np.float32) * 9, np.log([0.5, 0.3, 0.2])
    cut = np.cumsum([0, *sizes])
    got = languages.best_labels(score, cut, prior, 4.0)

    def worth(path, s):
        return prior[path[0]] + sum(float(s[t][p]) for t, p in enumerate(path)) - 4.0 * sum(a != b for a, b in itertools.pairwise(path))

    for a, b in itertools.pairwise(cut):
        if a < b:
            best = max(worth(p, score[a:b]) for p in itertools.product(range(3), repeat=int(b - a)))
            assert worth(got[a:b].tolist(), score[a:b]) == pytest.approx(best, abs=1e-4)


def test_words():
    text = "Ab c-d é 12 日本ごabc नमस्ते x"
    w = languages.Words(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert [text[a:b] for a, b in zip(w.start, w.end, strict=True)] == ["Ab", "c", "d", "é", "日本", "ご", "abc", "नमस्ते", "x"]
    assert w.letters.tolist() == [2, 1, 1, 1, 2, 1, 3, 4, 1]


def test_mixed_and_edges(spark, model, monkeypatch):
    assert model["langs"] == ["de", "en", "ja", "ru"]
    rng = random.Random(9)
    parts = [("en", made(rng, "en", 30)), ("de", made(rng, "de", 80)), ("ru", made(rng, "ru", 8)), ("en", made(rng, "en", 20)), ("ja", SAMPLE["ja"])]
    mixed = ". ".join(t for _, t in parts)
    texts = [None, "", "123 -- !", "the\x00of", mixed, mixed, "ΑΒΓ δοκιμή", "ещё", made(rng, "de", 40_000), "th" * 5000, "THE AND OF WITH WHICH"]
    docs = spark.createDataFrame([(None if i == 10 else i, t, "??", 7, "s") for i, t in enumerate(texts)], DOCS).repartition(2)
    got = {r["doc_id"]: r for r in languages.identify(docs, model).collect()}
    assert {k: r["lang_pred"] for k, r in got.items()} == {0: "und", 1: "und", 2: "und", 3: "en", 4: "de", 5: "de", 6: max(zip(model["letters"], model["langs"]))[1], 7: "ru", 8: "de", 9: "en", None: "en"}
    assert got[4][1:] == got[5][1:]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[k]["score"] for k in (0, 1, 2, 6, 8)] == [0, 0, 0, 0, 1]
    spans = [(mixed[s["start"] : s["end"]], s["lang"]) for s in got[4]["spans"]]
    assert spans == [(re.sub(r"\W+$", "", t), lang) for lang, t in parts]
    monkeypatch.setattr(languages, "PIECE", 37)  # pieces change nothing
    a = languages.scored(model, [mixed, "", "x"])
    monkeypatch.undo()
    for x, y in zip(a, languages.scored(model, [mixed, "", "x"]), strict=True):
        assert np.allclose(x, y, atol=1e-3) if x.dtype == np.float32 else (x == y).all()
    assert languages.identify(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in languages.identify(docs, None).collect()} == {"und"}
    assert languages.learned(docs.limit(0)) is None
    with pytest.raises(ValueError, match="over 3"):
        languages.learned(spark.createDataFrame([(1, "a", c, 1, "") for c in "abcd"], DOCS), most=3)
