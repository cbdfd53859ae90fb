import json

import pytest
from pyspark.sql import functions as F

from ledgermark.operators import narrate
from ledgermark.operators.audit import Trail
from ledgermark.operators.evaluate import temporal_split
from ledgermark.plans import run
from ledgermark.plans.queries import View
from tests.conftest import DATA


@pytest.fixture(scope="module")
def view(spark):
    return View(spark, DATA)


def test_a_run_is_recorded(spark, view, tmp_path):
    trail = Trail(spark, str(tmp_path / "t"))
    run_id, summary = run.run_batch(view.bank, view.ledger, trail, "someone")
    assert trail.status(run_id) == "completed" and sum(r["count"] for r in summary.collect()) == view.bank.count()
    with pytest.raises(Exception, match="amount_minor"):
        run.run_batch(view.bank.drop("amount_minor"), view.ledger, trail, "someone")
    assert sorted(r["status"] for r in trail.runs().collect()) == ["completed", "failed"]


def test_uploads_end_to_end(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,account,amount,date\nb1,A,100.00,2026-03-01\nb2,A,20000.00,2026-03-01\nb3,B,5.00,2026-03-01\n")
    (tmp_path / "l.csv").write_text("key,account,amount,date\nINV-0,A,100.00,2026-03-02\nINV-1,A,12000.00,2026-03-01\nINV-2,A,8000.00,2026-03-01\nINV-3,A,3300.00,2026-03-01\n")
    got = run.reconcile_files(spark, str(tmp_path / "b.csv"), str(tmp_path / "l.csv"))
    by = {r["amount_minor"]: r for r in got["decisions"].collect()}
    assert by[10000]["key"] == "INV-0" and by[2000000]["outcome"] == "suspected_grouped" and by[500]["outcome"] == "no_candidate"
    assert [r["members"] for r in got["proposals"].collect()] == ["INV-1,INV-2"] and got["confidence_validated_for_this_data"] is False


def test_bundle(spark, view, tmp_path):
    splits = temporal_split(view.bank).select(F.col("grp").alias("match_id"), "split")
    bundle = run.train(view.bank, view.ledger, splits, trees=3)
    bundle.save(spark, str(tmp_path / "m"))
    again = run.Bundle.load(spark, str(tmp_path / "m"))
    a, b = (sorted(map(tuple, run.plan(view.bank, view.ledger, bundle=x).select("record_id", "outcome", "key", "confidence").collect()), key=repr) for x in (bundle, again))
    assert a == b and len(a) == view.bank.count()
    manifest = tmp_path / "m" / "manifest"
    part = next(manifest.glob("part-*"))
    text = json.loads(part.read_text())
    text["pair"] = text["pair"][::-1]
    spark.createDataFrame([(json.dumps(text),)], "value string").coalesce(1).write.mode("overwrite").text(str(manifest))
    with pytest.raises(ValueError, match="features"):
        run.Bundle.load(spark, str(tmp_path / "m"))


def test_narration(spark):
    rows = spark.createDataFrame([("a", "FX_DIFFERENCE", -250, 25000, 1), ("b", "FX_DIFFERENCE", -250, 25000, 1), ("c", "ROUNDING", 1, 900, 1), ("d", "ROUNDING", 2, 900, 2)], "record_id string, cause string, residual long, amount long, n_rows long")

    def writer(items):
        out = []
        for x in json.loads(items):
            figure = {-250: "2.50", 1: "77", 2: "2"}[x["residual"]]
            out.append({"situation": x["situation"], "cause": "BANK_CHARGE" if x["residual"] != 2 else "NOPE", "sentence": f"A gap of {figure}."})
        return "Here: ```json\n" + json.dumps(out) + "\n```"

    got = {r["record_id"]: r for r in narrate.narrated(rows, writer).collect()}
    assert got["a"]["sentence"] == got["b"]["sentence"] == "A gap of 2.50." and got["a"]["source"] == "writer"
    assert got["c"]["source"] == got["d"]["source"] == "template"

    def broken(items):
        raise OSError("no service")

    assert {r["source"] for r in narrate.narrated(rows, broken).collect()} == {"template"}
    assert narrate.json_part('x {"a": [1]} y') in ([1], {"a": [1]}) and narrate.json_part("none") is None


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Some

    from ledgermark.functions.order import shared_dir

    def session(master, path=None):
        conf = Some(get=lambda k, default=None: path)
        return Some(conf=conf, sparkContext=Some(master=master, getConf=lambda: conf))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("spark://host:7077", "s3a://b/x/")) == "s3a://b/x" and shared_dir(session("local[2]"))


def test_better_calibrator_is_picked(spark, tmp_path):
    import math

    from pyspark.ml import PipelineModel

    from ledgermark.operators import models

    def rows(right):
        return spark.createDataFrame([(f"r{i}", m, int(right(m, (i * 7919) % 997 / 997))) for i in range(2000) for m in [(i * 31) % 100 / 10]], "record_id string, margin double, right int")

    steps = rows(lambda m, u: u < (0.02 if m < 1 else 0.5 if m < 9 else 0.98))  # rises in steps that no sigmoid follows
    kind, model = models.pick_calibrator(steps)
    assert kind == "isotonic"
    sigmoid = rows(lambda m, u: u < 1 / (1 + math.exp(2 - m)))
    at = {r["margin"]: r["confidence"] for r in models.calibrated(models.fit_platt(sigmoid), sigmoid).collect()}
    assert all(abs(p - 1 / (1 + math.exp(2 - m))) < 0.1 for m, p in at.items())
    model.save(str(tmp_path / "c"))
    again = PipelineModel.load(str(tmp_path / "c"))
    assert models.calibrated(again, steps).columns == ["record_id", "margin", "right", "confidence"]
