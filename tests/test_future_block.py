"""A behaviour model with planted signal, saved and loaded, against a block it never saw."""

import random

import pytest

from rankloom.operators import learned

SCHEMA = "event_seq long, query_id long, product_id long, ctr double, clicked int"


def planted(n, seed, flip=0.05):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = rng.random()
        out.append((i, i % 15, rng.randint(0, 30), x, int((x > 0.6) != (rng.random() < flip))))
    return out


def test_saved_model_tells_clicks_of_the_future_block(spark, tmp_path):
    train, later, future = (spark.createDataFrame(planted(n, s), SCHEMA) for n, s in ((800, 1), (400, 2), (400, 3)))
    future = future.withColumn("noise", future["product_id"] * 0.01)
    judged = spark.createDataFrame([(q, p, (p * 7 + q) % 4) for q in range(15) for p in range(31)], "query_id long, product_id long, relevance int")
    learned.fit_calibrated(train, later, ["ctr"], "clicked").save(f"{tmp_path}/m")
    model = learned.Calibrated.load(spark, f"{tmp_path}/m")
    got = {r.metric: r.value for r in learned.future_audit(model, future, judged, "clicked", "noise").collect()}
    assert len(got) == 10 and got["future_behavior_roc_auc"] > 0.85 and got["future_behavior_uncalibrated_roc_auc"] == pytest.approx(got["future_behavior_roc_auc"])
    assert got["future_behavior_brier"] < 0.15 and 0 < got["future_behavior_ece"] < 0.25
    assert 0 < got["future_logged_base_ndcg_at_10"] <= 1 and got["future_logged_final_ndcg_at_10"] != got["future_logged_base_ndcg_at_10"]
    once = model.transform(future).where("event_seq = 5").first()
    assert learned.CLIP <= once.p <= 1 - learned.CLIP and set(once.asDict()) == {"event_seq", "query_id", "product_id", "ctr", "clicked", "noise", "p", "p_raw"}


def test_one_outcome(spark, tmp_path):
    train, later = spark.createDataFrame(planted(200, 1), SCHEMA), spark.createDataFrame(planted(50, 2), SCHEMA)
    with pytest.raises(ValueError, match="both outcomes"):
        learned.fit_calibrated(train.where("clicked = 1"), later, ["ctr"], "clicked")
    plain = learned.fit_calibrated(train, later.where("clicked = 0"), ["ctr"], "clicked")
    plain.save(f"{tmp_path}/m")
    assert plain.platt is None and all(r.p == r.p_raw for r in learned.Calibrated.load(spark, f"{tmp_path}/m").transform(later).collect())
