"""Images, policies, strategy metrics, differences, and jobs with each trainer."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.features import difference, flatten, ingest, packed
from tessella.functions import images
from tessella.models import policies, store
from tessella.operators import strategy
from tessella.plans import config, jobs
from tessella.sources import scans


def png(rgb):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, _ = rgb.shape
    body = b"".join(b"\0" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_image_features(spark, tmp_path):
    rng = np.random.default_rng(3)
    noise, tiny = rng.integers(0, 256, (30, 42, 3)).astype(np.uint8), np.full((4, 4, 3), 9, np.uint8)
    for name, pixels in (("noise", noise), ("tiny", tiny)):
        (tmp_path / f"{name}.png").write_bytes(png(pixels))
    (tmp_path / "broken.png").write_bytes(b"no image")
    rows = {r["origin"].rpartition("/")[2]: r for r in images.with_features(scans.decoded_images(spark, str(tmp_path))).collect()}
    assert set(rows) == {"noise.png", "tiny.png"}
    for name, size in images.SIZES.items():
        got = np.array(rows["noise.png"][f"d:{name}"])
        assert len(got) == 21 * size and got[:size].sum() == pytest.approx(0.25) and got.sum() == pytest.approx(0.25 + 4 * 0.25 + 16 * 0.5)
        assert not any(rows["tiny.png"][f"d:{name}"])  # no room inside the margin
    inner = noise[3:27, 3:39].reshape(-1, 3).astype(int)
    want = np.bincount((inner[:, 0] >> 5) * 64 + (inner[:, 1] >> 5) * 8 + (inner[:, 2] >> 5), minlength=512) / len(inner) * 0.25
    assert np.allclose(rows["noise.png"]["d:rgb"][:512], want)


def test_image_bins_one_pixel_at_a_time():
    rgb = np.random.default_rng(5).integers(0, 256, (9, 8, 3)).astype(np.uint8)
    rgb[2, 2], rgb[3, 3], rgb[4, 4] = (0, 0, 0), (200, 200, 200), (255, 0, 0)
    grey = [[sum(map(int, p)) for p in row] for row in rgb]
    import colorsys

    hsv, (hog, size), lbp = images.hsv_bins(rgb)[0], images.hog_bins(rgb), images.lbp_bins(rgb)[0]
    for y in range(1, 8):
        for x in range(1, 7):
            h, s, v = colorsys.rgb_to_hsv(*(int(c) / 255 for c in rgb[y, x]))
            assert hsv[y, x] == (1 + 16 * math.floor(3 * s + 0.5) + math.floor(15 * h + 0.5) if v > 0.25 else 0)
            here = [(y - 1, x - 1), (y - 1, x), (y - 1, x + 1), (y, x - 1), (y, x + 1), (y + 1, x - 1), (y + 1, x), (y + 1, x + 1)]
            assert lbp[y, x] == int("".join("1" if grey[a][b] // 12 > grey[y][x] // 12 else "0" for a, b in here), 2)
            dx, dy = grey[y][x + 1] // 3 - grey[y][x - 1] // 3, grey[y + 1][x] // 3 - grey[y - 1][x] // 3
            assert size[y, x] == pytest.approx(math.hypot(dx, dy))
            if dx:
                assert hog[y, x] == min(8, int(9 * (0.5 + math.atan(dy / dx) / math.pi)))
    assert not size[0].any() and not lbp[:, 0].any()


def test_policies(spark):
    scores = spark.range(3000).select((F.col("id") % 1000).alias("s"), F.floor(F.col("id") / 1000).alias("a"), (F.floor(F.col("id") / 1000) == 1).cast("double").alias("score"))
    share = lambda df: df.where("a = 1").count() / df.count()
    assert share(policies.epsilon_greedy(scores, ["s"], "a", 0.0)) == 1.0
    assert abs(share(policies.epsilon_greedy(scores, ["s"], "a", 0.6)) - 0.6) < 0.05  # 0.4 + 0.6 / 3
    assert abs(share(policies.softmax_policy(scores, ["s"], "a", 1.0)) - math.e / (math.e + 2)) < 0.05
    assert share(policies.softmax_policy(scores, ["s"], "a", 0.01)) == 1.0
    tie = scores.withColumn("score", F.lit(0.0))
    assert policies.epsilon_greedy(tie, ["s"], "a", 0.0).where("a <> 0").count() == 0 and policies.softmax_policy(tie.where("false"), ["s"], "a", 1.0).count() == 0


def test_sarsa_learns_the_discounted_return(spark):
    steps = lambda rows: spark.createDataFrame(rows, "i int, family string, feature string, value double")
    taken, following = steps([(1, "s", "start", 1.0), (2, "s", "end", 1.0)]), steps([(1, "s", "end", 1.0)])
    rewards = spark.createDataFrame([(1, 0.0), (2, 1.0)], "i int, reward double")
    w = spark.createDataFrame([], "family string, feature string, weight double")
    for _ in range(12):
        rows = policies.sarsa_update(w, taken, following, rewards, ["i"], 0.5, 0.5).collect()
        w = spark.createDataFrame(rows, "family string, feature string, weight double")
    got = {r["feature"]: r["weight"] for r in rows}
    assert got["end"] == pytest.approx(1.0, abs=0.01) and got["start"] == pytest.approx(0.5, abs=0.02)


def test_strategy_metrics(spark):
    rows = [("1", True, 90.0, 100.0, 100.0), ("1", True, 80.0, 100.0, 100.0), ("1", True, 110.0, 100.0, None), ("1", False, 120.0, 100.0, None), ("1", False, 50.0, 100.0, None), ("2", False, 0.0, 0.0, None)]
    m = strategy.binary_metrics(spark.createDataFrame(rows, "id string, label boolean, prediction double, observed_value double, true_value double"), "id")
    r = {x["id"]: x for x in m.collect()}
    assert (r["1"]["posCount"], r["1"]["negCount"], r["1"]["posSugLower"]) == (3, 2, 2) and r["1"]["increasePrecision"] == 0.5 and r["1"]["decreaseRecall"] == 0.5
    assert r["1"]["trueRegretMedian"] == pytest.approx(-0.1) and r["1"]["trueRegret"] == pytest.approx(-0.1) and r["2"]["falseRegret"] == 0.0
    total = strategy.combined(m).first()
    assert total["negCount"] == 3 and total["trueRegretMedian"] == 0.0 and total["falseIncreaseMagnitude"] == pytest.approx(0.1)
    models = spark.createDataFrame([("1", 0.1, 1.0, 0.0, 0.5)], "id string, a double, b double, c double, loss double")
    out = strategy.model_output(models, m, [1.0, 2.0], "m")
    assert len(out.columns) == 23 and out.first()["params"] == [0.1, 1.0, 0.0] and dict(out.dtypes)["posCount"] == "int" and dict(out.dtypes)["id"] == "bigint"


def test_difference_and_dropout(spark):
    a = flatten(ingest(spark.range(2000).select("id", F.col("id").cast("double").alias("f_x"), F.lit("y").alias("s_RAW")), ["id"]), ["id"])
    b = a.withColumn("value", F.when((F.col("family") == "f") & (F.col("id") < 5), -1.0).otherwise(F.col("value"))).where("NOT (family = 's' AND id = 9)")
    got = difference(a, b, ["id"]).collect()
    assert len(got) == 6 and [r["value_b"] for r in got if r["id"] == 9] == [None] and difference(a, a, ["id"]).count() == 0
    fs = ingest(spark.range(2000).select("id", F.col("id").cast("double").alias("f_x")), ["id"])
    assert 0.6 < flatten(fs, ["id"], dropout=0.3).count() / flatten(fs, ["id"]).count() < 0.8


@pytest.mark.parametrize("trainer,options", [
    ("decision_tree", "max_depth : 2, candidates : 4"), ("forest", "num_trees : 2, max_depth : 2, candidates : 4"), ("boosted_forest", "num_trees : 2, max_depth : 2, candidates : 4"),
    ("boosted_stumps", "candidates : 5, iterations : 6"), ("maxout", "hidden : 4, iterations : 4"), ("mlp", "node_number : [3, 1], activations : [tanh, identity], iterations : 6"),
    ("kernel", "candidates : 60, max_vectors : 16"), ("low_rank_linear", "iterations : 3, dimension : 2"),
])
def test_jobs_with_each_trainer(spark, tmp_path, trainer, options):
    many = trainer == "low_rank_linear"
    label = "if(x + y < 1, 'a:1', 'b:1')" if many else "if(x + y < 1, 1.0, -1.0)"
    spark.range(240).select("id", ((F.col("id") % 17) / 8 - 1).alias("x"), ((F.col("id") % 23) / 5 - 2).alias("y")).createOrReplaceTempView("points")
    c = config.parse(f'''
      make_examples {{ query : "select id, x as loc_x, y as loc_y, {label} as LABEL from points", output : "{tmp_path}/examples", ids : [id], multiclass : {str(many).lower()} }}
      m {{ trainer : {trainer}, model_output : "{tmp_path}/model", options {{ {options} }} }}
      train_model {{ input : "{tmp_path}/examples", model_config : m }}
      eval_model {{ input : "{tmp_path}/examples", model_config : m }}
      dump_forest {{ model_output : "{tmp_path}/model" }}
      score_table {{ query : "select x as loc_x, y as loc_y, id as UNIQUE_ID from points", model_config : m, output : "{tmp_path}/scores" }}
    ''')
    got = jobs.run(spark, c, ["GenericMakeExamples", "GenericTrainModel", "GenericEvalModel", "GenericScoreTable", *(["GenericDumpForest"] if "tree" in trainer or "forest" in trainer else [])])
    assert spark.read.csv(f"{tmp_path}/scores", sep="\t").count() == 240 * (2 if many else 1)
    if trainer in ("decision_tree", "boosted_forest", "boosted_stumps", "kernel"):
        assert got["GenericEvalModel"]["!TRAIN_AUC"] > 0.85
    assert "digraph" in got.get("GenericDumpForest", "digraph")


def test_smoothing_errors(spark):
    w = spark.createDataFrame([("f", "a", [0.0, 0.1, 0.4, 0.9, 1.6]), ("f", "b", [1.0, -1.0, 1.0, -1.0, 1.0, -1.0, 1.0, -1.0]), ("f", None, [1.0])], "family string, feature string, weights array<double>")
    got = {r["feature"]: r for r in store.with_smoothing_errors(w).collect()}
    assert set(got) == {"a", "b"} and got["a"]["smoothing_error"] < 0.05 < got["b"]["smoothing_error"] and got["b"]["smoothing_error_share"] == pytest.approx(got["b"]["smoothing_error"])


def test_sarsa_of_packed_rows_with_repeated_ids(spark):
    flat = spark.createDataFrame([(1, "p", 2.0), (1, "q", 3.0), (2, "p", 4.0), (None, "p", 5.0)], "i int, s_RAW string, f_x double")
    fs, w = ingest(flat, ["i"], bias=False), spark.createDataFrame([("s", "p", 1.0), ("f", "x", 0.5)], "family string, feature string, weight double")
    rewards = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, None), (3, 1.0)], "i int, reward double")
    rows = lambda x: {(r["family"], r["feature"]): round(r["weight"], 9) for r in policies.sarsa_update(w, x, x.where("i = 2"), rewards, ["i"], 0.1, 0.5).collect()}
    error = (2.0 - 1.0) + (2.0 - 2.0)  # of id 1, worth 1 + 0.5 + 0.5, whose two rewards are two steps
    want = {("s", "p"): round(1 - 0.1 * error, 9), ("s", "q"): round(-0.1 * error, 9), ("f", "x"): round(0.5 - 0.1 * 2 * error, 9)}
    assert rows(packed(fs, ["i"], skip=["MISS"])) == want == rows(flatten(fs, ["i"], skip=["MISS"]))
