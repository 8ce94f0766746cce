"""The domain CSV inputs end to end: loaders -> training and scoring frames -> holdout score."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wattle.operators import score
from wattle.plans import features
from wattle.sources import domain


def _write(tmp_path, name, pdf):
    p = str(tmp_path / name)
    pdf.to_csv(p, index=False)
    return p


def test_domain_csv_pipeline(spark, tmp_path):
    hours = pd.date_range("2016-01-01", periods=72, freq="h")
    ts = hours.strftime("%Y-%m-%d %H:%M:%S")
    rng = np.random.default_rng(0)
    readings = pd.DataFrame([(b, m, t, float(rng.uniform(0, 50))) for t in ts for b in (0, 1, 2) for m in (0, 1)],
                            columns=["building_id", "meter", "timestamp", "meter_reading"])
    buildings = pd.DataFrame({"site_id": [0, 0, 1], "building_id": [0, 1, 2],
                              "primary_use": ["Office", "Education", "Office"],
                              "square_feet": [1000.0, 2000.0, 500.0],
                              "year_built": pd.array([1990, None, 2001], dtype="Int64"),
                              "floor_count": [4.0, 0.0, None]})
    keep = rng.uniform(size=(2, 72)) > 0.2                      # weather with gaps
    weather = pd.DataFrame([(s, ts[i], float(rng.uniform(-5, 30)), None, float(rng.uniform(-10, 5)), 0.0,
                             1010.0, 180.0, float(rng.uniform(0, 8)))
                            for s in (0, 1) for i in range(72) if keep[s, i]],
                           columns=["site_id", "timestamp", "air_temperature", "cloud_coverage", "dew_temperature",
                                    "precip_depth_1_hr", "sea_level_pressure", "wind_direction", "wind_speed"])
    bad = pd.DataFrame({"0": [0, 5, 7]})
    test = readings[["building_id", "meter", "timestamp"]].copy()
    test.insert(0, "row_id", range(len(test)))

    r = domain.load_readings(spark, _write(tmp_path, "r.csv", readings))
    b = domain.load_buildings(spark, _write(tmp_path, "b.csv", buildings))
    w = domain.load_weather(spark, _write(tmp_path, "w.csv", weather))
    bad_rows = domain.load_bad_rows(spark, _write(tmp_path, "bad.csv", bad))
    rows = domain.load_scoring_rows(spark, _write(tmp_path, "t.csv", test))

    tf = features.training_frame(r, b, w, bad_rows)
    assert tf.count() == len(readings) - 3
    assert tf.filter(F.col("row_id").isin(0, 5, 7)).count() == 0
    assert tf.filter(F.col("air_temperature").isNull()).count() == 0       # spine + fills cover every hour
    got = {x.building_id: x.square_feet_floor for x in tf.select("building_id", "square_feet_floor").distinct().collect()}
    assert abs(got[1] - np.log1p(2000.0)) < 1e-12 and got[2] is None      # zero floors -> area; NULL stays NULL
    sf = features.scoring_frame(rows, b, w)
    assert sf.count() == len(test)
    pred = rows.join(r.select("building_id", "meter", "timestamp", "meter_reading"),
                     ["building_id", "meter", "timestamp"])
    out = score.holdout_rmsle(r.drop("row_id"), pred.drop("row_id"), 2016, 2016, 245).first()
    assert out.rmse == 0.0 and out.n_unmatched == 0
