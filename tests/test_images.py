import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_files import dicom_bytes

from radiolith.operators import manifest
from radiolith.sources import images


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "S1" / "E1"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"{i}.dcm").write_bytes(dicom_bytes(offset=i * 10, instance=i + 1, position=float(i)))
    (folder / "bad.dcm").write_bytes(b"nothing")
    return str(tmp_path)


def windows(spark):
    rows = [("S1", 0, ["S1/E1/0.dcm", "S1/E1/0.dcm", "S1/E1/1.dcm"]), ("S1", 1, ["S1/E1/0.dcm", "S1/E1/1.dcm", "S1/E1/bad.dcm"])]
    return spark.createDataFrame(rows, "study_id string, window_index int, paths array<string>")


def test_windows_are_loaded(spark, root):
    got = {r["window_index"]: np.array(r["channels"]) for r in images.load_windows(spark, root, windows(spark), 4, "none").collect()}
    assert got[0].shape == (3, 16) and (got[0][0] == got[0][1]).all() and got[0][2][0] == got[0][0][0] + 10 and (got[1][2] == 0).all()
    with pytest.raises(Exception, match="Unreadable"):
        images.load_windows(spark, root, windows(spark), 4, "none", strict=True).collect()


def test_normalize():
    x = np.arange(100.0).reshape(10, 10)
    assert images.normalize(x, "per_slice_robust").min() == 0 and images.normalize(x, "per_slice_robust").max() == 1
    assert abs(images.normalize(x, "zscore").mean()) < 1e-6
    assert (images.normalize(np.full((2, 2), np.nan), "zscore") == 0).all()
    with pytest.raises(KeyError):
        images.normalize(x, "other")


def test_collate():
    one = {"channels": [np.ones((3, 2))], "metadata": [[0.5] * 5], "labels": [1, None]}
    two = {"channels": [np.zeros((3, 2))] * 3, "metadata": [[0.1] * 5] * 3}
    got = images.collate([one, two], 2)
    assert got["images"].shape == (2, 3, 3, 2) and got["mask"].tolist() == [[True, False, False], [True] * 3]
    assert got["labels"][0, 0] == 1 and np.isnan(got["labels"][0, 1]) and np.isnan(got["labels"][1]).all()
    with pytest.raises(ValueError):
        images.collate([{"channels": []}], 2)


def test_pool_features():
    assert images.pool_features(np.ones((2, 3))).shape == (2, 3)
    assert images.pool_features(np.arange(12).reshape(2, 2, 3)).tolist() == [[0, 1, 2], [6, 7, 8]]
    assert images.pool_features(np.ones((2, 3, 4, 4))).shape == (2, 3) and images.pool_features(np.ones((2, 3, 2, 4, 4))).shape == (2, 3)
    with pytest.raises(ValueError):
        images.pool_features(np.ones(3))


def test_predict(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "f array<float>")
    assert [r["scores"] for r in images.predict(df, "f", lambda x: x * 2).collect()] == [[2, 4], [6, 8]]


def test_montages(spark, root, tmp_path):
    rows = windows(spark).withColumns({"plane": F.lit("Axial"), "fluid_sensitive": F.lit(1.0)})
    rows = rows.withColumn("paths", F.when(F.col("window_index") == 1, F.array(F.lit("x"), F.lit("S1/E1/bad.dcm"), F.lit("x"))).otherwise(F.col("paths")))
    made = images.montages(spark, root, manifest.montage_slots(rows), tile=8)
    assert bytes(made.first()["png"]).startswith(b"\x89PNG")
    assert images.write_montages(made, str(tmp_path / "out")) == 1
