"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import pytest
from compare import compare
from lexiflow.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    assert compare(spark, name, SF) is None


def test_append_once_survives_restarts(spark, tmp_path):
    from lexiflow.streaming import logs

    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, v int")
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: logs.read_log(spark, str(tmp_path / "in"), rows.schema)
    logs.append_once(stream(), str(tmp_path / "log"), str(tmp_path / "c1"))
    logs.append_once(stream(), str(tmp_path / "log"), str(tmp_path / "c2"))  # a lost checkpoint repeats the batch
    assert logs.read_appended(spark, str(tmp_path / "log")).count() == 2
