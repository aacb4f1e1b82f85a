"""What the connected components ask of the driver."""

import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from corvane.llm import common, components


def test_edges_are_planned_once(spark, monkeypatch):
    """However large the plan of the edges is, the plans of the rounds do not repeat it."""
    plans = []

    def noted(df, stored=components.stored):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return stored(df)

    monkeypatch.setattr(components, "stored", noted)
    rows = [(i, i + 1) for i in range(9)] + [(20, 22), (22, 20), (30, 30), (40, 41)]
    edges = spark.createDataFrame(rows, "a long, b long").select((F.col("a") + F.lit(271828) - F.lit(271828)).alias("a"), "b")
    found = sorted(map(tuple, components.connected_components(edges).collect()))
    assert found == [(i, 0) for i in range(10)] + [(20, 20), (22, 20), (40, 40), (41, 40)]
    assert len(plans) > 1 and sum(p.count("+ cast(271828") + p.count("+ 271828") for p in plans) == 1


def test_driver_gives_native_memory_back(spark):
    """settle() has the driver's JVM trim what its C library keeps, where the JVM knows how."""
    if not shutil.which("jcmd"):
        pytest.skip("no jcmd to ask the JVM by")
    pid = str(spark._jvm.ProcessHandle.current().pid())
    if "System.trim_native_heap" not in subprocess.run(["jcmd", pid, "help"], capture_output=True, text=True).stdout:
        pytest.skip("this JVM has no such command")
    said = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(common, "_trim_jvm", lambda s, trim=common._trim_jvm: said.append(trim(s)))
        common.settle(spark)
    assert len(said) == 1 and "Trim native heap" in said[0]
