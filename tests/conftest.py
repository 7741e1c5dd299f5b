from __future__ import annotations

import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from columnscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "columnscope-tests", "local[8]",
        spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture()
def counted(spark):
    """Force the large-input route of exact quantiles."""
    key = "spark.columnscope.exactInMemoryBytes"
    spark.conf.set(key, "0")
    yield
    spark.conf.unset(key)


@pytest.fixture(scope="session")
def meters(spark):
    """Readings of nine meters."""
    rows = [
        ("Nord", "K2", 12.5, 3, "2031-03-02"), ("Ost", "K7", 48.0, 1, "2031-03-03"), ("Nord", "K2", 30.5, 5, "2031-03-05"),
        ("Süd", "K9", 7.25, 2, "2031-03-06"), ("Ost", "K7", 22.0, 4, "2031-03-08"), ("Nord", "K9", 18.5, 3, "2031-03-09"),
        ("Hafen", "K2", 64.0, 6, "2031-03-10"), ("Süd", "K7", 7.25, 2, "2031-03-12"), ("Ost", "K2", 33.0, 1, "2031-03-13"),
    ]
    frame = pd.DataFrame(rows, columns=["station", "model", "load", "checks", "read_on"])
    return spark.createDataFrame(frame.assign(read_on=pd.to_datetime(frame["read_on"])))


@pytest.fixture(scope="session")
def boats(spark):
    """Fourteen boats; two lengths and a rig are missing, one length is far out."""
    lengths = [9.2, 9.4, 9.1, None, 9.3, 9.25, 9.5, 21.0, 9.35, 9.15, None, 9.45, 9.2, 9.3]
    harbours = ["Wik", "Kappel", "Wik", "Laboe", "Kappel", "Wik", "Laboe", "Wik", "Wik", "Kappel", "Laboe", "Wik", "Kappel", "Eck"]
    rigs = ["sloop", "ketch", "sloop", "yawl", None, "sloop", "ketch", "sloop", "yawl", "sloop", "ketch", "sloop", "sloop", "yawl"]
    crews = [2, 3, 2, 4, 3, 2, 5, 6, 2, 3, 4, 2, 3, 2]
    launched = [f"2030-{5 + i // 5:02d}-{3 + 5 * (i % 5):02d}" for i in range(14)]
    return spark.createDataFrame(
        [(501 + i, h, r, n, c, d) for i, (h, r, n, c, d) in enumerate(zip(harbours, rigs, lengths, crews, launched))],
        "hull long, harbour string, rig string, length double, crew long, launched string",
    )
