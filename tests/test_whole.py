"""Queries over the whole table: rows far from its start take part."""

import numpy as np
import pandas as pd
import pytest

from . import oracle
from tidelens import catalogue

N = 12_000


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    """Events that say nothing before the 1,000th."""
    d, i = tmp_path_factory.mktemp("late"), np.arange(N)
    rng = np.random.default_rng(1)
    wave = np.where(i < 1000, 5.0, 20 + 10 * np.sin(2 * np.pi * i / 1000) + rng.normal(size=N))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(i, unit="min")
    user = np.where(i < 1000, 1, np.rint(wave)).astype(np.int64)
    rows = pd.DataFrame({"event_id": i, "ts": ts.astype("datetime64[us]"), "user_id": user, "event_type": "a", "value": wave})
    rows.to_parquet(d / "events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["fft_dft", "fft_peaks", "spectrogram", "gsquared", "cmi_symbolic"])
def test_strides_reach_the_end(spark, late, name):
    assert oracle.differences(catalogue.QUERIES[name](spark, late), oracle.connection(late), catalogue.SQL[name]) == ""


def test_late_events_have_an_effect(spark, late):
    assert catalogue.QUERIES["fft_peaks"](spark, late).where("magnitude > 1").count()


def test_the_head_is_of_all_events(spark, late):
    out = catalogue.QUERIES["sort_head"](spark, late)
    assert oracle.differences(out, oracle.connection(late), catalogue.SQL["sort_head"]) == ""
    assert out.where("event_id % 2 = 1").count()
