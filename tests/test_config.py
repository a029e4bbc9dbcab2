from __future__ import annotations

import pytest

from tidewright.config import RAW_SIGNALS, THIRTY_SECONDS, TWO_SECONDS, BuildConfig


def test_geometry():
    c = THIRTY_SECONDS
    assert (c.obs, c.lead, c.pred, c.length, c.shift_rows, c.n, c.smooth_rows, c.half_rows) == (20, 3, 17, 40, 1, 2, 1, (2, 6, 20))
    c = TWO_SECONDS
    assert (c.obs, c.lead, c.pred, c.length, c.shift_rows, c.n, c.smooth_rows, c.half_rows) == (300, 59, 241, 600, 15, 30, 20, (15, 90, 300))
    c = RAW_SIGNALS
    assert (c.obs, c.lead, c.pred, c.length, c.recovery_rows) == (150, -1, 301, 450, 300)


def test_json_keeps_user_values():
    assert BuildConfig.from_json(THIRTY_SECONDS.to_json()) == THIRTY_SECONDS


def test_short_half_time_is_refused():
    with pytest.raises(ValueError):
        BuildConfig(half_times=(30,))


def test_model_inputs():
    statics = ("age", "bmi", "asa")
    assert len(THIRTY_SECONDS.model_inputs(statics)) == 80
    assert len(THIRTY_SECONDS.model_inputs(statics, exact=True)) == 91
