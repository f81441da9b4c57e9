from datetime import datetime, timedelta, timezone

import pytest

from runpulse import params


def test_row_limit():
    assert [params.row_limit(n) for n in (1, 100, 501, 10**9)] == [1, 100, 501, 10**9]
    for bad in (0, -5, 1.5, "10", None, True):
        with pytest.raises(ValueError):
            params.row_limit(bad)


def test_window_start():
    now = datetime(2026, 1, 2, tzinfo=timezone.utc)
    assert params.window_start(now) == params.window_start("2026-01-02", 24) == now - timedelta(days=1)
    assert params.window_start(now, 9999) == now - timedelta(hours=9999)
    for bad in (0, -1, float("nan")):
        with pytest.raises(ValueError):
            params.window_start(now, bad)


def test_status_filter():
    assert [params.status_filter(s) for s in ("all", " Error ", "ISSUES")] == ["all", "error", "issues"]
    for bad in ("warn", ""):
        with pytest.raises(ValueError):
            params.status_filter(bad)


def test_uuid():
    assert params.require_uuid("E6B2A0E8-0000-4000-8000-c2e3e491e48d") == "e6b2a0e8-0000-4000-8000-c2e3e491e48d"
    for bad in ("", "x", "e6b2a0e8-0000-4000-8000-c2e3e491e48d'"):
        with pytest.raises(ValueError):
            params.require_uuid(bad)


def test_instants_mean_utc():
    want = datetime(2026, 1, 1, tzinfo=timezone.utc)
    assert params.as_instant("2026-01-01T00:00:00Z") == params.as_instant("2026-01-01") == want
    assert params.as_instant("2026-01-01T02:00:00+02:00") == want
    assert params.as_instant(datetime(2026, 1, 1)) - want == timedelta(0)
    with pytest.raises(ValueError):
        params.as_instant("yesterday")
