import pytest

from plumbline.functions import stats


def test_newcombe():
    lo, hi = stats.newcombe(56, 70, 48, 80)
    assert (round(lo, 4), round(hi, 4)) == (0.0524, 0.3339)


def test_margin():
    assert round(stats.accuracy_margin(0.5, 1200, 0.5, 1200), 4) == 0.0400


@pytest.mark.parametrize(("df", "want"), [(9, 2.262157), (2, 4.302653), (30, 2.042272)])
def test_t_quantile(df, want):
    assert stats.t_quantile(0.975, df) == pytest.approx(want, abs=1e-5)


def test_mean_interval():
    mean, lo, hi = stats.mean_interval([1.0, 2.0, 3.0])
    assert mean == 2 and lo == pytest.approx(2 - 4.302653 / 3**0.5, abs=1e-5) and hi == pytest.approx(2 + 4.302653 / 3**0.5, abs=1e-5)
