import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapeline.operators import ordered  # noqa: E402
from tapeline.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions="4", driver_memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=[None, 7], ids=["whole", "split"])
def segments(request, monkeypatch):
    """Run a test with whole keys and with keys cut into segments of other widths."""
    cut = ordered._segment_of
    width = request.param
    monkeypatch.setattr(
        ordered, "_segment_of", lambda df, order, _: cut(df, order, width) if width else None
    )
    return width


def near(got, want, tol=1e-9):
    if got is None or want is None:
        return got is None and want is None
    if want != want:
        return got != got
    return abs(got - want) <= tol * max(1.0, abs(want))


def all_near(got, want, tol=1e-9):
    got, want = list(got), list(want)
    assert len(got) == len(want), (got, want)
    for i, (a, b) in enumerate(zip(got, want)):
        assert near(a, b, tol), (i, a, b)
