import pytest

from forecourt.llm import prefix


@pytest.fixture(scope="session", autouse=True)
def many_ranges():
    """Small tables are dealt into as many ranges as large ones are."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(prefix, "RANGE_BYTES", 1 << 6)
        yield
