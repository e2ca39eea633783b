import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app_name="ledgerlens-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as sorted tuples (optionally only some columns)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
