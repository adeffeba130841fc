import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import build_session
    ckpt = tempfile.mkdtemp(prefix="ledgerline-test-ckpt-")
    s = build_session("local[*]", app="ledgerline-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


def rows(df, *cols):
    cols = cols or df.columns
    return sorted([tuple(r[c] for c in cols) for r in df.collect()],
                  key=lambda t: tuple((x is None, str(x)) for x in t))
