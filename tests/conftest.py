import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fleetlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("fleetlens-tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus_of(spark):
    """Scanned corpus from {path: content} or {(repo, path): content}."""
    from fleetlens.sources.corpus import scan_corpus

    def build(contents, scan=True):
        rows = [
            (k[0], k[1], len(v.encode()), v) if isinstance(k, tuple) else ("r", k, len(v.encode()), v)
            for k, v in contents.items()
        ]
        tracked = spark.createDataFrame(rows, "repo string, path string, size bigint, content string")
        return scan_corpus(tracked) if scan else tracked

    return build
