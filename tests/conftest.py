import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spanforge.session import local_session

    return local_session("4", "spanforge-tests", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def parse(spark):
    """Parse {log_id: text} with a given slice size."""
    from spanforge.session import cut
    from spanforge.sources.logs import body_lines
    from spanforge.sources.parse import parse_logs

    def run(logs: dict[str, str], size: int = 200_000):
        rows = [(k, i + 1, line) for k, text in logs.items() for i, line in enumerate(text.split("\n"))]
        lines = spark.createDataFrame(rows, "log_id string, line_no long, line string")
        return parse_logs(body_lines(cut(lines)), size)

    return run
