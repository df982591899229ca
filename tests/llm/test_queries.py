"""Every query against its SQL over the whole smallest tables."""

import os

import pytest

from geoframe.llm import queries
from tests.llm.conftest import oracle, spark_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == oracle(queries.ORACLES[name], sf)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_shared_folder_is_the_clusters(spark, tmp_path):
    """Tables go to the folder in spark.checkpoint.dir, read from the session; a folder of our own serves only where it is unset."""
    from geoframe.llm import common

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: f"file://{tmp_path}/" if key == "spark.checkpoint.dir" else default)

    assert common.shared_dir(Session) == f"file://{tmp_path}"
    out = common.written(spark.range(3), "some")
    at = out.__dict__["written_at"].removeprefix("file://")
    assert at.startswith(common.shared_dir(spark).removeprefix("file://")) and os.path.isdir(at) and out.count() == 3
    common.delete_written(out)
    assert not os.path.isdir(at)
