import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from siftlake.session import local_session

    session = local_session("8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_files(spark):
    def make(rows, partitions=1):
        """rows: (repo_id, path, content)"""
        df = spark.createDataFrame(rows, "repo_id string, path string, content string")
        return df.repartition(partitions, "path") if partitions > 1 else df

    return make
