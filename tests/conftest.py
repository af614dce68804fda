import pytest

from siftwork.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("local[4]", **{"spark.sql.shuffle.partitions": "4"})
