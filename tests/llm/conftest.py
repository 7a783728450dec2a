import pytest

from tablesense.llm.common import reach_workers


@pytest.fixture(autouse=True)
def workers(spark):
    reach_workers(spark)
