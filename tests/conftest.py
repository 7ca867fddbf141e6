import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lendlens.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, app="lendlens-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def context(spark):
    from lendlens.checks import Context

    return Context(spark, SMALL)


@pytest.fixture(scope="session")
def layers(context):
    """Silver and Gold of the small folder, computed once."""
    from lendlens.plans.gold import build_gold
    from lendlens.plans.silver import build_silver
    from lendlens.session import settle

    silver = {name: settle(df) for name, df in build_silver(context.bronze).items()}
    gold = {name: settle(df) for name, df in build_gold(silver).items()}
    return context.bronze, silver, gold
