"""Every registered query with an oracle gives the oracle's rows; the others give rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__  # noqa: E402
from tellerlake.registry import QUERIES  # noqa: E402

from conftest import SMALL  # noqa: E402

MAY_BE_EMPTY = {"filter_cards", "filter_payments", "filter_balances", "batch_customers", "page_with_total"}


@pytest.fixture(scope="module")
def duck():
    return check.connect(SMALL)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, duck, key):
    status, _, _, detail = check.compare(spark, duck, SMALL, key)
    if status == "EMPTY" and key in MAY_BE_EMPTY:
        return
    assert status in ("ok", "rows-only"), detail
    assert not detail.startswith("0 ")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
