"""Every query of the library once on a larger table, where values occur that the smallest one does not hold."""

from __future__ import annotations

import os

import pytest

from lodestack.plans import catalogue

LARGE = os.environ.get("TEST_LARGE_DIR", "/root/testdata/sf0.1")


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no larger tables here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_runs_on_a_larger_table(spark, name):
    catalogue.QUERIES[name](spark, LARGE).write.format("noop").mode("overwrite").save()
