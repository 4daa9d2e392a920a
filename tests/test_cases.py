"""Operators on fixtures with known rows."""

import pytest

from tests import cases, oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(cases.CASES))
def test_case(spark, name):
    oracle.check(cases.CASES[name](spark, SF), cases.SQL[name], SF)
