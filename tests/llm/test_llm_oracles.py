import pytest

from seqweft.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, oracle, name):
    oracle(spark, QUERIES[name], ORACLES[name], SF)
