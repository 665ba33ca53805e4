import re

import pytest

import __spark_entry__ as contract
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = (
    "normalize", "token_f1", "string_similarity", "run_stats", "compute_aggregates", "pairwise_model_similarity", "run_pairs",
    "bootstrap_ci", "judge_summary", "request_grid", "read_gold_csv", "embedding_match",
)


def test_every_query_is_named_and_checkable():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    own = {name for name in contract.queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert own <= set(contract.oracle_sql())


def test_flagship(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    told = compare(spark, connect(SF), SF, name, contract.queries()[name], contract.oracle_sql()[name])
    assert told.startswith("ok"), told
