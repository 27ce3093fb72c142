import __spark_entry__ as entry_point
from reelquery.plans import registry


def test_every_oracle_has_a_query():
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries)
    # Only queries of the training-text part may go without SQL.
    assert set(registry.all_queries()) == set(registry.all_oracles())


def test_flagship(spark):
    result = entry_point.entry(spark)
    assert result.columns == ["query_id", "rank", "candidate_key", "score", "primary_signal"]
    assert result.count() > 0
