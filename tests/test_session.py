import os

from reelquery.plans import registry
from reelquery.session import checkpointed, stored_tables


def files_below(folder):
    return sum(len(names) for _, _, names in os.walk(folder))


def test_a_run_leaves_nothing_behind(spark, folder):
    with stored_tables(spark) as outer:
        with stored_tables(spark) as run:
            kept = checkpointed(spark.range(5))
            assert kept.count() == 5
            registry.all_queries()["text_search"](spark, folder).collect()
            place = run.removeprefix("file:")
            assert files_below(place) > 5
        assert not os.path.exists(place)
        checkpointed(spark.range(3))
        assert files_below(outer.removeprefix("file:")) > 0
    assert not os.path.exists(outer.removeprefix("file:"))
