"""Intermediate tables of operators that run at the same time."""

import threading

from cohortlens.llm.common import materialize, path_exists, scratch


def test_scratch_deletes_its_own_tables_only(spark):
    """One thread's scope ends while another's table, and one without a scope, are in use."""
    inside, done, seen = threading.Event(), threading.Event(), {}

    def other():
        inside.wait(60)
        with scratch(spark):
            table = materialize(spark.range(7), "other")
            seen["bare"] = table._table_path
            done.set()
            gone.wait(60)
            seen["count"] = table.count()

    gone = threading.Event()
    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark) as keep:
        with scratch(spark) as keep_inner:
            kept, dropped = materialize(spark.range(3), "kept"), materialize(spark.range(4), "dropped")
            inside.set()
            assert done.wait(60)
            keep_inner(kept)
        assert not path_exists(spark, dropped._table_path) and kept.count() == 3
        last = materialize(spark.range(5), "last")
        keep(last)
    assert last.count() == 5 and not path_exists(spark, kept._table_path)
    gone.set()
    thread.join(60)
    assert seen["count"] == 7 and not path_exists(spark, seen["bare"])
