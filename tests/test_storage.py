"""Scratch tables: scopes nest, belong to their thread, and clean up after errors."""

import threading

import pytest

from redlight.storage import materialize, scratch


def test_scopes_belong_to_their_thread(spark):
    inside, written, found = threading.Event(), threading.Event(), []

    def other():
        inside.wait(60)
        found.append(materialize(spark.range(5), "mine"))
        written.set()

    t = threading.Thread(target=other)
    t.start()
    with scratch(spark):
        own = materialize(spark.range(3), "own")
        inside.set()
        assert written.wait(120)
        assert own.count() == 3
    t.join()
    assert found[0].count() == 5
    with pytest.raises(Exception):
        own.count()


def test_scopes_nest_and_clean_up_after_errors(spark):
    with scratch(spark):
        outer = materialize(spark.range(2), "outer")
        with pytest.raises(ValueError):
            with scratch(spark):
                inner = materialize(spark.range(4), "inner")
                raise ValueError
        assert outer.count() == 2
        with pytest.raises(Exception):
            inner.count()
