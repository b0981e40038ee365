"""Every registered linkage query: equal to its SQL, or at least runs with a stable schema."""

import pytest

from weftline.plans import registry

from .oracle import duck, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    assert spark_rows(registry.QUERIES[name](spark, FOLDER)) == duck_rows(con, registry.ORACLES[name])


def test_only_learners_have_no_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"crossfit_scores", "isotonic_cal"}


@pytest.mark.parametrize("name", ["crossfit_scores", "isotonic_cal"])
def test_learned_scores(spark, name):
    """Each labelled document once, scored by a model that hasn't seen it; good documents score higher."""
    rows = registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == len({r.doc_id for r in rows}) and all(labels[r.doc_id] == r.y and 0 <= r.p <= 1 for r in rows)
    good, bad = ([r.p for r in rows if r.y == v] for v in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.8 * len(good) * len(bad)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
