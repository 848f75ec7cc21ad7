from tidepanel.models import trees
from tidepanel.operators import splits


class Recorder:
    """Stands for an estimator; keeps what it is fitted on."""

    def fit(self, rows):
        self.rows = rows
        raise StopIteration


def test_fits_do_not_follow_the_shuffle_partitions(spark, panel, monkeypatch):
    """A boosted fit runs hundreds of jobs, each with a task per partition of its rows."""
    folds = splits.packed_folds(panel, n_folds=1).repartition(40, "series_id")
    want = trees.samples(folds).count()
    for step in (lambda e: trees.pooled(folds, "yhat", e), lambda e: trees.TreeForecaster(lambda seed: e).with_fitted(folds, "yhat")):
        seen = Recorder()
        try:
            step(seen)
        except StopIteration:
            pass
        assert seen.rows.rdd.getNumPartitions() == 1 and seen.rows.count() == want
    monkeypatch.setattr(trees, "ROWS_PER_PARTITION", want // 2)
    assert trees.training_rows(folds).rdd.getNumPartitions() > 1
