import os

from folioscan.operators.checkpoints import clear_checkpoints, drop_checkpoint, ensure_checkpoint_dir


def test_dropped_and_cleared(spark):
    ensure_checkpoint_dir(spark)
    place = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    a, b = spark.range(10).checkpoint(), spark.range(20).checkpoint()
    before = len(os.listdir(place))
    drop_checkpoint(a)
    assert len(os.listdir(place)) == before - 1 and b.count() == 20
    drop_checkpoint(spark.range(3))  # was never kept: nothing to do
    clear_checkpoints(spark)
    assert not os.path.exists(place) and spark.range(5).checkpoint().count() == 5
