import os

from statloom.session import clear, materialize, shared_dir


def test_scratch_is_shared_and_can_be_cleared(spark):
    df = materialize(spark.range(5))
    assert df.count() == 5
    root = f"{shared_dir(spark).removeprefix('file://')}/statloom/{spark.sparkContext.applicationId}"
    assert df.inputFiles()[0].startswith("file:") and os.listdir(root)
    own = materialize(spark.range(0))
    assert own.count() == 0 and own.columns == ["id"]
    clear(spark)
    assert not os.path.exists(root)
