"""Tables in the shared folder."""

import os

from docstrata.sources.shared import discard, materialise


def test_only_what_was_written_here_is_deleted(spark, tmp_path):
    own = tmp_path / "docstrata" / "input"
    spark.range(3).write.parquet(str(own))
    given = spark.read.parquet(str(own))
    discard(given)
    assert os.path.exists(own) and given.count() == 3
    written = materialise(given, "t")
    path = written.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.exists(path) and written.count() == 3
    discard(written)
    assert not os.path.exists(path)
