import os

from basketry import storage


def test_saved_tables_are_read_back_and_cleared(spark, rows):
    kept = storage.save(rows([(1,), (2,)], "x int"), "probe")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert sorted(r.x for r in kept.collect()) == [1, 2]
    assert path.startswith(storage.shared_folder(spark).removeprefix("file:"))
    assert os.path.isdir(path)
    assert storage.clear(spark) >= 1
    assert not os.path.exists(path)
