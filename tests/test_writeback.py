import os

from plantops.operators.writeback import PART, KeyedTable, changed_keys, write_version

SCHEMA = "name string, rate double, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [(f"k{i}", float(i), f"n{i}") for i in range(200)] + [(None, 1.0, "null"), ("k5", 7.0, "second")]
    table = KeyedTable.create(frame(spark, old), path, "name", parts=16)
    before = files(path)
    table.replace(frame(spark, [("k5", -1.0, "new"), ("k7", -2.0, None), ("fresh", 0.0, "added")]))
    want = [r for r in old if r[0] not in ("k5", "k7")] + [("k5", -1.0, "new"), ("k7", -2.0, None), ("fresh", 0.0, "added")]
    assert rows_of(table.read()) == sorted(want, key=repr) and table.read().columns == ["name", "rate", "note"]
    after = files(path)
    rewritten = {f.split(PART + "=")[1].split("/")[0] for f in before - after}
    assert 1 <= len(rewritten) <= 3 and len(before & after) >= len(before) - 3 * 4
    assert table.replace(frame(spark, [])) is None and files(path) == after


def test_a_broken_off_commit_is_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [(f"k{i}", float(i), "x") for i in range(50)]
    table = KeyedTable.create(frame(spark, old), path, "name", parts=4)
    staged = table.replace(frame(spark, [("k1", -1.0, "new")]))
    want = rows_of(table.read())
    # as if the driver had been lost after it put an empty partition in the place of the old one
    frame(spark, []).write.mode("overwrite").parquet(next(os.path.dirname(f) for f in files(path) if os.path.basename(os.path.dirname(f)) in os.listdir(staged)))
    assert rows_of(spark.read.parquet(path).drop(PART)) != want
    table.commit(staged)
    assert rows_of(table.read()) == want


def test_versions_by_changed_groups(spark, tmp_path):
    old = [("a", 1.0, "x"), ("a", 2.0, "y"), ("b", 1.0, "x"), ("c", 1.0, "x"), ("c", 1.0, "x"), (None, 3.0, "n"), ("d", 1.0, "gone")]
    new = [("a", 2.0, "y"), ("a", 1.0, "x"), ("b", 1.5, "x"), ("c", 1.0, "x"), (None, 4.0, "n"), ("e", 1.0, "new")]
    assert {r.name for r in changed_keys(frame(spark, old), frame(spark, new), "name").collect()} == {"b", "c", None, "d", "e"}
    got = write_version(frame(spark, old), frame(spark, new), str(tmp_path / "t"), "name", parts=3)
    assert rows_of(got) == sorted(new, key=repr)
    none = write_version(frame(spark, old), frame(spark, old[:0]), str(tmp_path / "u"), "name", parts=3)
    assert rows_of(none) == []
