"""Operators stage their rows in the open run folder, which goes at its end."""

import os

from plantops.llm import simhash
from plantops.session import checkpoint_dir, run_folder


def test_operators_leave_nothing_behind(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"text of number {i // 2} among others") for i in range(40)])
    before = set(os.listdir(checkpoint_dir(spark)))
    with run_folder(spark) as folder:
        simhash.keep_representatives(docs).write.parquet(str(tmp_path / "kept"))
        assert os.listdir(folder)
    assert not os.path.exists(folder) and set(os.listdir(checkpoint_dir(spark))) - before == set()
    assert spark.read.parquet(str(tmp_path / "kept")).count() <= 20
