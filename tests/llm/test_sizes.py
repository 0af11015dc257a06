"""Tables whose rows are large, and joins whose sides Spark sizes too low."""

import random

import pyarrow.parquet as pq
from pyarrow.fs import FileSelector

from svloom.llm.common import Workspace, shared_fs
from svloom.llm.decontam import find_contamination
from svloom.llm.lexical import build_index


def test_shards_lie_in_small_row_groups(spark):
    """A task holds a row group; a hundred shards in one are a GB."""
    rng = random.Random(3)
    rows = [(k, " ".join(f"{rng.getrandbits(40):x}" for _ in range(60_000))) for k in range(36)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    with Workspace(spark, "test") as space:
        fs, path = shared_fs(build_index(space, docs).shards._svloom_path)
        groups = []
        for info in fs.get_file_info(FileSelector(path)):
            if info.path.endswith(".parquet"):
                meta = pq.ParquetFile(fs.open_input_file(info.path)).metadata
                groups += [meta.row_group(k) for k in range(meta.num_row_groups)]
        assert sum(g.num_rows for g in groups) >= 5
        assert max(g.num_rows for g in groups) == 1
        assert not any(g.column(k).is_stats_set for g in groups for k in range(g.num_columns))


def test_no_exploded_side_is_broadcast(spark, monkeypatch):
    """Windows of texts are sized by the file of the texts, many times too low, so Spark must not choose to broadcast them."""
    plans, save = [], Workspace.save

    def saved(self, df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, *args, **kwargs)

    monkeypatch.setattr(Workspace, "save", saved)
    passage = "how many apples does Anna Berg pick in 3 hours if she picks 14 apples an hour in her garden by the sea"
    docs = spark.createDataFrame([(1, f"some words before {passage} and some words behind it"), (2, "nothing of it is here")], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    with Workspace(spark, "test") as space:
        found = find_contamination(docs, items, space=space)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 7)]
    exploded = []
    for plan in plans:
        inside = None
        for line in plan.splitlines():
            depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
            inside = None if inside is not None and depth <= inside else inside
            if "BroadcastExchange" in line and inside is None:
                inside = depth
            elif inside is not None and "Generate posexplode" in line:
                exploded.append(line)
    assert not exploded
