"""The shard store against a slow planner, and what its clean-up must leave alone."""

import math
import random

import pytest
from test_llm import make_docs, prose

from tallyframe.llm import sharding


def plan_reference(shards, target):
    """Groups of shard names that are merged, for tiers of one lot."""
    tiers, out = {}, set()
    for name, size in sorted(shards):
        if size * 4 < target * 3:
            tiers.setdefault(math.floor(math.log(max(size, sharding.SMALLEST) / sharding.SMALLEST, sharding.FANOUT)), []).append((name, size))
    for held in tiers.values():
        if len(held) < sharding.FANOUT and sum(size for _, size in held) < target:
            continue
        runs, total = {}, 0
        for name, size in held:
            runs.setdefault(int((total + size / 2) // target), []).append(name)
            total += size
        out |= {tuple(run) for run in runs.values() if len(run) > 1}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_the_slow_planners(spark, seed):
    r = random.Random(seed)
    target = 64 << 20
    shards = [(f"s{i:04}", int(2 ** r.uniform(8, 27))) for i in range([0, 3, 40, 300][seed])]
    df = spark.createDataFrame([(f"file:/x/{n}", n, b, 1, 1) for n, b in shards], sharding.MANIFEST)
    runs = {}
    for x in sharding.ShardStore(spark, "file:/x", target).plan(df).collect():
        runs.setdefault((x.tier, x.lot, x.run_no), []).append(x.path.removeprefix("file:/x/"))
    assert {tuple(sorted(x)) for x in runs.values()} == plan_reference(shards, target)


def test_tiers_are_merged_for_their_bytes_too(spark):
    store = sharding.ShardStore(spark, "file:/x", 1000 << 10)
    three = [(f"file:/x/{n}", n, 400 << 10, 1, 1) for n in "abc"]
    assert store.plan(spark.createDataFrame(three, sharding.MANIFEST)).count() == 2  # the third begins a file of its own
    assert store.plan(spark.createDataFrame(three[:2], sharding.MANIFEST)).count() == 0


def test_clean_up_leaves_live_and_uncommitted_files(spark, tmp_path):
    root = f"file:{tmp_path}/data/corpus data/data/store"  # folders of the same name above the store's own
    store = sharding.ShardStore(spark, root, target=50_000)
    docs = make_docs(spark, [prose(i, 200) for i in range(120)])
    store.append(docs.repartition(8))
    store.compact()
    pending = f"{root}/data/{store.version() + 1:08d}-pending"
    docs.limit(5).write.parquet(pending)  # written, not committed
    assert store.vacuum() == []
    assert spark.read.parquet(pending).count() == 5
    gone = store.vacuum(grace=-60)
    assert pending.rsplit("/", 1)[1] in gone and len(gone) >= 2
    assert sorted(map(str, store.read().select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert store.append(docs) == store.version()


def test_runs_of_many_lots_and_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PLANNED", 6)
    store = sharding.ShardStore(spark, f"file:{tmp_path}/s", target=60_000)
    docs = make_docs(spark, [prose(i, 100) for i in range(200)]).selectExpr("*", "1 _run0", "2 _no0", "3 _path0")
    store.append(docs.repartition(20))
    store.compact()
    assert store.manifest().count() < 20
    assert sorted(map(str, store.read().select(docs.columns).collect())) == sorted(map(str, docs.collect()))
