import pytest
from oracle import difference

from rulelake.llm import compaction
from rulelake.llm.common import staging_path
from rulelake.llm.compaction import CommitConflict, Manifest, ShardStore


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tiers_merge_and_versions_stay_readable(spark):
    store = ShardStore(spark, staging_path(spark, "store"), fan_in=3)
    said = []
    for k in range(3):
        part = [(10 * k + i, None if i == 1 else "t" * i, "x") for i in range(4)] * 2
        said += part
        store.append(spark.createDataFrame(part, "doc_id long, text string, path string").repartition(3))
    assert store.versions() == [1, 2, 3]
    assert rows(store.read()) == sorted(said, key=repr)
    merged = store.compact()
    assert merged.version == 4 and len(merged.runs) == 1 and merged.runs[0].files == 1
    assert rows(store.read()) == rows(store.read(3)) == sorted(said, key=repr)
    assert store.compact().version == 4
    assert store.vacuum() == 3 and store.versions() == [4]
    assert rows(store.read()) == sorted(said, key=repr)


def test_target_size_bounds_files(spark):
    df = spark.range(0, 200_000).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text").repartition(16)
    store = ShardStore(spark, staging_path(spark, "store"), target_bytes=4 << 20)
    store.append(df)
    run = store.compact().runs[0]
    assert run.rows == 200_000 and run.files == -(-store.manifest(1).runs[0].bytes // (4 << 20))


def test_of_two_writers_one_fails_and_both_arrive(spark):
    root = staging_path(spark, "store")
    one, two = ShardStore(spark, root), ShardStore(spark, root)
    one.append(spark.range(3))
    base = one.manifest()
    one.commit(Manifest(base.version + 1, base.schema, base.runs))
    with pytest.raises(CommitConflict):
        two.commit(Manifest(base.version + 1, base.schema, base.runs))
    two.append(spark.range(3, 5))
    assert sorted(r.id for r in one.read().collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="columns"):
        one.append(spark.range(1).selectExpr("id as other"))


def test_empty_table_and_orphans(spark):
    store = ShardStore(spark, staging_path(spark, "store"))
    with pytest.raises(ValueError, match="empty"):
        store.read()
    store.append(spark.createDataFrame([], "doc_id long, text string"))
    assert store.compact().runs[0].rows == 0 and store.read().columns == ["doc_id", "text"] and store.read().count() == 0
    spark.range(2).write.parquet(f"{store.root}/runs/orphan")
    assert store.vacuum() == 0 and store.vacuum(grace_seconds=-1) == 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(compaction.op3_size_tiered(spark, sf), compaction.OP3_SQL, sf) == ""


def test_target_sized_files_are_never_rewritten(spark):
    """However many arrivals come, a run of target-sized files stays as it is, and small ones go on being merged."""
    store = ShardStore(spark, staging_path(spark, "store"), target_bytes=64 << 10, fan_in=3)
    arrival = lambda k: spark.range(500 * k, 500 * k + 500).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text").coalesce(1)
    settled, merges = {}, 0
    for k in range(14):
        store.append(arrival(k))
        before = store.manifest()
        after = store.compact()
        merges += after.version - before.version
        names = {r.name for r in after.runs}
        assert set(settled) <= names
        settled |= {r.name: r for r in after.runs if store.done(r)}
        assert all(store.target_bytes / 2 <= r.bytes / r.files <= 1.5 * store.target_bytes for r in after.runs if store.done(r))
    assert merges >= 2 and settled and store.read().count() == 500 * 14
