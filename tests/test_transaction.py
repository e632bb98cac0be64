import pytest

from voxelake.plans import transaction as T
from voxelake.streaming import ingest as streaming


def test_lock(tmp_path):
    a = T.Lock(tmp_path).acquire()
    assert T.Lock(tmp_path, a.generation).acquire().generation == a.generation
    with pytest.raises(T.LockAcquisitionError):
        T.Lock(tmp_path).acquire()
    a.release()
    with pytest.raises(T.LockVerificationError):
        a.verify()


def test_commit_is_atomic(spark, tmp_path):
    with T.SeriesStore(spark, tmp_path / "s", lock=True) as store:
        store.commit(spark.range(3))
        with pytest.raises(RuntimeError):
            store.commit(spark.range(9), _crash=True)
        assert store.read().count() == 3
        again = T.SeriesStore.deserialize(spark, store.serialize())
        assert again.read().count() == 3
    assert not (tmp_path / "s" / T.Lock.NAME).exists()


def test_gate_and_error_log(spark, tmp_path):
    store = T.SeriesStore(spark, tmp_path, lock=False)
    with pytest.raises(T.CleanOperationUnlocked):
        store.read()
    assert store.read(dirty=True) is None
    with pytest.raises(ValueError), T.SeriesStore(spark, tmp_path, lock=True) as locked:
        locked.upload_error_log("broken")
        raise ValueError
    assert (tmp_path / T.Lock.NAME).exists()
    with pytest.raises(T.ErrorLogExists):
        T.SeriesStore(spark, tmp_path, lock=False)
    T.SeriesStore(spark, tmp_path, lock=False, override_errors=True)


def test_stream_append(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "series string, uid string, crc string, seq int"
    spark.createDataFrame([("s", "1", "a", 1), ("s", "1", "b", 2), ("s", "2", "c", 3)], schema).write.parquet(source)
    spark.createDataFrame([("s", "2", "c", 0)], schema).write.parquet(target)
    query = streaming.append_batches(spark.readStream.schema(schema).parquet(source), lambda: spark.read.schema(schema).parquet(target), lambda df, _: df.write.mode("append").parquet(target), ["series", "uid"], ["seq"], str(tmp_path / "check"))
    query.awaitTermination()
    assert sorted((r.uid, r.crc) for r in spark.read.parquet(target).collect()) == [("1", "a"), ("2", "c")]


def test_a_torn_lock_is_held_by_another(tmp_path):
    for content in ("", "{", "[]", "{}"):
        (tmp_path / T.Lock.NAME).write_text(content)
        with pytest.raises(T.LockAcquisitionError):
            T.Lock(tmp_path).acquire()
        with pytest.raises(T.LockVerificationError):
            T.Lock(tmp_path, "mine").verify()


def test_dirty_operations_under_a_lock_warn(spark, tmp_path):
    with T.SeriesStore(spark, tmp_path, lock=True) as store:
        with pytest.warns(UserWarning, match="read is called as dirty"):
            assert store.read(dirty=True) is None
        assert "unlocked" not in repr(store)
