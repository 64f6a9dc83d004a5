"""Reading and storing tables."""

from types import SimpleNamespace

import pytest

from lectern.sources import tables


def test_one_row_per_key_without_a_shuffle_of_the_rest(spark):
    rows = [(1, "a"), (2, "b"), (1, "a"), (3, None), (None, "n"), (None, "n"), (4, "d"), (4, "d"), (4, "d")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, tables.one_per_key_in_place(df, "id").collect()), key=key) == sorted(set(rows), key=key)
    assert tables.one_per_key_in_place(df.limit(0), "id").count() == 0
    words = spark.createDataFrame([("x", 1), ("y", 2), ("x", 1)], "id string, n int")
    assert tables.one_per_key_in_place(words, "id").count() == 2


def test_a_sieve_loses_nothing(spark, monkeypatch):
    df = spark.range(1000)
    wanted = spark.range(0, 1000, 7)
    for bits in (1 << 25, 128):
        monkeypatch.setattr(tables, "SIEVE", bits)
        kept = {r[0] for r in tables.sieve(df, "id", wanted).collect()}
        assert kept >= set(range(0, 1000, 7)) and (bits == 128 or len(kept) < 300)
    assert tables.sieve(df, "id", wanted.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(session("spark://a:7077", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(session("local-cluster[2,1,512]", None))
    assert tables.shared_folder(session("yarn", "hdfs:///x/")) == "hdfs:///x"
    own = session("local[2]", None)
    assert tables.shared_folder(own) == tables.shared_folder(own)
