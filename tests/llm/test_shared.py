"""What the operators share: pieces of batches, the shared folder, tables that come and go."""

import types

import pyarrow as pa
import pytest

from isotherm.llm import shared

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_pieces_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(shared, "PIECE_BYTES", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(["x" * 20] * 500)], ["i", "t"])
    got = list(shared.pieces(iter([batch, batch.slice(0, 0), batch.slice(7, 1)])))
    assert [i for b in got for i in b["i"].to_pylist()] == [*range(500), 7]
    assert max(b.nbytes for b in got) < 1500 and len(got) > 10
    long = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["x" * 5000, ""])], ["i", "t"])
    assert [b.num_rows for b in shared.pieces(iter([long]))] == [1, 1]


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        conf = types.SimpleNamespace(get=lambda key, default=None: folder)
        context = types.SimpleNamespace(master=master, getConf=lambda: types.SimpleNamespace(get=lambda key: folder))
        return types.SimpleNamespace(conf=conf, sparkContext=context)

    assert shared.shared_dir(session("local[4]")).startswith("file:///") and shared.shared_dir(session("local")).startswith("file:///")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(ValueError):
            shared.shared_dir(session(master))
        assert shared.shared_dir(session(master, "s3a://bucket/x/")) == "s3a://bucket/x"


def test_tables_are_freed_and_settings_stay(spark):
    before = spark.conf.get(KEY)
    with shared.Scratch(spark) as scratch:
        t = scratch.written(spark.range(10).repartition(3, "id"), "test")
        assert t.count() == 10 and spark.conf.get(KEY) == before
    assert spark.read.parquet(scratch.paths[0]).count() == 0
    with pytest.raises(ZeroDivisionError), shared.transient_shuffles(spark):
        assert spark.conf.get(KEY) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(KEY) == before
