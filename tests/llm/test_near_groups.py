"""Near dedup beside what other operators leave in a worker, and on a large group in which few pairs are links."""

import gc
import weakref
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import bpe, common, minhash, toxicity
from quillon.llm.queries import vocabulary

HOT = Path("/root/testdata/check_h/documents.parquet")


def test_a_worker_lets_go_of_other_operators_memory():
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["one two three four five six", None]})
    words = " ".join(f"w0rd{i}" for i in range(50)).encode()
    model = toxicity.Model(np.zeros((32, 32, 32)), {b"wor": 1.0}, np.zeros(6))
    for f in (minhash._sketch(5, 16, 4), minhash._explode(5)):
        model.measures(words)
        assert len(toxicity._memory(model.key)) == 50
        list(f(iter([batch])))
        assert not toxicity._memory(model.key)
        enc = bpe.encoder(vocabulary())
        assert bpe.encoder(vocabulary()) is enc and enc.encode("some words")
        left = weakref.ref(enc)
        del enc
        list(f(iter([batch])))
        gc.collect()
        assert left() is None


@pytest.mark.skipif(not HOT.exists(), reason="the table is not here")
def test_few_pairs_join_a_large_group(spark, monkeypatch):
    """In check_h 1318 near copies of one text, most pairs of which do not link, are one component. Testing all pairs of
    it that pivots leave took 170,503 tests."""
    tested = []
    stored = common.stored

    def counted(df, name, *args):
        out = stored(df, name, *args)
        if name == "more":
            tested.append(out.count())
        return out

    rows, key = common.keyed(stored(spark.read.parquet(str(HOT)).drop_duplicates(["text"]), "distinct"))
    monkeypatch.setattr(common, "stored", counted)
    got = minhash.near_duplicates(rows, percent=80, id_col=key)
    sizes = sorted(r["count"] for r in got.groupBy("component_id").count().where("count > 20").collect())
    assert sizes == [21, 23, 59, 92, 1318] and got.select("component_id").distinct().count() == 42_463
    assert sum(tested) < 80_000, tested
