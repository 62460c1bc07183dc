"""Small portions take less memory and give the same rows."""

import corpus_pipeline
from graphloom.llm import packing
from graphloom.llm.common import arrow_rows

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_workers_are_handed_so_many_rows(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    before, rows = spark.conf.get(NAME), spark.range(0, 100, 1, 1)
    with arrow_rows(spark, 7):
        assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) == 7
    with arrow_rows(spark, None):
        assert [r.n for r in rows.mapInArrow(sizes, "n long").collect()] == [100]
    assert spark.conf.get(NAME) == before


def test_packing_in_small_portions(spark, monkeypatch):
    rows = [(i, "some Words here, " * (i % 90) + f"Ünder {i}") for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, packing.pack_documents(docs, 64).collect()))
    assert sorted(map(tuple, packing.pack_documents(docs, 64, slice_bytes=500, batch_rows=9).collect())) == want
    given = {}
    monkeypatch.setattr(packing, "pack_documents", lambda docs, **how: given.update(how))
    corpus_pipeline.packed(spark, docs, None)
    assert given["slice_bytes"] <= packing.SLICE_BYTES // 4 and given["batch_rows"] <= 500
