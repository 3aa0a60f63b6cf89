"""Landing ingest: a stream that is killed between any two writes loses and doubles nothing."""

import json
import os

import pytest

from recordloom.streaming import landing as L
from recordloom.streaming.ingest import StubExtractor


class Counted(StubExtractor):
    """Notes each call in a folder, as workers are other processes."""

    def __init__(self, folder):
        self.folder = folder

    def read(self, image):
        with open(os.path.join(self.folder, os.urandom(8).hex()), "wb"):
            pass
        return super().read(image)


def _land(folder, names):
    os.makedirs(folder, exist_ok=True)
    for n, who in names:
        with open(os.path.join(folder, n), "w", encoding="utf-8") as f:
            json.dump({"fields": {"name": f"somchai {who}", "tel": f"08{who:08}", "plate": f"1กก{who}"}}, f, ensure_ascii=False)


@pytest.mark.parametrize("kill", ["reads", "records", "commits"])
def test_killed_and_started_again(spark, tmp_path, monkeypatch, kill):
    calls, landing = str(tmp_path / "calls"), str(tmp_path / "landing")
    os.makedirs(calls)
    extractor = Counted(calls)
    go = lambda: L.run(L.binary_files(spark, landing), str(tmp_path / "ingest"), extractor, 2026)
    _land(landing, [("a", 1), ("b", 2), ("c", 1)])
    go()
    _land(landing, [("d", 3), ("e", 2), ("f", 4), ("g", 4)])
    if kill:
        write = L.Store.write

        def broken(self, df, table, batch):
            if table == kill:
                if kill != "commits":  # half of it is there
                    df.limit(1).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.place(table, batch))
                raise RuntimeError("killed")
            return write(self, df, table, batch)

        monkeypatch.setattr(L.Store, "write", broken)
        with pytest.raises(Exception, match="killed"):
            go()
        monkeypatch.setattr(L.Store, "write", write)
        assert L.Store(spark, str(tmp_path / "ingest/store")).table("records").count() == 2  # what is not committed is not seen
    store = go()
    records = store.table("records").collect()
    assert sorted((r.name, r.batch) for r in records) == [("somchai 1", 0), ("somchai 2", 0), ("somchai 3", 1), ("somchai 4", 1)]
    skipped = {os.path.basename(r.path): r.holder is not None for r in store.table("skipped").collect()}
    assert skipped == {"c": False, "e": True, "g": False}
    if kill != "reads":
        assert len(os.listdir(calls)) == 4  # no file is read twice
    go()
    assert store.table("records").count() == 4
    L.ingest_batch(store, spark.createDataFrame([("z", bytearray(b"{}"))], "path string, content binary"), 1, extractor, 2026)
    assert store.table("records").count() == 4  # a committed batch that is offered again


def test_empty_store(spark, tmp_path):
    assert L.Store(spark, str(tmp_path)).table("records") is None
