"""Ingest: calls in a window, retries and the fallback of a refused schema, duplicates, audit."""

import hashlib
import json
import time

import pytest

from recordloom.streaming import ingest as I

FILES = "path string, content binary, sha256 string"


def _file(path, body):
    raw = body if isinstance(body, bytes) else json.dumps(body).encode()
    return path, bytearray(raw), hashlib.sha256(raw).hexdigest()


def test_a_window_keeps_order_and_bounds_what_is_under_way():
    begun, most = [], []

    def call(i):
        begun.append(i)
        time.sleep(0.002 * (i % 3))
        return i * i

    taken = 0
    for got in I.in_window(call, range(100), 4):
        assert got == taken * taken
        taken += 1
        most.append(len(begun) - taken)
    assert taken == 100 and max(most) <= 8


def test_calls_run_at_a_time(spark):
    class Slow(I.StubExtractor):
        def read(self, image):
            time.sleep(0.05)
            return super().read(image)

    files = spark.createDataFrame([_file(f"p{i:03}", {"fields": {"name": f"n{i}"}}) for i in range(160)], FILES).coalesce(1)
    I.extract(files.limit(1), I.StubExtractor()).collect()  # start-up is not the calls' time
    t = time.time()
    got = I.extract(files, Slow(), calls=8).collect()
    assert [r.fields["name"] for r in got] == [f"n{i}" for i in range(160)]
    assert time.time() - t < 160 * 0.05 / 2  # a fifth of the serial time and the task's own


def test_refused_schema_and_shared_pause():
    asked = []

    def refuse():
        asked.append("schema")
        raise I.Refused("400")

    def plain():
        asked.append("plain")
        if asked.count("plain") < 2:
            raise I.Retryable("429")
        return {"fields": {"name": "x"}}

    now, waits = [0.0], []
    pause = I.Pause(wait=lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)), clock=lambda: now[0])
    got = I.with_retries(refuse, plain=plain, pause=pause)
    assert got == {"fields": {"name": "x"}, "error": None} and asked == ["schema", "plain", "plain"] and waits == [2.0]
    assert "Refused" in I.with_retries(refuse)["error"]
    tried = []
    assert "ValueError" in I.with_retries(lambda: tried.append(1) or int("x"), wait=lambda s: None)["error"] and len(tried) == 3
    assert "ZeroDivisionError" in I.with_retries(lambda: 1 // 0)["error"]
    pause.ask(5)
    pause.ask(3)
    pause.hold()
    assert waits[-1] == pytest.approx(5)


def test_open_records_are_counted_without_pairs(spark):
    records = [("a", "p1", "1กก1", "0811111111"), ("b", "p2", "1กก1", ""), ("c", "p3", "", ""), ("d", "p4", "2ขข2", "0822222222"), ("e", "p5", None, "0811111111"), ("f", "p6", "9", "9")]
    stored = [("1กก1", "0811111111"), ("1กก1", None), ("", "0811111111"), ("3", "0822222222"), (None, None), ("", "")]
    got = I.count_open(spark.createDataFrame(records, "sha256 string, path string, plate_norm string, tel_digits string"), spark.createDataFrame(stored, "plate_norm string, tel_digits string"))
    want = {}
    for sha, path, plate, tel in records:
        same = lambda p, t, plate=plate, tel=tel: bool((plate and p == plate) or (tel and t == tel))
        want[sha] = sum(same(p, t) for p, t in stored) + any(q < path and same(p, t) for _, q, p, t in records)
    assert {r.sha256: r.duplicates for r in got.collect()} == want


class _Cut(I.NoCrop):
    VERSION = 4

    def crop(self, image):
        body = json.loads(image)
        return json.dumps(body["crop"]).encode() if "crop" in body else None


def test_ingest(spark):
    read = lambda n, plate, **more: {"fields": {"name": f"somchai {n}", "tel": f"08{n:08}", "plate": plate}, **more}
    files = [
        _file("a1", read(1, "1กก1")),
        _file("a2", read(1, "1กก1")),  # equal bytes
        _file("b", read(2, "2ขข2", confidence={"name": 0.5})),
        _file("c", b"no json"),
        _file("d", {"crop": read(3, "3คค3", orientation="upside_down"), "n": 1}),
        _file("e", {"crop": read(3, "3คค3", orientation="upside_down"), "n": 2}),  # another photograph, the same crop
        _file("f", {"crop": {"fields": {}}, **read(4, "4งง4")}),  # the crop reads nothing
        _file("g", read(5, "5จจ5", k=7)),
    ]
    known = spark.createDataFrame([(files[-1][2], "r9", 1)], "sha256 string, record string, created int")
    stored = spark.createDataFrame([("1กก1", ""), ("", "0800000002")], "plate_norm string, tel_digits string")
    records, skipped = I.ingest(spark.createDataFrame(files, FILES), known, I.StubExtractor(), 2026, _Cut(), stored)
    got = {r.name: r for r in records.collect() if r.name != "somchai 3"}
    thirds = sorted((r for r in records.collect() if r.name == "somchai 3"), key=lambda r: r.sha256 != files[4][2])
    assert list(got["somchai 1"].review_reason) == ["duplicate_suspect"] and list(got["somchai 2"].review_reason) == ["duplicate_suspect", "low_confidence"]
    assert got["somchai 4"].used == "full" and list(got["somchai 4"].review_reason) == []
    assert [list(r.review_reason) for r in thirds] == [[], ["duplicate_image", "duplicate_suspect"]]
    audit = json.loads(thirds[0].raw_ocr)
    assert audit["orientation"] == "upside_down" and audit["quad_found"] and audit["preprocess_version"] == 4 and audit["fills_frame"] and audit["fields"]["name"] == "somchai 3"
    out = {r.path: r for r in skipped.collect()}
    assert set(out) == {"a2", "c", "g"} and out["g"].holder == "r9" and out["c"].error and not out["a2"].error
    assert records.count() == 5
