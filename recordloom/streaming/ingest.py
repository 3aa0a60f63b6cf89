"""Ingest of captured images: gate, extraction, fallback, rules, and the two tables that it writes.

The model call and the image operators are plug-ins (they need a model host and imaging libraries): an Extractor reads
bytes, a Preprocessor crops them.  Failures of a file are a value in its row and never stop the others.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import rules, text
from recordloom.operators import duplicates
from recordloom.session import cut


class Extractor(Protocol):
    """read asks with a schema for the answer; read_plain, if there is one, in words only, for hosts that refuse schemas."""

    def read(self, image: bytes) -> dict: ...


class Preprocessor(Protocol):
    """Cropped image (or None if nothing was found); VERSION names the algorithm."""

    VERSION: int

    def crop(self, image: bytes) -> bytes | None: ...


class StubExtractor:
    """Reads images that are JSON texts; stands for a model in tests."""

    def read(self, image: bytes) -> dict:
        return json.loads(image.decode("utf-8"))


class NoCrop:
    VERSION = 0

    def crop(self, image: bytes) -> bytes | None:
        return None


class Retryable(Exception):
    """A failure worth another try (rate limit, server error)."""


class Refused(Exception):
    """The host does not take a schema for the answer (a bad request)."""


class Pause:
    """A back-off that the calls of a task share: while one has been told to wait, none starts."""

    def __init__(self, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.wait, self.clock, self.until, self.lock = wait, clock, 0.0, threading.Lock()

    def ask(self, seconds: float) -> None:
        with self.lock:
            self.until = max(self.until, self.clock() + seconds)

    def hold(self) -> None:
        with self.lock:
            left = self.until - self.clock()
        if left > 0:
            self.wait(left)


def with_retries(call: Callable[[], dict], tries: int = 3, wait: Callable[[float], None] = time.sleep, plain: Callable[[], dict] | None = None, pause: Pause | None = None) -> dict:
    """At most `tries` calls with doubling waits; never raises, the error is a field.

    A refused schema turns to `plain` at once, which takes one of the tries.  With `pause`, waits hold all calls that share it.
    """
    error = "no call"
    for n in range(tries):
        try:
            if pause:
                pause.hold()
            return {**call(), "error": None}
        except Refused as e:
            error = f"{type(e).__name__}: {e}"
            if plain is None:
                return {"error": error}
            call, plain = plain, None
        except (Retryable, ValueError, KeyError, OSError) as e:
            error = str(e) if isinstance(e, Retryable) else f"{type(e).__name__}: {e}"
            if n < tries - 1:
                if pause and isinstance(e, Retryable):
                    pause.ask(2.0**n)
                else:
                    wait(2.0**n)
        except Exception as e:
            return {"error": f"{type(e).__name__}: {e}"}
    return {"error": error}


def in_window(call: Callable, items: Iterable, calls: int) -> Iterator:
    """call(item) of each item in their order, `calls` at a time; no more than twice as many are begun or wait to be taken."""
    with ThreadPoolExecutor(calls) as pool:
        window: deque = deque()
        for item in items:
            window.append(pool.submit(call, item))
            if len(window) >= 2 * calls:
                yield window.popleft().result()
        while window:
            yield window.popleft().result()


#: Calls of a task at a time, and rows of a batch that it gives back.
CALLS, ROWS_BACK = 6, 64
_READ = "sha256 string, fields map<string,string>, confidence map<string,double>, fills boolean, used string, error string, cost double, orientation string, quad_found boolean, processed string"


def extract(files: DataFrame, extractor: Extractor, preprocessor: Preprocessor | None = None, calls: int = CALLS) -> DataFrame:
    """One read per file, and a second one of the full frame if the crop read nothing or did not fill the frame; costs of both add up.

    A task keeps `calls` calls under way and gives rows back in their order.  processed: hash of the image that was read.
    """
    prep = preprocessor or NoCrop()
    again = getattr(extractor, "read_plain", None)

    def one(row: tuple[str, bytes], pause: Pause) -> tuple:
        sha, image = row
        ask = lambda data: with_retries(lambda: extractor.read(data), plain=again and (lambda: again(data)), pause=pause)
        try:
            crop = prep.crop(image)
        except Exception as e:
            return sha, {}, {}, True, "none", f"{type(e).__name__}: {e}", 0.0, "upright", False, None
        first = ask(crop if crop is not None else image)
        used, cost, got = "crop" if crop is not None else "full", float(first.get("cost") or 0), first
        empty = not any((first.get("fields") or {}).get(f) for f in rules.REQUIRED)
        if crop is not None and not first["error"] and (empty or first.get("fills") is False):
            second = ask(image)
            cost += float(second.get("cost") or 0)
            if any((second.get("fields") or {}).get(f) for f in rules.REQUIRED):
                got, used = second, "full"
        conf = {k: float(v) for k, v in (got.get("confidence") or {}).items() if isinstance(v, (int, float))}
        fields = {k: None if v is None else str(v) for k, v in (got.get("fields") or {}).items()}
        turned = "upside_down" if got.get("orientation") == "upside_down" else "upright"
        processed = hashlib.sha256(crop if used == "crop" else image).hexdigest()
        return sha, fields, conf, got.get("fills") is not False, used, got["error"], cost, turned, used == "crop", processed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pause, columns = Pause(), [c.split()[0] for c in _READ.split(", ")]
        rows = in_window(lambda row: one(row, pause), ((s, bytes(c)) for b in batches for s, c in zip(b.sha256, b.content, strict=True)), calls)
        while part := list(islice(rows, ROWS_BACK)):
            yield pd.DataFrame(part, columns=columns)

    return files.select("sha256", "content").mapInPandas(run, _READ)


def count_open(records: DataFrame, stored: DataFrame) -> DataFrame:
    """sha256, duplicates: the stored records with the plate or the phone of each record (blank ones count for nothing), and whether an earlier one of the batch has either.

    records: sha256, path, plate_norm, tel_digits; stored: plate_norm, tel_digits.  Numbers by key are joined, never pairs: those of the plate and
    of the phone, less those of both.
    """
    keys, n = ["plate_norm", "tel_digits"], F.count(F.lit(1))
    some = {k: F.col(k) != "" for k in keys}
    out = records
    for k in keys:
        out = out.join(stored.filter(some[k]).groupBy(k).agg(n.alias(f"n_{k}")), k, "left")
        out = out.join(records.filter(some[k]).groupBy(k).agg(F.min("path").alias(f"first_{k}")), k, "left")
    out = out.join(stored.filter(some[keys[0]] & some[keys[1]]).groupBy(*keys).agg(n.alias("n_both")), keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    earlier = F.coalesce((F.col("first_plate_norm") < F.col("path")) | (F.col("first_tel_digits") < F.col("path")), F.lit(False))
    return out.select("sha256", (zero(F.col("n_plate_norm")) + zero(F.col("n_tel_digits")) - zero(F.col("n_both")) + earlier.cast("int")).alias("duplicates"))


def ingest(
    files: DataFrame, known: DataFrame, extractor: Extractor, as_of_year: int, preprocessor: Preprocessor | None = None, stored: DataFrame | None = None, calls: int = CALLS, once: Callable[[DataFrame], DataFrame] = cut
) -> tuple[DataFrame, DataFrame]:
    """(records, skipped) of a batch of files (path, content, sha256).

    known: sha256, record, created of images that are stored.  A file whose hash is stored, or that stands behind an equal one
    in the batch, is skipped and never reaches the model; one whose read failed gives no record either, and its error is in `skipped`.
    stored: plate_norm, tel_digits of records that are open and not rejected; who shares either is a suspect, as is a file
    whose processed image is known or was read earlier in the batch.  `once` writes the reads, so no later step pays for them again.
    """
    first = duplicates.first_wins(files.select("path", "sha256"), "sha256", [F.asc("path")])
    gate = duplicates.hash_gate(first, known, "sha256", "created", "record")
    skipped = gate.filter((F.col("pos") > 1) | F.col("holder").isNotNull()).select("path", "sha256", "holder", F.lit(None).cast("string").alias("error"))
    fresh = files.join(gate.filter((F.col("pos") == 1) & F.col("holder").isNull()).select("path"), "path", "left_semi")
    read = once(extract(fresh, extractor, preprocessor, calls)).join(gate.filter("pos = 1").select("sha256", "path"), "sha256")
    failed = read.filter(F.col("error").isNotNull()).select("path", "sha256", F.lit(None).cast("string").alias("holder"), "error")
    r = read.filter(F.col("error").isNull()).withColumn("fields", rules.canonical_fields(F.col("fields")))
    got = {k: F.try_element_at("fields", F.lit(k)) for k in rules.FIELDS}
    norms = {k: text.normaliser(k, as_of_year)(c) for k, c in got.items()}
    r = r.select("*", *[c.alias(f"{k}_norm") for k, c in norms.items()])
    if stored is None:
        stored = files.sparkSession.createDataFrame([], "plate_norm string, tel_digits string")
    open_ = count_open(r.select("sha256", "path", F.col("noplate_norm").alias("plate_norm"), F.col("tel_norm").alias("tel_digits")), stored)
    seen = r.groupBy("processed").agg(F.min("path").alias("first_read")).join(known.select(F.col("sha256").alias("processed"), F.lit(True).alias("is_known")).distinct(), "processed", "left")
    r = r.join(open_, "sha256").join(seen, "processed")
    problems = rules.field_problems(got, as_of_year)
    again = F.coalesce("is_known", F.lit(False)) | (F.col("first_read") < F.col("path"))
    reasons = rules.evaluate(problems, rules.low_fields(F.col("confidence")), F.col("duplicates"))
    reasons = F.when(again, F.array_sort(F.array_distinct(F.array_append(reasons, F.lit("duplicate_image"))))).otherwise(reasons)
    audit = rules.audit_document(
        fields=F.col("fields"), quad_found=F.col("quad_found"), problems=problems, orientation=F.col("orientation"), fills_frame=F.col("fills"), preprocess_version=F.lit((preprocessor or NoCrop()).VERSION)
    )
    records = r.select(
        "sha256",
        *[c.alias(k) for k, c in got.items()],
        *[f"{k}_norm" for k in norms],
        reasons.alias("review_reason"),
        (F.size(reasons) > 0).alias("needs_review"),
        F.lit("pending").alias("review_status"),
        "used",
        "cost",
        "duplicates",
        audit.alias("raw_ocr"),
    )
    return records, skipped.unionByName(failed)
