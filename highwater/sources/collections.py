"""One large feature collection read by many tasks.

A JSON document has no line to split at, and whether a byte lies inside a string or how deep it is nested depends on all bytes
before it. Both depend on little, though: a stretch of bytes only turns "in a string" on or off and adds to the depth. So every
split is scanned once for what it changes, running sums over the splits of a file give each split's state at its start, and each
split then cuts out the features that begin in it.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

QUOTE, BACKSLASH, OPENING, CLOSING = 0x22, 0x5C, (0x7B, 0x5B), (0x7D, 0x5D)
FEATURE_DEPTH = 2  # the document's object, its list of features
CHANGES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("quotes", pa.int32()),
                     ("depth_outside", pa.int64()), ("depth_inside", pa.int64())])
FEATURES = pa.schema([("path", pa.string()), ("at", pa.int64()), ("feature", pa.string())])


def feature_texts(spark: SparkSession, path: str, split_bytes: int = 16 << 20) -> DataFrame:
    """The features of GeoJSON collections as JSON text (path, at: first byte, feature), one task per ``split_bytes`` of a file.

    Objects two levels down that are no features, such as the properties of a coordinate system, are left out by their ``type``.
    A task holds its split and the rest of its last feature. Files without features give no row; one cut off inside a feature fails.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint")))
    splits = files.select("path", "length", starts.alias("start")).select(
        "path", "start", F.least(F.col("start") + split_bytes, "length").alias("stop"))
    n = max(1, files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1)
    changes = splits.repartition(n, "path", "start").mapInArrow(
        _changes, "path string, start bigint, stop bigint, quotes int, depth_outside bigint, depth_inside bigint")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split of a file
    quoted = changes.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    gained = F.when(F.col("inside") == 1, F.col("depth_inside")).otherwise(F.col("depth_outside"))
    placed = quoted.withColumn("gained", gained).withColumn("depth", F.coalesce(F.sum("gained").over(before), F.lit(0)))
    return placed.select("path", "start", "stop", "inside", "depth").repartition(n, "path", "start").mapInArrow(
        _features, "path string, at bigint, feature string").where(F.get_json_object("feature", "$.type") == "Feature")


def _open(path: str):
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _bytes(file, start: int, stop: int) -> tuple[np.ndarray, bool]:
    """The bytes of a range and whether the first one is escaped by an odd run of backslashes before it."""
    at = start
    while at > 0 and file.read_at(1, at - 1) == b"\\":
        at -= 1
    return np.frombuffer(file.read_at(stop - start, start), dtype=np.uint8), (start - at) % 2 == 1


def _structure(b: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: 1 for a quote that opens or closes a string; and +1 for an opening bracket, -1 for a closing one, in strings too."""
    quotes = np.flatnonzero(b == QUOTE)
    odd, back, left = np.zeros(len(quotes), dtype=bool), quotes - 1, np.arange(len(quotes))
    while len(left):  # one step back along each run of backslashes before a quote
        here = back[left]
        slash = np.where(here >= 0, b[here] == BACKSLASH, False)
        odd[left[(here < 0)]] ^= escaped
        left = left[slash]
        odd[left] ^= True
        back[left] -= 1
    turns = np.zeros(len(b), dtype=np.int8)
    turns[quotes[~odd]] = 1
    steps = np.zeros(len(b), dtype=np.int8)
    for opening, closing in zip(OPENING, CLOSING):
        steps[b == opening] = 1
        steps[b == closing] = -1
    return turns, steps


def _outside(turns: np.ndarray, inside: int) -> np.ndarray:
    return np.bitwise_xor.accumulate(turns) == inside


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with _open(r["path"]) as file:
                turns, steps = _structure(*_bytes(file, r["start"], r["stop"]))
            out = _outside(turns, 0)
            yield pa.RecordBatch.from_pylist([{**r, "quotes": int(turns.sum(dtype=np.int64) % 2), "depth_outside": int(steps[out].sum(dtype=np.int64)),
                                               "depth_inside": int(steps[~out].sum(dtype=np.int64))}], CHANGES)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with _open(r["path"]) as file:
                b, escaped = _bytes(file, r["start"], r["stop"])
                turns, steps = _structure(b, escaped)
                out = _outside(turns, int(r["inside"]))
                steps[~out] = 0
                depth = r["depth"] + np.cumsum(steps, dtype=np.int32)
                first = np.flatnonzero((steps == 1) & (depth == FEATURE_DEPTH + 1) & (b == OPENING[0]))
                end = np.flatnonzero((steps == -1) & (depth == FEATURE_DEPTH) & (b == CLOSING[0])) + 1
                end = end[end > first[0]] if len(first) else end[:0]
                raw = b.tobytes()
                if len(first) > len(end):  # the last feature goes on behind the split
                    raw += _rest(file, r["stop"], int(depth[-1]), 0 if out[-1] else 1)
                    end = np.append(end, len(raw))
            yield pa.RecordBatch.from_pydict({"path": [r["path"]] * len(first), "at": r["start"] + first,
                                              "feature": [raw[i:j].decode() for i, j in zip(first, end)]}, FEATURES)


def _rest(file, at: int, depth: int, inside: int, step: int = 1 << 20) -> bytes:
    """The bytes from ``at`` on up to the end of the feature that is open there."""
    parts, size = [], file.size()
    while at < size:
        b, escaped = _bytes(file, at, min(at + step, size))
        turns, steps = _structure(b, escaped)
        out = _outside(turns, inside)
        level = depth + np.cumsum(np.where(out, steps, 0), dtype=np.int32)
        done = np.flatnonzero(level == FEATURE_DEPTH)
        if len(done):
            return b"".join(parts) + b[:done[0] + 1].tobytes()
        parts.append(b.tobytes())
        at, depth, inside = at + len(b), int(level[-1]), 0 if out[-1] else 1
    raise ValueError("the document ends inside a feature")
