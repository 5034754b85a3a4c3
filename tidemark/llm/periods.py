"""Periodic runs of words: stretches that repeat one root four times or more.

A run is a longest stretch of consecutive words with smallest period q (words q apart are equal) and a length of
at least max(6, 4 q).

* Frequency splitting: every word of a run occurs in it once per period, so four times or more. A word that occurs
  less often in its segment therefore cuts the segment. Cutting makes other words rare, so it is repeated on what
  was cut until no segment changes. All texts of a batch are cut side by side.
* Lag scan of what survives, by octaves of the lag. A run of period q in [Q, 2Q) holds, at a place that is a
  multiple of Q, a window of 2Q words that comes again q words later, inside the run. So each such window is
  compared with the windows Q to 2Q later by rolling hashes, one comparison per word and octave, and every lag that
  agrees is then extended both ways on the words themselves. Work is n log n in the length of a segment.

Each text is one row of one task; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidemark.llm.common import words_of

#: Periods a run holds at least, and words.
TIMES, LEAST = 4, 6
#: Words of the texts that are cut side by side; a longer text is on its own.
BATCH = 200_000

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def survivors(words: np.ndarray, segment: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the segments that are left of numbered ``words`` when cutting at rare words changes nothing.

    ``segment`` numbers the text of each word, ascending; segments never span texts.
    """
    at, done = np.arange(len(words)), []
    while len(at):
        # Count each word of each segment: sort by both, measure the stretches.
        order = np.lexsort((words[at], segment))
        w, s = words[at][order], segment[order]
        edges = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (s[1:] != s[:-1])])
        counts = np.empty(len(at), "int64")
        counts[order] = np.repeat(np.diff(np.r_[edges, len(at)]), np.diff(np.r_[edges, len(at)]))
        keep = counts >= TIMES
        whole = np.ones(segment[-1] + 1, bool)
        whole[segment[~keep]] = False
        stable = whole[segment]
        done += stretches(at[stable], segment[stable])
        at, old = at[keep & ~stable], segment[keep & ~stable]
        if len(at):
            starts = np.r_[True, (np.diff(at) != 1) | (np.diff(old) != 0)]
            segment = np.cumsum(starts) - 1
            long = (np.bincount(segment) >= LEAST)[segment]
            at, segment = at[long], np.unique(segment[long], return_inverse=True)[1]
    return [x for x in done if x[1] - x[0] >= LEAST]


def stretches(at: np.ndarray, segment: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the segments whose places ``at`` are."""
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(at) else np.zeros(0, "int64")
    last = np.r_[first[1:], len(at)] - 1
    return list(zip(at[first].tolist(), (at[last] + 1).tolist())) if len(at) else []


def spread(x: np.ndarray) -> np.ndarray:
    """Another 64-bit number for each number; products wrap around."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def agreeing(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places from ``at`` on, in steps of 1 or -1, hold the same word as the place ``lag`` words later."""
    count, width = 0, 64
    while True:
        room = len(words) - lag - at if step > 0 else at + 1
        width = min(width, room)
        if width <= 0:
            return count
        low = at if step > 0 else at - width + 1
        differ = words[low : low + width] != words[low + lag : low + lag + width]
        if differ.any():
            return count + int(np.argmax(differ if step > 0 else differ[::-1]))
        count, at, width = count + width, at + step * width, 4 * width


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment of numbered words, by start and period."""
    found: dict[tuple[int, int], int] = {}
    windows, octave = spread(words.astype("uint64") + np.uint64(1)), 1
    while TIMES * octave <= len(words) and len(windows) > octave:
        # Windows of 2Q words from those of Q words.
        windows = spread(windows[:-octave] * np.uint64(0x2545F4914F6CDD1D) + windows[octave:])
        places = np.arange(octave, len(windows))
        origin = (places // octave - 1) * octave
        hits = np.flatnonzero(windows[places] == windows[origin])
        reached: dict[int, int] = {}
        for hit in hits[np.unique(origin[hits], return_index=True)[1]].tolist():
            anchor, lag = int(origin[hit]), int(places[hit] - origin[hit])
            if anchor + lag + 2 * octave <= reached.get(lag, 0):
                continue  # inside a stretch that this lag has given already
            after = agreeing(words, anchor, lag, 1)
            before = agreeing(words, anchor - 1, lag, -1)
            start, length = anchor - before, before + after + lag
            reached[lag] = max(reached.get(lag, 0), start + length)
            if length >= max(LEAST, TIMES * lag):
                found.setdefault((start, length), lag)  # a smaller lag has been here first
        octave *= 2
    return sorted((start, length, lag) for (start, length), lag in found.items())


def runs_of(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start and period."""
    numbers: dict[str, int] = {}
    lengths = [len(t) for t in texts]
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), "int64", sum(lengths))
    owner = np.repeat(np.arange(len(texts)), lengths)
    offsets = np.r_[0, np.cumsum(lengths)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for low, high in survivors(words, owner):
        text = int(owner[low])
        base = low - int(offsets[text])
        out[text] += [(base + start, length, period) for start, length, period in lag_scan(words[low:high])]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by one space, less those that a run holds after its first period."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return " ".join([w for w, k in zip(words, keep.tolist()) if k])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``n_words`` long, ``runs`` array<struct<start, length, period>> by start and period, ``collapsed`` string.

    ``collapsed`` holds the words outside runs and each run's first period, joined by one space. A null, empty or
    blank text has no words, no runs and an empty ``collapsed``; an empty table gives none. Texts are read whole at
    any length. The other columns of ``docs`` are kept as they are, of whatever name, in the struct ``doc``.
    Repeated rows each give a row.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).cast("string").alias("text"))

    def batches_of(texts: pa.Array) -> Iterator[tuple[int, list[list[str]]]]:
        at, size, held = 0, 0, []
        for k, value in enumerate(texts):
            words = words_of(value.as_py())
            if held and size + len(words) > BATCH:
                yield at, held
                at, size, held = k, 0, []
            held.append(words)
            size += len(words)
        if held:
            yield at, held

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in batches_of(batch.column(1)):
                runs = runs_of(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([[dict(zip(RUN.names, r)) for r in rs] for rs in runs], pa.list_(RUN)),
                        pa.array([collapsed(t, rs) for t, rs in zip(texts, runs)], pa.string()),
                    ],
                    names=["doc", "n_words", "runs", "collapsed"],
                )

    run = StructType([StructField(k, LongType()) for k in RUN.names])
    schema = StructType([rows.schema["doc"], StructField("n_words", LongType()), StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])
    return rows.mapInArrow(each, schema)
