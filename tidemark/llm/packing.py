"""Packing token sequences by minimum bin slack.

Tokenised documents are cut into pieces of at most the capacity. What matters for packing is only how many
pieces there are of each length, a histogram of at most ``capacity`` rows. From it a plan is made: for the
longest length left, a subset-sum dynamic program over the lengths available (a bitset of reachable fills)
finds the fullest feasible combination, which is removed as often as the counts allow. The plan grows with
the number of lengths, not of pieces. Pieces are then ranked within their length over as many tasks as needed,
and the rank picks the sequence and the place from the plan.
"""

from __future__ import annotations

import ctypes
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import global_rank
from tidemark.llm.common import stored, words_of

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a Python worker remembers, up to so many characters; beyond it the memory starts anew.
REMEMBERED, LONGEST = 250_000, 64
WORD_END = "</w>"
#: Words without any character that normalisation could compose, split or lower in an unusual way.
SIMPLE = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: The vocabulary's own rule for splitting a word, for the characters above in lower case.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+")

_memory: dict[str, dict[str, bytes]] = {}
_tokenizers: dict[str, object] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def merge_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary as bytes with their ids, which are the merge order; the word end is the byte 0.

    Pieces are spelt with a printable character for each byte: itself where Latin-1 prints it, else the next
    one from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = json.loads(Path(path).read_text())["model"]["vocab"]

    def spelt(piece: str) -> bytes:
        body = piece.removesuffix(WORD_END)
        return bytes(byte_of[c] for c in body) + b"\0" * (body != piece)

    return {spelt(piece): i for piece, i in vocabulary.items()}


def encoder(path: str | None):
    """A function from text to its ids as unsigned 32-bit little-endian bytes.

    The vocabulary's pieces never hold white space, so a text's ids are those of its words one after the
    other, and words met before are looked up. The vocabulary's control tokens, spelt out in a text, are its ids
    as the tokenizer's defaults have it: a text is cut at them first, and they may stand inside a word. Of new words those in ASCII or Latin-1 letters are split here
    and merged by tiktoken, whose result is the same since every piece of the vocabulary is what its own bytes
    merge to; all other words go to the tokenizer itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    path = path or vocabulary_path()
    if path not in _tokenizers:
        tokenizer = Tokenizer.from_file(path)
        merger = tiktoken.Encoding(Path(path).stem, pat_str="[^\0]+\0", mergeable_ranks=merge_ranks(path), special_tokens={})
        control = {t.content: array("I", [i]).tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
        literals = re.compile("(" + "|".join(re.escape(c) for c in sorted(control, key=len, reverse=True)) + ")") if control else None
        _tokenizers[path], _memory[path] = (tokenizer, merger.encode_ordinary, control, literals), {}
    (tokenizer, merged, control, literals), known = _tokenizers[path], _memory[path]

    def ids_of(word: str) -> bytes:
        if not SIMPLE.fullmatch(word):
            return array("I", tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return array("I", merged("\0".join([*PARTS.findall(word.lower()), ""]))).tobytes()

    def encode(text: str | None) -> bytes:
        if text and literals and literals.search(text):
            return b"".join(control.get(part) or plain(part) for part in literals.split(text))
        return plain(text)

    def plain(text: str | None) -> bytes:
        words = words_of(text)
        ids = list(map(known.get, words))
        if None in ids:
            if len(known) > REMEMBERED:
                known.clear()
            for at, found in enumerate(ids):
                if found is None:
                    word = words[at]
                    found = known.get(word)
                    if found is None:
                        found = ids_of(word)
                        if len(word) <= LONGEST:
                            known[word] = found
                    ids[at] = found
        return b"".join(ids)

    return encode


def release() -> None:
    """Forget the words and hand what they took back to the system: a Python worker outlives its task."""
    for known in _memory.values():
        known.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it, and alone keeps freed memory
    if trim:
        trim(0)


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
])


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A text's ids are followed by ``end``."""
    tail = np.asarray([end], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        try:
            for batch in batches:
                out: list[list] = [[], [], [], [], []]
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(value.as_py()) + tail
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        for column, x in zip(out, (key, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECES)], schema=PIECES)
        finally:
            release()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def fullest(available: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most as often as it is available, whose sum is the largest that fits into ``room``."""
    layers: list[tuple[int, int]] = []
    reach, mask = 1, (1 << (room + 1)) - 1
    for length in sorted((x for x in available if x <= room), reverse=True):
        for _ in range(min(available[length], room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            layers.append((length, reach))
            reach = more
        if reach >> room & 1:
            break
    fill, chosen = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        if not before >> fill & 1:
            chosen.append(length)
            fill -= length
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Combinations of lengths and how many sequences take each, until no piece is left."""
    left = {x: n for x, n in histogram.items() if n > 0}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest(left, capacity - longest)]
        left[longest] += 1
        used = {x: chosen.count(x) for x in set(chosen)}
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((chosen, times))
    return out


def places(made: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per length, the ranks each combination takes: rows (first rank, per sequence, first sequence, offset)."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for chosen, times in made:
        offset = 0
        for length in sorted(set(chosen), reverse=True):
            n = chosen.count(length)
            rows.setdefault(length, []).append((taken.get(length, 0), n, first, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        first += times
    return {x: np.asarray(v, "int64") for x, v in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    A null or empty text is the closing id alone. Rows that repeat an id are packed each for itself.
    Pieces of equal length are ranked by doc_id and piece, so reruns agree. No rows give no pieces.
    The driver sees the histogram (at most ``capacity`` rows) and makes a plan of about as many combinations,
    which is sent to the tasks.
    """
    table = stored(pieces(docs, capacity, end, vocabulary, doc_id, text), "pieces")
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    where = table.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() - 1
            sequence, offset = np.zeros(len(rank), "int64"), np.zeros(len(rank), "int64")
            for x in np.unique(length):
                rows, at = where.value[int(x)], np.flatnonzero(length == x)
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + k // row[:, 1]
                offset[at] = row[:, 3] + k % row[:, 1] * x
            kept = [batch.column(f.name) for f in PIECES]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*PIECES.names, "sequence_id", "offset"])

    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = global_rank(table, order, ["length"]).select(*PIECES.names, "rank")
    return ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
