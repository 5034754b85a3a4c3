"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. A forward algorithm adds up the
probabilities of all ways to cut a word into pieces; no single segmentation is chosen. Pieces never cross a
run of letters, so a text's log likelihood is the sum of its runs', and runs met before are looked up. Probabilities
are fitted by expectation maximisation over the same lattice.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, sized, stored

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: Longest piece that is looked up; what a character outside the vocabulary costs in every language.
LONGEST, UNKNOWN = 16, 1e-9
#: Words up to this length go through the lattice side by side; longer ones one by one.
PLAIN = 40
REMEMBERED = 500_000


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of the vocabulary that stand for text."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


POWERS = np.cumprod(np.full(LONGEST + 1, 0x9E3779B97F4A7C15, "uint64"), dtype="uint64") * np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def prefix_hashes(words: Sequence[str]) -> np.ndarray:
    """64-bit polynomial hashes of the first 0, 1, ... characters of words of one length, a row per prefix."""
    n = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).T.astype("uint64")
    out = np.zeros((n + 1, len(words)), "uint64")
    for k in range(n):
        out[k + 1] = out[k] * POWERS[1] + codes[k] + np.uint64(1)
    return out


@dataclass
class PieceModel:
    """Piece probabilities, one column per language; the last row is the character outside the vocabulary."""

    languages: list[str]
    pieces: Mapping[str, int]
    probability: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        """Hashes of the pieces, sorted, per length; substrings are looked up among those of their length."""
        by_length: dict[int, list[str]] = defaultdict(list)
        for p in self.pieces:
            by_length[len(p)].append(p)
        self.hashed = {}
        for n, ps in by_length.items():
            if n <= LONGEST:
                keys = prefix_hashes(ps)[n]
                order = np.argsort(keys)
                self.hashed[n] = keys[order], np.array([self.pieces[p] for p in ps])[order]

    def lattice(self, words: Sequence[str]) -> dict[tuple[int, int], np.ndarray]:
        """Row of the piece that covers (i, j) in each of the words, all of one length; -1 where there is none."""
        n, unknown, hashes = len(words[0]), len(self.pieces), prefix_hashes(words)
        out = {}
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                if j - i not in self.hashed:
                    rows = np.full(len(words), -1)
                else:
                    keys, ids = self.hashed[j - i]
                    own = hashes[j] - hashes[i] * POWERS[j - i]
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    rows = np.where(keys[at] == own, ids[at], -1)
                if j - i == 1:
                    rows[rows < 0] = unknown
                if (rows >= 0).any():
                    out[i, j] = rows
        return out

    def forward(self, lattice: Mapping[tuple[int, int], np.ndarray], n: int, probability: np.ndarray) -> list[np.ndarray]:
        """Per character, the factor by which it changes the sum over all segmentations up to it; 1 before the first."""
        factors = [np.ones((len(next(iter(lattice.values()))), probability.shape[1]))]
        for j in range(1, n + 1):
            total, since = np.zeros_like(factors[0]), 1.0
            for i in range(j - 1, max(0, j - LONGEST) - 1, -1):
                if (i, j) in lattice:
                    total += self.chances(lattice[i, j], probability) / since
                since = since * factors[i]
            factors.append(total)
        return factors

    @staticmethod
    def chances(rows: np.ndarray, probability: np.ndarray) -> np.ndarray:
        found = probability[rows]
        found[rows < 0] = 0.0
        return found

    def log_likelihood(self, words: Sequence[str]) -> np.ndarray:
        """Log of the sum over all segmentations, a row per run of letters and a column per language."""
        out = np.empty((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            by_length[len(w) + 1].append(k)
        for n, where in by_length.items():
            marked = [START + words[k] for k in where]
            if n <= PLAIN:
                factors = self.forward(self.lattice(marked), n, self.probability)
                out[where] = sum(np.log(np.prod(factors[k : k + LONGEST], axis=0)) for k in range(0, n + 1, LONGEST))
            else:
                for k, w in zip(where, marked):
                    out[k] = self.long_word(w)
        return out

    def long_word(self, word: str) -> np.ndarray:
        """The same sum for one word of any length: a window of the last states, rescaled at every character."""
        states, scale = [np.ones(len(self.languages))], np.zeros(len(self.languages))
        for j in range(1, len(word) + 1):
            total = np.zeros(len(self.languages))
            for back, state in enumerate(reversed(states), 1):
                row = self.pieces.get(word[j - back : j], len(self.pieces) if back == 1 else -1)
                if row >= 0:
                    total += state * self.probability[row]
            states = [s / total for s in states[-LONGEST + 1 :]] + [np.ones_like(total)]
            scale += np.log(total)
        return scale

    def expected(self, counted: Mapping[str, int], probability: np.ndarray, kept: dict) -> np.ndarray:
        """Expected number of uses of each piece in the counted words under one column of probabilities."""
        uses = np.zeros(len(probability))
        if not kept:
            by_length: dict[int, list[str]] = defaultdict(list)
            for w in counted:
                if len(w) + 1 <= PLAIN:
                    by_length[len(w) + 1].append(w)
            kept.update({n: (self.lattice([START + w for w in ws]), np.array([counted[w] for w in ws], float)) for n, ws in by_length.items()})
        column = probability[:, None]
        for n, (lattice, weight) in kept.items():
            factors = self.forward(lattice, n, column)
            # The probability that a segmentation cuts at each character.
            cut = [np.zeros_like(factors[0]) for _ in range(n + 1)]
            cut[n] += 1.0
            for j in range(n, 0, -1):
                since = 1.0
                for i in range(j - 1, max(0, j - LONGEST) - 1, -1):
                    since = since * factors[i + 1]
                    if (i, j) in lattice:
                        rows = lattice[i, j]
                        share = self.chances(rows, column) * cut[j] / since
                        cut[i] += share
                        np.add.at(uses, rows[rows >= 0], (share[:, 0] * weight)[rows >= 0])
        chances = probability.tolist()
        for w, times in counted.items():
            if len(w) + 1 > PLAIN:
                self.add_long_word(START + w, times, chances, uses)
        return uses

    def add_long_word(self, word: str, times: int, chances: list[float], uses: np.ndarray) -> None:
        """Add the expected uses of pieces in one word of any length."""
        n, factors, cut = len(word), [1.0], [0.0] * len(word) + [1.0]

        def ending(j: int) -> Iterator[tuple[int, int]]:
            for back in range(1, min(j, LONGEST) + 1):
                yield j - back, self.pieces.get(word[j - back : j], len(self.pieces) if back == 1 else -1)

        for j in range(1, n + 1):
            total, since = 0.0, 1.0
            for i, row in ending(j):
                if row >= 0:
                    total += chances[row] / since
                since *= factors[i]
            factors.append(total)
        for j in range(n, 0, -1):
            since = 1.0
            for i, row in ending(j):
                since *= factors[i + 1]
                if row >= 0:
                    share = chances[row] * cut[j] / since
                    cut[i] += share
                    uses[row] += times * share


def fit(counts: Mapping[str, Mapping[str, int]], pieces: Sequence[str], rounds: int = 4, prior: float = 0.05) -> PieceModel:
    """Piece probabilities of each language from its word counts. ``prior`` is added to every piece's uses."""
    languages = sorted(counts)
    index = {p: k for k, p in enumerate(pieces)}
    model = PieceModel(languages, index, np.full((len(index) + 1, len(languages)), 1.0 / len(index)))
    model.probability[-1] = UNKNOWN
    for column, language in enumerate(languages):
        kept: dict = {}
        probability = model.probability[:, column].copy()
        for _ in range(rounds):
            uses = model.expected(counts[language], probability, kept)[:-1] + prior
            probability[:-1] = uses / uses.sum()
        model.probability[:, column] = probability
    return model


def training_words(docs: DataFrame, rows_per_language: int = 400) -> dict[str, dict[str, int]]:
    """Word counts per language of a bounded sample of the training fold.

    Rows are drawn by a hash of the id, about ``rows_per_language`` of each language; all words of their whole
    texts count, so a language learns the same however many others there are.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 2))
    sizes = usable.groupBy("lang").count().select(F.col("lang").alias("__lang"), "count")
    chance = F.lit(float(rows_per_language)) / F.col("count")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < chance
    some = usable.join(sized(stored(sizes, "languages")), F.col("lang") == F.col("__lang")).filter(drawn)
    counted = some.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("lang", "word").count()
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counted.orderBy("lang", "word").toLocalIterator():
        out[r["lang"]][r["word"]] = r["count"]
    return dict(out)


_known: dict[str, tuple[dict[str, int], list[np.ndarray]]] = {}


def likelihoods(model: PieceModel, texts: Sequence[str]) -> np.ndarray:
    """Log likelihood of whole texts, a row per text: the sum over their runs of letters.

    Digits and signs say nothing of a language. Runs and their values stay in the worker's memory.
    """
    if model.name not in _known:
        _known.clear()
        _known[model.name] = ({}, [np.zeros((0, len(model.languages)))])
    known, table = _known[model.name]
    split = [LETTERS.findall(t.lower()) for t in texts]
    new = set().union(*split).difference(known)
    if new:
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            table[0] = table[0][:0]
            new = set().union(*split)
        fresh = list(new)
        known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
        table[0] = np.concatenate([table[0], model.log_likelihood(fresh)])
    out = np.zeros((len(texts), len(model.languages)))
    for k, ws in enumerate(split):
        if ws:
            out[k] = table[0][np.fromiter(map(known.__getitem__, ws), "int64", len(ws))].sum(axis=0)
    return out


def identify(docs: DataFrame, model: PieceModel | None, doc_id: str = "doc_id", text: str = "text", together: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; ``score`` is the posterior under equal priors.

    ``und`` with score 0 for a null text, one without a letter, or without a model. Ties go to the first
    language by name. Texts are scored whole, ``together`` at a time. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, together):
                batch = whole.slice(at, together)
                texts = batch.column(1).to_pylist()
                lettered = [k for k, t in enumerate(texts) if model is not None and t and any(map(str.isalpha, t))]
                names: list[str] = ["und"] * len(texts)
                scores = np.zeros(len(texts))
                if lettered:
                    logs = likelihoods(model, [texts[k] for k in lettered])
                    best = logs.argmax(axis=1)
                    scores[lettered] = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    for k, b in zip(lettered, best):
                        names[k] = model.languages[b]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names), pa.array(scores)], schema=schema)

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(fold(F.col(doc_id)) == 2, F.lit(False)).alias("held_out"),
    )
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def train(docs: DataFrame, vocabulary_path: str | None = None, **sample: int) -> PieceModel | None:
    """Fit on the training fold of ``docs`` (doc_id, text, lang); None where it names no language."""
    counts = training_words(docs, **sample)
    return fit(counts, vocabulary(vocabulary_path)) if counts else None
