"""Quality rules as a short-circuit cascade of column expressions.

Each rule's cost and rejection rate are estimated on a sample, the rules are ordered by rejections per second,
and one CASE expression tests them in that order: a row leaves at the first rule it fails, so later rules
are not evaluated for it. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, stored

SYMBOLS = "[#*$%&|<>]"
BLANK_NOT = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A row is rejected where ``fails`` is true. Null counts as passing."""

    name: str
    fails: Column


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__text`` (null as empty) and ``__words``, the words of the whole text."""
    raw = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(raw, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANK}+"))
    return docs.withColumn("__text", raw).withColumn("__words", words)


def with_base(df: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words from ``__text`` and ``__words``.

    Windows of three words are compared by a 64-bit hash. Only texts in which some window repeats are sorted;
    there, equal windows stand next to each other and mark the words they cover.
    """
    words = F.col("__words")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(BLANK_NOT))
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)),
    )
    df = df.select(
        "*",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        windows.alias("__windows"),
    )
    some_repeat = F.size(F.array_distinct("__windows")) < F.size("__windows")
    ordered = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__sorted", F.when(some_repeat, ordered))

    def repeats(e: Column, k: Column) -> Column:
        same = lambda at: F.coalesce(F.get("__sorted", at)["h"] == e["h"], F.lit(False))
        return same(k - 1) | same(k + 1)

    df = df.withColumn("__at", F.transform(F.filter("__sorted", repeats), lambda e: e["i"]))
    covered = F.concat("__at", F.transform("__at", lambda i: i + 1), F.transform("__at", lambda i: i + 2))
    counts = F.struct(
        F.size("__lines").cast("long").alias("__n_lines"),
        "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.greatest(F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # A generator of one row: a filter on the counts must not be pushed below and repeat their parts per element.
    kept = [c for c in df.columns if c not in ("n_words", "word_chars", "n_symbols", "__lines", "__windows", "__sorted", "__at")]
    return df.select(*kept, F.inline(F.array(counts)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def standard_rules() -> list[Rule]:
    """Thresholds in the range of published web-text filters; they are not fitted to any table."""
    count = lambda pattern: F.regexp_count("__text", F.lit(pattern)).cast("long")
    upper = F.length("__text") - F.length(F.regexp_replace("__text", r"\p{Lu}+", ""))
    # Whole words without a letter; possessive, so that a long one is read once.
    unlettered = count(rf"(?<!{BLANK_NOT})[^\p{{L}}\x20\x09-\x0D]++(?!{BLANK_NOT})")
    n = F.col("n_words")
    return [
        Rule("few_different_words", 100 * F.size(F.array_distinct("__words")).cast("long") < 10 * n),
        Rule("many_words_without_letters", 100 * unlettered > 30 * n),
        Rule("shouting", 100 * upper > 30 * F.col("word_chars")),
        Rule("exclamation", 100 * count("!") > 20 * n),
        Rule("symbols", 100 * F.col("n_symbols") > 10 * n),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 50 * F.greatest("__n_lines", F.lit(1))),
        Rule("word_length", ~F.col("word_chars").between(2 * n, 15 * n)),
    ]


def measure(sample: DataFrame, rules: Sequence[Rule], runs: int = 2) -> list[Measured]:
    """Cost and rejection rate of each rule on a stored sample; the time of an empty pass is taken off."""
    rows = max(sample.count(), 1)

    def timed(fails: Column) -> tuple[float, int]:
        best, hits = float("inf"), 0
        for _ in range(runs):
            start = time.perf_counter()
            hits = sample.agg(F.count(F.when(fails, 1)).alias("n")).first()["n"]
            best = min(best, time.perf_counter() - start)
        return best, hits

    idle = timed(F.length("__text") < 0)[0]
    out = []
    for rule in rules:
        seconds, hits = timed(rule.fails)
        out.append(Measured(rule, max(seconds - idle, 1e-4) / rows, hits / rows))
    return out


def ordered(measured: Sequence[Measured]) -> list[Rule]:
    """Most rejections per second first; equal worth by name."""
    return [m.rule for m in sorted(measured, key=lambda m: (-m.worth, m.rule.name))]


def first_failed(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that fails in this order, null where all pass. CASE stops at the first hit."""
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        case = case.when(rule.fails, F.lit(rule.name))
    return case


def sampled(docs: DataFrame, doc_id: str, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the id."""
    total = max(docs.select(F.count(F.lit(1)).alias("n")).first()["n"], 1)
    return docs.filter(F.pmod(F.xxhash64(doc_id), F.lit(max(total // rows, 1))) == 0)


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 2000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every row.

    The sample (about ``sample_rows`` rows) sets the order of the rules alone. A null text has no words; a text
    without words fails the base rule. Repeated rows are judged each for itself, other columns are ignored.
    """
    rules = list(rules if rules is not None else standard_rules())
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    needed = ("__text", "__words", "__n_lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    prepared = lambda df: with_base(with_words(df)).select("doc_id", *needed)
    sample = stored(prepared(sampled(narrow, "doc_id", sample_rows)).filter(~base_failed()), "rule-sample")
    rules = ordered(measure(sample, rules))
    verdict = F.when(base_failed(), F.lit(False)).otherwise(first_failed(rules).isNull())
    return prepared(narrow).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict.alias("kept"),
    )


#: Names of the standard rules with the SQL condition under which a row fails, over columns named alike.
RULE_SQL: Mapping[str, str] = {
    "few_different_words": "100 * len(list_distinct(words)) < 10 * n_words",
    "many_words_without_letters": r"100 * len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{L}'))) > 30 * n_words",
    "shouting": r"100 * len(regexp_extract_all(text, '\p{Lu}')) > 30 * word_chars",
    "exclamation": "100 * len(regexp_extract_all(text, '!')) > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * greatest(n_lines, 1)",
    "word_length": "NOT (word_chars BETWEEN 2 * n_words AND 15 * n_words)",
}
