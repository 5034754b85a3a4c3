"""Documents and pages with everything that goes wrong, for all operators alike."""

from __future__ import annotations

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()

# Columns that bear names the operators use inside.
EXTRA = "id long, text string, lang string, source string, n_chars long, __digest string, row long, digest string, rank long, size long, n long, component string, __text string"


def texts() -> list[tuple[int | None, str | None]]:
    near = " ".join(BASE * 4)
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "word"), (5, "Word"), (6, " word\n"), (7, near), (8, near + " extra"), (9, near),
        (9, near), (10, LONG), (11, "word word word word word word"), (12, "a\xa0b c d"), (13, "###$$$ !!! ***"), (14, near.upper()),
        (None, "no id"), (None, "no id"), (None, None), (15, "ß Ä 日本語 \U0001f600"), (16, "x" * 50_000), (17, "<|endoftext|> it's o'clock"),
        (18, "line\nline\nline\n\nother"), (19, "\x00 nul\x1fsep"),
    ]


def documents(spark, rows=None):
    data = [
        (k, t, None if i % 5 == 0 else ["en", "de"][i % 2], None if i % 4 == 0 else f"s{i % 3}", None, "d", i, "x", 3, 4, 5, "c", "t")
        for i, (k, t) in enumerate(texts() if rows is None else rows)
    ]
    return spark.createDataFrame(data, EXTRA.replace("id long", "doc_id long", 1))


def nothing(spark):
    return documents(spark, [])
