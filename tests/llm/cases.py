"""Small tables of odd rows that every operator has to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees in silence"
LONG = " ".join(f"word{i} and{i % 13}" for i in range(30_000))


def odd_rows():
    texts = [
        None, "", "   \n\t ", "one", "one two three", LINE, LINE, LINE.upper(), f"{LINE}\n{LINE}\n{LINE}", LONG, LONG + " end", "é" * 150 + " tail " + "é" * 150, "Released under the MIT License.",
        "Licensed under CC BY-NC 4.0.", "x" * 400, " ".join(["spam"] * 300), "%%% $$$ ###", "12 34 56", "日本語 の 文章", "a\x1cb c", "<|endoftext|> marks", "tab\tseparated\r\nlines\x0bhere",
    ]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "hot", "hot", "s1"][i % 4], len(t) if t else None) for i, t in enumerate(texts)]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def clashing(spark):
    """Repeated and null ids, repeated rows, and columns named like the operators' own."""
    rows = [(*r, 1, "kept?", 2.5, "k", 7) for r in odd_rows()]
    rows = [*rows, rows[5], rows[5], (5, "another text under a used id", "en", "hot", 3, 1, "c", 0.0, "k", 7), (None, LINE, None, None, None, 1, "c", 0.0, "k", 7), (None, None, None, None, None, 1, "c", 0.0, "k", 7)]
    return spark.createDataFrame(rows, DOCS + ", key long, kept string, score double, row string, n_words long")


def empty(spark):
    return spark.createDataFrame([], DOCS)
