"""Documents with the awkward cases: nulls, empty and very long texts, ties, repeats."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ta", "ri", "mo", "né", "ul", "so", "ke"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(n: int = 60) -> list[tuple]:
    rows = []
    for i in range(n):
        text = prose(i, 20 + (i * 37) % 200)
        if i % 7 == 3:
            text = prose(i - 1, 20 + ((i - 1) * 37) % 200)  # copies of the one before
        if i % 7 == 5:
            words = prose(i - 1, 20 + ((i - 1) * 37) % 200).split()
            words[len(words) // 2] = "edited"
            text = " ".join(words)
        rows.append((i, text, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 11 else None, len(text)))
    rows += [
        (1000, None, None, None, None),
        (1001, "", "en", "src1", 0),
        (1002, "   \n\t ", "en", "src1", 6),
        (1003, "one two", "en", "src1", 7),
        (1004, "one two", "fr", "src2", 7),
        (1005, "ONE  TWO", "fr", "src2", 8),
        (1006, prose(5, 9000), "en", "src0", 1),
        (1007, "x" * 40_000, "en", "src0", 40_000),
        (1008, "12 34 !? ...", "en", "src0", 12),
        (1009, "<|endoftext|> naïve space line <|startoftext|>end's İstanbul ﬁne é", "fr", "src0", 1),
        (1010, "\x00nul\x7f and 　wide", None, "src0", 1),
        (None, prose(3, 30), "en", "src0", 1),
        (1011, prose(77, 50), "en", "src0", 1),
        (1011, prose(77, 50), "en", "src0", 1),
    ]
    return rows


def frame(spark, rows=None, extra: bool = False):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({"row": F.lit(1), "part": F.lit("x"), "score2": F.lit(0.0), "n": F.lit(3), "tokens": F.lit("t"), "block2": F.lit(1)})
    return df.repartition(3)
