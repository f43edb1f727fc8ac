"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, extra columns."""

import random

WORDS = ["the", "of", "and", "Licence", "data", "naïve", "über", "x1", "then", "more", "rock", "sea", "sky", "run", "go", "far"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", ",", ".", "\n"]) if rng.random() < 0.2 else "") for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    shared = [prose(rng, 30) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            text = rng.choice([None, "", " ", "\n\n", "one", "two words", "#*$ %&|<>", "the the the the the the"])
        elif kind < 0.3 and rows:
            text = rng.choice(rows)[1]
        else:
            text = "\n".join([prose(rng, rng.randint(1, 80)), rng.choice(shared) if rng.random() < 0.5 else "", prose(rng, rng.randint(1, 40))])
        rows.append((i * 3, text, rng.choice(["en", None]), rng.choice(["a", "b", "b", None]), rng.randint(0, 9)))
    long = prose(rng, 5000)
    rows += [(1000, long, "en", "a", 1), (1001, long[: len(long) // 2] + " zz", "en", "b", 1), rows[5], (rows[6][0], "other text " * 20, "en", "a", 2), (None, rows[8][1], "en", "a", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, extra=True):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if extra:  # names that operators use inside
        from pyspark.sql import functions as F

        df = df.withColumns({k: F.lit(1) for k in ("block", "bucket", "fp", "host", "line", "content", "words", "n_words", "kept", "c_0", "ids", "a", "i", "component_id")})
    return df.repartition(3)


def rows(df, *key):
    return sorted((tuple(r) for r in df.collect()), key=repr)
