import random

import pytest

SMALL = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, repeated ids, and columns whose names could clash."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    plain = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(plain)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", None, 4), (None, plain[0], "en", "s0", 9),
             (103, plain[1] + " " + passage, "de", "s1", 1), (104, passage + "\n" + plain[2], "de", "s1", 1), (105, plain[3], None, "s2", 1),
             (105, plain[3], None, "s2", 1), (106, "one two", "en", "s2", 7), (106, "other words of the same id", "en", "s2", 1),
             (107, "x " * 40, "en", "s2", 80), (108, " ".join(rng.choice(words) for _ in range(60_000)), "fr", "s0", 1), (109, "\x00 ¤ é   ẞ", "fr", "s0", 1)]
    frame = spark.createDataFrame(rows, DOCUMENT)
    from pyspark.sql import functions as F
    for name in ("range", "size", "key", "doc", "host", "words", "hashes", "class", "node", "weight", "__marks", "position"):
        frame = frame.withColumn(name, F.lit("extra"))
    return frame


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)
