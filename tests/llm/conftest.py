import random

import pytest

#: ids, texts: missing, empty, blank, tied, repeated, very long, unusual letters
ROUGH = [
    (3, "The quick brown fox jumps over the lazy dog.\nA line that several documents share here.\nshort"),
    (1, "a line THAT several documents share here.  \nAnother line of the first document.\nshort"),
    (3, "The quick brown fox jumps over the lazy dog.\nA line that several documents share here.\nshort"),
    (3, "Same id, other text.\nA line that several documents share here."),
    (None, "A line that several documents share here.\nno id on this one"),
    (None, None),
    (5, None),
    (6, ""),
    (7, " \t\n\x0b\x0c\r "),
    (8, "\n\n"),
    (9, "x" * 300_000),
    (10, "Été 日本 🙂 ǅ\x1cend <|endoftext|> it's 'Real 12345"),
    (11, " ".join(f"w{k % 7}" for k in range(40_000))),
    (12, "one two three"),
]
SCHEMA = "doc_id long, text string, d string, th long, row int, source string, lang string, n_chars long"


def rough_frame(spark, rows=ROUGH):
    """The rough rows with extra columns whose names operators might use themselves."""
    return spark.createDataFrame([(i, t, "d", 1, 2, None if k % 5 == 0 else f"s{k % 3}", "en", 0) for k, (i, t) in enumerate(rows)], SCHEMA)


def random_texts(n, seed=5, words=60, passage=0.5):
    """Random documents that share passages and lines, with near and exact copies."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    shared = [" ".join(rng.choice(vocab) for _ in range(rng.randint(15, 60))) for _ in range(5)]
    out = []
    for k in range(n):
        if out and rng.random() < 0.15:
            t = out[rng.randrange(len(out))].split(" ")
            if rng.random() < 0.6:
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append(" ".join(t))
            continue
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(rng.choice(shared) if rng.random() < passage else " ".join(rng.choice(vocab) for _ in range(rng.randint(1, words))))
        out.append(rng.choice([" ", "\n", "  \n"]).join(parts))
    return list(enumerate(out))


@pytest.fixture(scope="session")
def rough(spark):
    return rough_frame(spark).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return rough_frame(spark).limit(0)
