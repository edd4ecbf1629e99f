import random

import pytest


def prose(seed, n, words=("the", "of", "and", "river", "stone", "market", "green", "walks", "open", "letter", "winter", "house", "small", "answer")):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) + draw.choice(["", "", "", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text[, lang[, source]]), with a column that clashes with ours."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None, "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string")

    return make


#: Nulls, emptiness, white space alone, ties, repeats, long and odd texts.
@pytest.fixture(scope="session")
def odd_rows():
    long_text = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one"), (None, "one"), (None, None), (6, long_text), (7, "###" * 100), (8, "ÀÉ 日本語 \u0301x\x00y"), (9, prose(2, 80)), (10, prose(2, 80)), (11, long_text + " more")]
