import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared lines and passages, white space of all kinds, empty and very long texts."""
    rng = random.Random(7)
    texts = [prose(rng, 60 + rng.randrange(80)) + "." for _ in range(40)]
    texts[3] = texts[2]
    texts[5] = texts[4].replace(texts[4].split()[40], "changed", 1)
    line, passage = "This line stands in many documents.", prose(rng, 40)
    for at in range(8, 16):
        texts[at] += f"\n  {line.upper() if at % 2 else line}\t\n" + prose(rng, 20)
    for at in range(16, 22):
        texts[at] = prose(rng, 20) + " " + passage + " " + prose(rng, 20)
    texts += [None, "", "", " \n\t\x0b\x0c\r ", "one", "one", "two words", "\n\n", "é" * 300, "a" * 700, "=" * 64 + "\n" + "=" * 64]
    texts += [prose(rng, 12_000), "BUY NOW!! " * 90, "x# y$ z% " * 60, "漢字 かな 😀 " * 30, "same words again " * 40]
    return [(at, text, "en", None if at % 9 == 0 else f"s{at % 3}", len(text or "")) for at, text in enumerate(texts)]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, COLUMNS).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def odd(spark, corpus):
    """Null ids, repeated rows, repeated ids, and columns named like those that operators use or return."""
    rows = [(*row, at, "x", 1) for at, row in enumerate(corpus[:12])]
    rows += [rows[2], rows[2], (None, corpus[8][1], None, None, None, 1, None, None), (None, None, None, None, None, 1, "y", 2)]
    rows += [(4, "other text of a repeated id", "en", "s1", 5, 3, "z", 3)]
    return spark.createDataFrame(rows, COLUMNS + ", _id long, `a.b` string, n_lines int")
