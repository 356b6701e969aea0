import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import make, prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows():
    """Copies, edits, shared passages, nulls, empty and long texts, ties and repeated rows."""
    chance = random.Random(11)
    base, passage = prose(chance, 120), prose(chance, 60)
    rows = [(i, prose(chance, chance.randrange(1, 200)), chance.choice(["en", "de", None]), chance.choice(["s1", "s2", "é", None, "s3"])) for i in range(40)]
    rows += [(100 + i, base, "en", "s1") for i in range(12)]
    for i in range(25):
        edited = base.split()
        for _ in range(chance.randrange(1, 12)):
            edited[chance.randrange(len(edited))] = f"edit{chance.randrange(30)}"
        rows.append((200 + i, " ".join(edited), "en", "s1"))
    rows += [(300 + i, prose(chance, 30) + "\n" + passage + "\t" + prose(chance, 40), "de", "s2") for i in range(5)]
    rows += [(400, None, "en", "s1"), (401, "", "en", None), (402, " \n\t ", None, "s2"), (403, "Two Words", "en", "s1"), (404, "two words", "en", "s1"), (405, "!!! 123", "en", "s9")]
    rows += [(500, prose(chance, 30_000, 5_000), "en", "s1"), (501, "x" * 300_000, "de", "s1"), (502, "aa " * 5_000, "de", "s3")]
    rows += [(600, "a repeated row of text", "en", "s1")] * 3 + [(None, base, "en", "s1"), (None, "no id here", None, None), (-7, "ünïcode wörds ñ é 漢字 。", "de", "s2")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows).repartition(3, F.xxhash64("text", "doc_id"))


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
