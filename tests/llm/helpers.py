"""Odd rows and plain restatements for the tests of this folder."""

import random
import zlib

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row long, node long, size long, word string, bucket int, given string, kept boolean, n_words long, shard int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def words(text, lower=False):
    """The words of a text, one character at a time."""
    out, word = [], ""
    for c in (text or "").translate(LOW) if lower else (text or ""):
        if c in SPACES:
            out, word = (out + [word] if word else out), ""
        else:
            word += c
    return out + [word] if word else out


def remainder(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def make(spark, rows):
    extra = (1, 2, 3, 4, "w", 5, "g", True, 7, 8)
    return spark.createDataFrame([(i, t, lang, source, None, *extra) for i, t, lang, source in rows], SCHEMA)


def prose(chance, n, vocabulary=400):
    return " ".join(chance.choice("abcdefgh") * 2 + str(int(chance.paretovariate(0.7)) % vocabulary) + chance.choice(["", "", ".", ","]) for _ in range(n))
