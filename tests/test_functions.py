import random
import time

import pytest
from pyspark.sql import functions as F

from mnemolith.functions.chunking import chunks, chunks_or_whole
from mnemolith.functions.text import content_hash, filled, preview, strip, summary
from mnemolith.functions.timestamps import format_timestamp, normalize_timestamp
from mnemolith.functions.vectors import term_counts
from mnemolith.settings import as_flag, clamp_limit


def one(spark, text, expression):
    rows = spark.createDataFrame([(text,)], "x string")
    return rows.select(expression(F.col("x")).alias("v")).first()["v"]


CHUNKS = [
    ("甲" * 600 + "。", [(601, 0, 601), (601, 0, 601)]),
    ("甲" * 20 + "。" + "乙" * 600 + "。", [(622, 0, 622), (601, 21, 622)]),
    ("甲" * 10 + "。", []),
    ("甲" * 300 + "。" + "乙" * 190 + "。" + "丙" * 100 + "。", [(492, 0, 492), (292, 301, 593)]),
    ("甲" * 499 + "。" + "乙" * 40, [(500, 0, 500), (540, 0, 540)]),
    ("甲" * 5 + "。" + "乙" * 6 + "。" + "丙" * 600, [(607, 6, 613)]),
    ("　" + "甲" * 31 + "　\n", [(31, 0, 31)]),
    ("甲" * 40 + ". " + "乙" * 40, [(82, 0, 82)]),
    ("好的。", []),
]


@pytest.mark.parametrize("text,expected", CHUNKS)
def test_chunks(spark, text, expected):
    found = one(spark, text, chunks)
    assert [(len(c.content), c.start_char, c.end_char) for c in found] == expected
    assert all(text.strip()[c.start_char : c.end_char].strip() == c.content for c in found)


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_chunks_of_many_sentences(spark, overlap):
    """A text whose fold goes over blocks, against the rule written out."""
    sizes = [(7 * k * k + 13) % 260 + 1 for k in range(700)]
    parts = [chr(0x4E00 + k) * n + "。" for k, n in enumerate(sizes)]
    expected, held, end = [], [], 0
    for part in [*parts, ""]:
        if sum(map(len, held)) + len(part) > 500:
            expected.append(("".join(held), end - sum(map(len, held)), end))
            held = held[-overlap:]
        held, end = [*held, part], end + len(part)
    expected.append(("".join(held), end - sum(map(len, held)), end))
    found = one(spark, "".join(parts), lambda x: chunks(x, overlap=overlap))
    assert [tuple(c) for c in found] == [c for c in expected if len(c[0]) >= 30]


def test_long_texts_take_time_in_proportion(spark):
    def seconds(n):
        began = time.perf_counter()
        text = F.repeat(F.concat(F.lit("x" * 400 + "。"), F.substring(F.col("id").cast("string"), 9, 1)), n)
        assert spark.range(1).select(F.size(chunks(text))).first()[0] == n + 1
        return time.perf_counter() - began

    seconds(100)
    # Eight times the text; a fold that copies its cuts takes sixty times as long.
    assert seconds(80_000) < 16 * seconds(10_000) + 2


def test_overlap_of_zero_keeps_everything(spark):
    found = one(spark, ("甲" * 300 + "。") * 4, lambda x: chunks(x, overlap=0))
    assert [(len(c.content), c.start_char, c.end_char) for c in found] == [(301, 0, 301), (602, 0, 602), (903, 0, 903), (1204, 0, 1204), (1204, 0, 1204)]


def test_chunk_spans_of_random_texts(spark):
    chance = random.Random(3)
    texts = ["".join(chance.choice("甲乙a b。！？\n.") for _ in range(chance.randrange(0, 2500))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", chunks(F.col("x")).alias("v")).collect()
    for row in rows:
        whole = texts[row.i].strip()
        for c in row.v:
            assert whole[c.start_char : c.end_char].strip() == c.content and len(c.content) >= 30


def test_short_text_is_one_unit(spark):
    found = one(spark, "  短文本  ", chunks_or_whole)
    assert [(c.content, c.start_char, c.end_char) for c in found] == [("短文本", 2, 5)]
    assert one(spark, "  短文本  ", lambda x: chunks_or_whole(x, within_text=False))[0].start_char == 0
    assert one(spark, " \n ", chunks_or_whole) == []


PREVIEWS = [
    ("x" * 100 + " needle " + "y" * 100, "needle", "..." + "x" * 56 + " needle " + "y" * 56 + "..."),
    ("short  text", "zz", "short text"),
    ("a" * 130, "q", "a" * 120 + "..."),
    ("", "q", ""),
    ("　甲　乙", "乙", "甲 乙"),
    ("Some Words here", "WORDS some", "Some Words here"),
]


@pytest.mark.parametrize("text,query,expected", PREVIEWS)
def test_preview(spark, text, query, expected):
    assert one(spark, text, lambda x: preview(x, query)) == expected


def test_summary_and_strip(spark):
    assert one(spark, "a  b\n　c", summary) == "a b c"
    assert one(spark, "x" * 119 + " yy", summary) == "x" * 119 + "..."
    assert one(spark, None, summary) == ""
    assert one(spark, "\x1c  a b ", strip) == "a b"


NORMALIZED = [
    ("2026-03-18T08:30:00+08:00", "2026-03-18 08:30:00"),
    ("2026-3-8 1:2:3", "2026-03-08 01:02:03"),
    ("2026-03-18", "2026-03-18"),
    ("2026-02-30 00:00:00", "2026-02-30 00:00:00"),
    (None, ""),
    ("", ""),
    ("garbage that is quite long", "garbage that is qui"),
]


@pytest.mark.parametrize("text,expected", NORMALIZED)
def test_normalize_timestamp(spark, text, expected):
    assert one(spark, text, normalize_timestamp) == expected


FORMATTED = [
    ("1700000000", "2023-11-14 22:13:20"),
    ("1700000000123", "2023-11-14 22:13:20"),
    ('{"$date":{"$numberLong":"1700000000123"}}', "2023-11-14 22:13:20"),
    ('"2026-03-18T08:31:00.5Z"', "2026-03-18 08:31:00"),
    ('"2026-03-18T08:31:00+08:00"', "2026-03-18 08:31:00+08:00"),
    ("0", ""),
    ('""', ""),
    ("null", ""),
    ('"1.2.3"', "1.2.3"),
]


@pytest.mark.parametrize("json,expected", FORMATTED)
def test_format_timestamp(spark, json, expected):
    assert one(spark, json, lambda x: format_timestamp(F.parse_json(x))) == expected


def test_small_functions(spark):
    assert one(spark, "", lambda x: filled(x, F.lit("y"))) == "y"
    assert one(spark, "a", content_hash) == "0cc175b9c0f1b6a831c399e269772661"
    assert one(spark, "Abc abc", lambda x: term_counts(x, ["abc", "z"])) == [2.0, 0.0, 7.0]
    assert [clamp_limit(v) for v in ("x", "0", "99", 7)] == [10, 1, 50, 7]
    assert as_flag("Yes") and not as_flag("0") and as_flag(None, True)
