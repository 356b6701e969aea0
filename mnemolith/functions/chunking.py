"""Sentence-bounded chunks with exact character spans, as one array expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, strip

CHUNK = "struct<content:string,start_char:int,end_char:int>"
CUT = "struct<first:int,count:int,start:int,end:int>"
LEAST_TEXT = 5
BLOCK = 256


def chunks(text: Column, least: int = 30, most: int = 500, overlap: int = 1) -> Column:
    """Array of ``content, start_char, end_char`` for the stripped text.

    Sentences end at ``。``, ``！``, ``？`` or a line break. They gather while they fit in
    ``most`` characters; then the chunk is emitted if its stripped text has
    ``least``, and its last ``overlap`` sentences start the next one (all of them
    for 0, as a slice from ``-0`` has it). Spans count code points of the stripped
    text. Null gives null, short text no chunk.

    The fold goes over the sentences' lengths and keeps numbers only; each chunk's
    text is put together once, afterwards. A fold copies its state at every step, so
    that of a long text goes over blocks of sentences and keeps the place that
    each begins at; the cuts are then found block by block.
    """

    def cut(state: Column) -> Column:
        return F.struct((state["k"] - state["count"]).alias("first"), state["count"], (state["end"] - state["size"]).alias("start"), state["end"]).cast(CUT)

    def state_of(k: Column, count: Column, size: Column, end: Column, recent: Column, cuts: Column | None) -> Column:
        place = [k.alias("k"), count.alias("count"), size.alias("size"), end.alias("end"), recent.alias("recent")]
        return F.struct(*place) if cuts is None else F.struct(*place, cuts.alias("cuts"))

    def stepping(keeping: bool):
        def step(state: Column, n: Column) -> Column:
            fits = state["size"] + n <= most
            if overlap == 1:
                kept, kept_size, recent = F.size(state["recent"]), F.coalesce(F.get(state["recent"], F.lit(0)), F.lit(0)), F.array(n)
            elif overlap:
                kept, kept_size = F.size(state["recent"]), F.aggregate(state["recent"], F.lit(0), lambda total, x: total + x)
                recent = bind(F.array_append(state["recent"], n), lambda r: F.slice(r, F.greatest(F.size(r) - overlap, F.lit(0)) + 1, F.lit(overlap)))
            else:
                kept, kept_size, recent = state["count"], state["size"], state["recent"]
            grown = state_of(state["k"] + 1, state["count"] + 1, state["size"] + n, state["end"] + n, recent, state["cuts"] if keeping else None)
            begun = state_of(state["k"] + 1, kept + 1, kept_size + n, state["end"] + n, recent, F.array_append(state["cuts"], cut(state)) if keeping else None)
            return F.when(fits, grown).otherwise(begun)

        return step

    none, no_cuts = F.array().cast("array<int>"), F.array().cast(f"array<{CUT}>")
    start = (F.lit(0), F.lit(0), F.lit(0), F.lit(0), none)

    def cuts_of(lengths: Column) -> Column:
        def block(b: Column) -> Column:
            return F.transform(F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.size(lengths)) - 1), lambda i: F.get(lengths, i))

        def passed(state: Column, b: Column) -> Column:
            return F.struct(F.aggregate(block(b), state["at"], stepping(False)).alias("at"), F.array_append(state["starts"], state["at"]).alias("starts"))

        def of_block(at: Column, b: Column) -> Column:
            begun = state_of(*[at[c] for c in ("k", "count", "size", "end", "recent")], no_cuts)
            return F.aggregate(block(b), begun, stepping(True), lambda state: F.when(state["k"] == F.size(lengths), F.array_append(state["cuts"], cut(state))).otherwise(state["cuts"]))

        place = "struct<k:int,count:int,size:int,end:int,recent:array<int>>"
        first = state_of(*start, None).cast(place)
        blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
        walked = F.aggregate(blocks, F.struct(first.alias("at"), F.array().cast(f"array<{place}>").alias("starts")), passed, lambda state: state["starts"])
        return F.flatten(F.transform(F.when(F.size(lengths) <= BLOCK, F.array(first)).otherwise(walked), of_block))

    def text_of(sentences: Column, c: Column) -> Column:
        # A slice copies all sentences, so that of many they are taken by their places.
        places = F.sequence(c["first"], c["first"] + c["count"] - 1)
        few = F.slice(sentences, c["first"] + 1, c["count"])
        own = F.when((F.size(sentences) <= BLOCK) | (c["count"] == 0), few).otherwise(F.transform(places, lambda i: F.get(sentences, i)))
        return F.array_join(own, "")

    def of_sentences(sentences: Column) -> Column:
        cuts = bind(F.transform(sentences, lambda x: F.length(x)), cuts_of)
        found = F.transform(cuts, lambda c: F.struct(strip(text_of(sentences, c)).alias("content"), c["start"].alias("start_char"), c["end"].alias("end_char")).cast(CHUNK))
        return F.filter(found, lambda c: F.length(c["content"]) >= least)

    def folded(stripped: Column) -> Column:
        return F.when(F.length(stripped) < LEAST_TEXT, F.array().cast(f"array<{CHUNK}>")).otherwise(bind(F.split(stripped, "(?<=[。！？\n])", -1), of_sentences))

    return bind(strip(text), folded)


def chunks_or_whole(text: Column, within_text: bool = True) -> Column:
    """Chunks, or the whole stripped text as one if it is not blank but has none.

    The whole text's span lies within the unstripped text, or starts at 0.
    """

    def whole(stripped: Column) -> Column:
        start = F.greatest(F.instr(text, stripped) - 1, F.lit(0)) if within_text else F.lit(0)
        one = F.struct(stripped.alias("content"), start.alias("start_char"), (start + F.length(stripped)).alias("end_char")).cast(CHUNK)
        return F.when(stripped == "", F.array().cast(f"array<{CHUNK}>")).otherwise(F.array(one))

    return bind(chunks(text), lambda found: F.when(F.size(found) > 0, found).otherwise(bind(strip(text), whole)))
