"""Conversation structure repair: faults counted, and the cheapest edits that mend the order of roles.

A repaired conversation is empty, or an optional system row and then pairs of a
user's and an assistant's row. Keeping a row costs 0, giving it the role user or
assistant 1, deleting it 2, inserting an empty one 5, and 5 more a truncated row
that stays; blank rows and duplicates must be deleted. Of equally cheap edits
those whose initials (K, R, D, I) come first in ASCII order are taken. The
automaton is in :mod:`mnemolith.llm.repair_automaton`.

Rows are folded with their copies, told apart from earlier equal ones by a join on
the least turn of each (conversation, role, text), and sorted by range, so that a
conversation of any size is spread over as many tasks as it needs. A conversation
that lies inside one partition is repaired there. Of one that goes on in the next,
pieces of bounded size are written; one byte a row of them meets in one task (the
audit, one value, is as long), and their rendered texts stream through a hash,
which has no parallel form, without being gathered.

Defined cases: a row's first fault counts, blank before duplicate before
truncated. Null role or text count as one space, a null ``conv_id`` is a
conversation of its own, null turns come first and count in no gap. Rows of one
turn go by role and text (by the first 64 characters of both across partitions);
rows that are equal in everything are duplicates of the first. Texts of any length
are whole; a conversation without rows has zeros, an empty audit and the hash of the
empty text; other columns, whatever their names, are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repair_automaton import GONE, NOTHING, SYSTEM, RepairAutomaton, _next, rendered, symbol
from .storage import written

SPACES = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 22
MOST = (1 << 63) - 1
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
FINAL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = "first_turn long, last_turn long, turns long, first_initial string, last_initial string, part int, seg int, symbols binary, runs array<long>, roles array<string>, texts array<string>"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as a careless export leaves them, by crc32 of ``conv_id:turn`` modulo 20: lost, emptied, without their ends, twice, or with the role user.

    ``conv_id, turn, role, text, copies``; a lost row has no copies, nor turn, role or text.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)

    def unless_lost(value: Column, instead: Column) -> Column:
        return F.when(kind == 0, instead).otherwise(value)

    return rows.select(
        "conv_id",
        unless_lost(F.col("turn").cast("long"), F.lit(None)).alias("turn"),
        unless_lost(F.when(kind == 4, "user").otherwise(role), F.lit("")).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """Rows as they are, in the form that :func:`repaired` takes."""
    space = F.lit(" ")
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"), F.lit(1).cast("long").alias("copies"),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """Distinct rows with their ``copies`` and whether they are the ``first`` of their role and text, in order by range."""
    content = [F.xxhash64("role", "text").alias("h"), F.xxhash64("text", "role", F.lit(1)).alias("g")]
    folded = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    least = rows.filter("copies > 0").select("conv_id", *content, when.alias("when")).groupBy("conv_id", "h", "g").agg(F.min("when").alias("when"))
    firsts = least.select(F.col("conv_id").alias("c"), F.col("h").alias("fh"), F.col("g").alias("fg"), F.col("when.turn").alias("t"), F.lit(True).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")) & F.col("turn").eqNullSafe(F.col("t"))
    marked = folded.select("*", *content).join(firsts, same, "left").select("conv_id", "turn", "role", "text", "copies", F.coalesce("first", F.lit(False)).alias("first"))
    dealt = marked.repartitionByRange("conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64))
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text")


class _Piece:
    """Rows of one conversation that stand together, as runs for the automaton."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.runs, self.roles, self.texts, self.chars = conv_id, bytearray(), [], [], [], 0
        self.count = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.turns = 0

    def _run(self, sym: int, times: int, role: str, text: str) -> None:
        self.symbols.append(sym)
        self.runs.append(times)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        if not copies:
            return
        if turn is not None:
            self.turns += self.first_turn is None or turn != self.last_turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        initial = role[:1]
        self.count["illegal"] += copies - 1 + (self.last_initial is not None and self.last_initial + initial not in LEGAL)
        self.first_initial, self.last_initial = initial if self.first_initial is None else self.first_initial, initial
        end = text.rstrip(SPACES)[-1:]
        if not end:
            self.count["blank"] += copies
            self._run(GONE, copies, "", "")
            return
        if first:
            cut = end not in ".!?"
            self.count["truncated"] += cut
            self._run(symbol(initial, cut), 1, role, text)
            copies -= 1
        self.count["duplicate"] += copies
        if copies:
            self._run(GONE, copies, "", "")

    def full(self) -> bool:
        return len(self.runs) >= PIECE_ROWS or self.chars >= PIECE_CHARS


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else min(last - first + 1 - turns, MOST)


def _audit(letters: list[str], runs: list[int], tail: str) -> str:
    return "".join(some + some[-1] * (run - 1) for some, run in zip(letters, runs, strict=True)) + tail


def _whole(piece: _Piece, automaton: RepairAutomaton) -> dict:
    cost, letters, tail = automaton.repair(piece.symbols, piece.runs)
    lines, _ = rendered(list(zip(piece.roles, piece.texts, strict=True)), letters, tail)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return {"conv_id": piece.conv_id, "gaps": _gaps(piece.first_turn, piece.last_turn, piece.turns), **piece.count, "cost": cost, "audit": _audit(letters, piece.runs, tail), "repaired_sha256": digest}


def _pieces(schema: pa.Schema):
    """Repaired conversations that lie inside a partition, and pieces of those that may go on beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, part = RepairAutomaton(), TaskContext.get().partitionId()
        piece, seg, alone, out, chars = None, 0, False, [], 0

        def fragment() -> dict:
            own = {name: getattr(piece, name) for name in ("conv_id", "first_turn", "last_turn", "turns", "first_initial", "last_initial", "runs", "roles", "texts")}
            return own | piece.count | {"part": part, "seg": seg, "symbols": bytes(piece.symbols)}

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text", "copies", "first")]
            for conv_id, *row in zip(*columns, strict=True):
                if piece is None or conv_id != piece.conv_id or piece.full():
                    if piece is not None:
                        goes_on = conv_id == piece.conv_id
                        out.append(_whole(piece, automaton) if alone and not goes_on else fragment())
                        chars += piece.chars
                        # The first conversation of a partition may have begun in the one before.
                        alone, seg = not goes_on, seg + 1
                    piece = _Piece(conv_id)
                piece.add(*row)
                if len(out) >= 2048 or chars >= PIECE_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, chars = [], 0
        if piece is not None:
            out.append(fragment())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows by conversation, streamed: each is read before the next is asked for."""
    from itertools import groupby

    def rows() -> Iterator[dict]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                yield from batch.slice(i, 64).to_pylist()

    return groupby(rows(), key=lambda r: r["conv_id"])


def _edited(schema: pa.Schema):
    """For each piece of a conversation its rows' letters and the state that it begins in; totals with the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = RepairAutomaton()
        for conv_id, rows in _groups(batches):
            symbols, runs, sizes, total = bytearray(), [], [], dict.fromkeys(COUNTS, 0)
            first = last = initial = None
            turns = 0
            for r in rows:
                symbols += r["symbols"]
                runs += r["runs"]
                sizes.append((r["part"], r["seg"], len(r["runs"])))
                for name in COUNTS:
                    total[name] += r[name]
                if r["first_initial"] is not None:
                    total["illegal"] += initial is not None and initial + r["first_initial"] not in LEGAL
                    initial = r["last_initial"]
                if r["turns"]:
                    turns += r["turns"] - (last == r["first_turn"])
                    first, last = r["first_turn"] if first is None else first, r["last_turn"]
            cost, letters, tail = automaton.repair(symbols, runs)
            state, at = NOTHING, 0
            for i, (part, seg, size) in enumerate(sizes):
                end = at + size
                row = {"conv_id": conv_id, "part": part, "seg": seg, "letters": letters[at:end], "state": state, "tail": ""}
                if i + 1 == len(sizes):
                    row |= {"tail": tail, "gaps": _gaps(first, last, turns), "cost": cost, **total}
                yield pa.RecordBatch.from_pylist([row], schema)
                for some, sym in zip(letters[at:end], symbols[at:end], strict=True):
                    for letter in some:
                        if letter != "D":
                            state = SYSTEM if letter == "K" and (sym - 1) // 2 == 0 else _next(state)
                at = end

    return run


def _lines(schema: pa.Schema):
    """Each piece's part of the audit and of the repaired text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                lines, _ = rendered(list(zip(r["roles"], r["texts"], strict=True)), r["letters"], r["tail"], r["state"])
                own = {name: r[name] for name in schema.names if name in r}
                yield pa.RecordBatch.from_pylist([own | {"audit": _audit(r["letters"], r["runs"], r["tail"]), "lines": "\n".join(lines) if lines else None}], schema)

    return run


def _hashed(schema: pa.Schema):
    """One row a conversation, its text hashed as its pieces come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            digest, audit, begun = hashlib.sha256(), [], False
            for r in rows:
                audit.append(r["audit"])
                if r["lines"] is not None:
                    digest.update((("\n" if begun else "") + r["lines"]).encode())
                    begun = True
                last = r
            row = {name: last[name] for name in schema.names if name in last}
            yield pa.RecordBatch.from_pylist([row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

    return run


def _arrow(spark_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)


def repaired(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows(conv_id, turn, role, text, copies)``: gaps, faults, cost, audit and the hash of what the edits leave.

    The rows must be of the form that :func:`damaged` and :func:`undamaged` give.
    """
    spark, kind = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()

    def schema(columns: str):
        return spark.createDataFrame([], f"conv_id {kind}, {columns}").schema

    def mapped(df: DataFrame, function, columns: str) -> DataFrame:
        out = schema(columns)
        return df.mapInArrow(function(_arrow(out)), out)

    found = written(mapped(_in_order(rows), _pieces, f"{FINAL}, {PIECE}"), "conversations")
    names = ["conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
    done = found.filter("part IS NULL").select(names)
    pieces = found.filter("part IS NOT NULL")

    def by_conversation(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")

    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    bare = by_conversation(pieces.select("conv_id", "part", "seg", "symbols", "runs", "first_turn", "last_turn", "turns", "first_initial", "last_initial", *COUNTS))
    edits = mapped(bare, _edited, f"part int, seg int, letters array<string>, state int, tail string, {counts}").drop("conv_id")
    texts = pieces.select("conv_id", "part", "seg", "runs", "roles", "texts").join(edits, ["part", "seg"])
    lines = mapped(texts, _lines, f"part int, seg int, audit string, lines string, {counts}")
    return done.unionByName(mapped(by_conversation(lines), _hashed, FINAL).select(names))
