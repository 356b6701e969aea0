"""Tables as versioned snapshots: upserts, replaced children, edits, rollback.

Parquet has no MERGE, so each table is dealt into buckets by a hash of the
identifier that its rows change by, and a change of any number of tables
rewrites the buckets that it touches, in a new folder. One small file for each
version then names the folder of every bucket of every table; it appears by an
atomic rename that fails if another writer took its number. Nothing is
overwritten or deleted: a failure at any point leaves the version before in
place, readers of it go on, and rolling back is a new version that names the
folders of an old one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import filled
from ..schemas import BUCKET_KEYS, LOOKUPS, TABLES
from .embedding import Embedder, reused_vectors, text_hash, vector_rows, vectors
from .legacy import bootstrap_documents, bootstrap_units, rechunked
from .memory import document_facts, memory_units
from .recall import nearest, of_version
from .vector_index import VectorIndex

#: Kinds of documents that a message may have.
MESSAGE_TYPES = ("legacy_message", "conversation_message")


class SourceClash(ValueError):
    """Two documents would share a source and external identifier."""


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the greatest ``order``, which is dropped."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n", order)


def _added(kept: DataFrame, new: DataFrame) -> DataFrame:
    """``kept`` and the rows of ``new``, of which columns that ``kept`` lacks are dropped and missing ones are null."""
    return kept.unionByName(new.select(*[c for c in kept.columns if c in new.columns]), allowMissingColumns=True)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return _added(old.join(new.select(*keys), list(keys), "left_anti"), new)


def children_replaced(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``old`` without the children of ``parents``, and the children in ``new``."""
    return _added(old.join(parents.select(key), key, "left_anti"), new)


def kept_apart(old: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows of ``parents``, which are distinct; if all go, as in a repeated import, or none does, only keys move."""
    gone = old.select(key).join(parents.select(key, F.lit(1).alias("_gone")), key, "left")
    counts = gone.agg(F.count("*").alias("rows"), F.count("_gone").alias("gone")).first()
    if counts["gone"] == counts["rows"]:
        return old.limit(0)
    return old.join(parents.select(key), key, "left_anti") if counts["gone"] else old


def source_clashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents of ``old`` whose source and external identifier a new one takes under another id."""
    fresh = new.select("source", "external_id", F.col("raw_document_id").alias("new_id"))
    return old.join(fresh, ["source", "external_id"]).filter("raw_document_id <> new_id").select("raw_document_id", "new_id")


def observed(seen: Observation, name: str, rows: DataFrame) -> int:
    """What the write of ``rows`` observed; of no rows Spark drops the observation from the plan."""
    try:
        return seen.get[name] or 0
    except Py4JJavaError:
        if rows.isEmpty():
            return 0
        raise


class VersionTaken(RuntimeError):
    """Another writer made the next version first; its changes must be read before trying again."""


#: What a table's buckets become: the identifiers that change, and the new rows of their buckets from the old ones.
Change = tuple[DataFrame, Callable[[DataFrame], DataFrame]]


class MemoryStore:
    """The archive below one folder that all executors reach.

    ``buckets`` is fixed by a store's first version; an edit rewrites one bucket of
    each table, so a large archive takes thousands.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, files = self._path(folder)
        return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

    def _version(self, number: int) -> dict:
        path, files = self._path(f"versions/{number}.json")
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def state(self) -> dict:
        """The latest version: its number, the one before, and the folder of each bucket; version 0 has none.

        ``chunk_ids`` is the greatest number given to a chunk, ``batches`` the last batch of
        each stream, ``index`` the vector index and what it was made from.
        """
        numbers = [int(n[:-5]) for n in self._names("versions") if re.fullmatch(r"\d+\.json", n)]
        first = {"version": 0, "parent": 0, "buckets": self._buckets, "tables": {}, "chunk_ids": 0, "batches": {}, "index": None}
        return self._version(max(numbers)) if numbers else first

    def _go_on(self, state: dict, tables: dict, **facts) -> int:
        """Make the version after ``state``, with these tables and other facts."""
        self._point({**state, "version": state["version"] + 1, "parent": state["version"], "tables": tables, **facts})
        return state["version"] + 1

    def _point(self, state: dict) -> None:
        """Make ``state`` the latest version, or raise if its number is taken."""
        jvm = self.spark.sparkContext._jvm
        new, files = self._path(f"versions/.{uuid.uuid4().hex}")
        stream = files.create(new, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        path, _ = self._path(f"versions/{state['version']}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(new, path, no_options)
        except Exception as error:
            files.delete(new, False)
            if files.exists(path):
                raise VersionTaken(f"version {state['version']} exists") from error
            raise

    def _read(self, name: str, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{f}" for f in folders])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is, or as it was in an older version."""
        state = self.state() if version is None else self._version(version)
        return self._read(name, list(state["tables"].get(name, {}).values()))

    def _bucket(self, name: str, state: dict, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or BUCKET_KEYS[name]).cast("string")), F.lit(state["buckets"]))

    def _touched(self, name: str, keys: DataFrame, state: dict) -> list[str]:
        """The buckets that the identifiers in the only column of ``keys`` belong to; at most as many as there are."""
        own = keys.select(self._bucket(name, state, keys.columns[0]).cast("int").alias("bucket")).distinct()
        return sorted(str(r["bucket"]) for r in own.collect())

    def _near(self, name: str, keys: DataFrame, state: dict | None = None) -> DataFrame:
        """The buckets of a table that the identifiers in ``keys`` belong to."""
        state = state or self.state()
        folders = state["tables"].get(name, {})
        return self._read(name, [folders[n] for n in self._touched(name, keys, state) if n in folders])

    def rows_of(self, name: str, keys: Sequence[str], version: int | None = None) -> DataFrame:
        """Rows by the identifiers that their table is dealt by; only these identifiers' buckets are read."""
        if not keys:
            return self._read(name, [])
        state = self.state() if version is None else self._version(version)
        asked = self.spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
        return self._near(name, asked, state).filter(F.col(BUCKET_KEYS[name]).isin(*keys))

    def rows_of_units(self, name: str, ids: Sequence[str]) -> DataFrame:
        """Units or vectors by their own names.

        A unit's name begins with its document's, which tells the bucket; units of the older
        layout are named by numbers and are looked for in all buckets, by Bloom filters.
        """
        column = LOOKUPS[name][0]
        if not ids:
            return self._read(name, [])
        if not all(":" in i for i in ids):
            return self.table(name).filter(F.col(column).isin(*ids))
        return self.rows_of(name, sorted({i.rpartition(":")[0] for i in ids})).filter(F.col(column).isin(*ids))

    @contextmanager
    def _staging(self) -> Iterator[Callable[[DataFrame, str], tuple[DataFrame, int]]]:
        """Write rows once below the store, for changes that read them several times; they go in the end, whatever happens."""
        paths: list[str] = []

        def staged(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
            """The rows read back, and how many the write counted."""
            paths.append(f"staging/{name}-{uuid.uuid4().hex}")
            seen = Observation()
            rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(f"{self.root}/{paths[-1]}")
            back = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{paths[-1]}")
            return back, observed(seen, "rows", back)

        try:
            yield staged
        finally:
            for name in paths:
                path, files = self._path(name)
                files.delete(path, True)

    def apply(self, changes: dict[str, Change], **facts) -> int:
        """Rewrite the buckets of the identifiers that change, then switch to the new version.

        A change is a DataFrame with the identifiers, under the name of the table's
        bucket key, and a function from the old rows of their buckets to the new ones.
        """
        state = self.state()
        tables = dict(state["tables"])
        folder = f"data/{state['version'] + 1}-{uuid.uuid4().hex}"
        last = 0
        for name, (touched, change) in changes.items():
            numbers = self._touched(name, touched.select(BUCKET_KEYS[name].split(".")[-1]), state)
            old = tables.get(name, {})
            new, seen = self._write(name, change(self._read(name, [old[n] for n in numbers if n in old])), f"{folder}/{name}", state)
            tables[name] = {n: f for n, f in old.items() if n not in numbers} | new
            last = max(last, seen)
        return self._go_on(state, tables, chunk_ids=max(self._chunk_ids(state), last), **facts)

    def _write(self, name: str, rows: DataFrame, folder: str, state: dict) -> tuple[dict[str, str], int]:
        """The new folder of each bucket that has rows, and the greatest number of a chunk among them."""
        declared = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]]
        dealt = rows.select(*declared).withColumn("_bucket", self._bucket(name, state))
        seen = Observation()
        if name == "chunks":
            dealt = dealt.observe(seen, F.max("chunk_id").alias("last"))
        lookups = LOOKUPS.get(name, [])
        writer = dealt.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *lookups).write.option("compression", "zstd").partitionBy("_bucket")
        for column in lookups:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.root}/{folder}")
        found = [n.partition("=")[2] for n in self._names(folder) if n.startswith("_bucket=")]
        folders = {n: f"{folder}/_bucket={n}" for n in found}
        return folders, observed(seen, "last", self._read(name, list(folders.values()))) if name == "chunks" else 0

    def _chunk_ids(self, state: dict) -> int:
        """The greatest number given to a chunk; stores made before numbers were kept are asked once."""
        if "chunk_ids" in state:
            return state["chunk_ids"]
        return self._read("chunks", list(state["tables"].get("chunks", {}).values())).agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0]

    def commit(self, changes: dict[str, DataFrame]) -> int:
        """Write the whole new state of some tables, then switch to it."""
        state = self.state()
        folder = f"data/{state['version'] + 1}-{uuid.uuid4().hex}"
        if "raw_documents" in changes:
            changes = {"external_ids": changes["raw_documents"]} | changes
        tables, last = dict(state["tables"]), 0
        for name, rows in changes.items():
            tables[name], seen = self._write(name, rows, f"{folder}/{name}", state)
            last = max(last, seen)
        return self._go_on(state, tables, chunk_ids=max(self._chunk_ids(state), last))

    def rollback(self) -> int:
        """Undo the latest version: a new one with the tables, identifiers and timestamps of that before.

        Numbers given to chunks and batches of streams stay used.
        """
        now = self.state()
        if not now["version"]:
            return 0
        before = self._version(now["parent"]) if now["parent"] else {"parent": 0, "tables": {}, "index": None}
        self._point({**now, "version": now["version"] + 1, "parent": before["parent"], "tables": before["tables"], "index": before.get("index")})
        return now["version"] + 1

    def count_rows(self, name: str) -> int:
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        return self.table(name).count()

    def _archived(self, documents: DataFrame, units: DataFrame, found: DataFrame, gone: DataFrame | None = None, many: bool = False) -> dict[str, Change]:
        """Changes that put documents, their units and vectors in place of those with equal identifiers, and drop ``gone``.

        Of ``many`` documents the keys are looked at before any rows move.
        """
        parents = documents.select("raw_document_id")
        parents = (parents if gone is None else parents.unionByName(gone)).distinct()
        # Vectors are written in the same version, so units count as embedded.
        embedded = units.withColumn("is_embedded", F.lit(1))

        def vectors_replaced(old: DataFrame) -> DataFrame:
            of_document = old.withColumn("raw_document_id", F.col("metadata.raw_document_id"))
            return others(of_document).drop("raw_document_id").unionByName(found)

        def others(old: DataFrame) -> DataFrame:
            return kept_apart(old, parents, "raw_document_id") if many else old.join(parents, "raw_document_id", "left_anti")

        return {
            "raw_documents": (parents, lambda old: _added(others(old), documents)),
            "memory_units": (parents, lambda old: _added(others(old), embedded)),
            "vectors": (parents, vectors_replaced),
            # A document that is superseded has the external identifier of the one that comes.
            "external_ids": (documents, lambda old: _added(others(old), documents)),
        }

    def _external(self, keys: DataFrame) -> DataFrame:
        """External identifiers' documents, from the small table where the store has it."""
        return self._near("external_ids", keys) if "external_ids" in self.state()["tables"] else self.table("raw_documents")

    def ingest(
        self, documents: DataFrame, embedder: Embedder, supersede: bool = False, records: DataFrame | None = None, batch: tuple[str, int] | None = None
    ) -> dict[str, int]:
        """Upsert documents, replace their units and vectors, and return the counters.

        ``documents`` may hold a document twice; the later row by ``_order`` (readers
        give file and place) wins, and counters count both, as messages read.
        ``records`` are the conversations' own JSON, stored in the same version. A
        ``batch``, the name of a stream and a number, is skipped if the store has it. If
        the embedder's vectors are reused, ``embedded`` counts the texts that it was given.
        """
        name, number = batch or ("", 0)
        batches = self.state().get("batches", {})
        if batch and batches.get(name, -1) >= number:
            return {"raw_documents": 0, "memory_units": 0}
        ordered = documents if "_order" in documents.columns else documents.withColumn("_order", F.monotonically_increasing_id())
        with self._staging() as staged:
            given, read = staged(ordered, "documents")
            fresh = given.drop("_order")
            if not given.groupBy("raw_document_id").count().filter("count > 1").isEmpty():
                fresh, _ = staged(last_wins(given, ["raw_document_id"], "_order"), "fresh")
            clashes = source_clashes(self._external(fresh.select("external_id")), fresh)
            gone = None
            if supersede:
                gone = clashes.select("raw_document_id").distinct()
            else:
                first = clashes.first()
                if first is not None:
                    raise SourceClash(f"{first['raw_document_id']} and {first['new_id']} share their source and external identifier")
            units, made = staged(memory_units(fresh, embedder.version, with_document=True), "units")
            counters, reused = {"raw_documents": read, "memory_units": made}, {}
            if embedder.reuse:
                hashed = units.withColumn("text_hash", text_hash(F.col("content")))
                unseen, known = reused_vectors(units, self._near("embeddings", hashed.select("text_hash")), embedder)
                new, counters["embedded"] = staged(unseen, "embeddings")
                found = vector_rows(hashed.join(known.unionByName(new).drop("embedding_version"), "text_hash"), embedder.version)
                reused = {"embeddings": (new, lambda old: upserted(old, new, ["text_hash", "embedding_version"]))}
            else:
                found = vectors(units, embedder)
            changes = self._archived(fresh, units, found, gone, many=True) | reused
            if records is not None:
                latest, _ = staged(last_wins(records, ["conversation_id"], "_order"), "records")
                changes["conversation_records"] = (latest, lambda old: upserted(old, latest, ["conversation_id"]))
            self.apply(changes, **({"batches": batches | {name: number}} if batch else {}))
        return counters

    def changed(self, documents: DataFrame) -> DataFrame:
        """Documents that are new or whose content differs from what is stored."""
        stored = self._near("raw_documents", documents.select("raw_document_id"))
        return documents.join(stored.select("raw_document_id", "content_hash"), ["raw_document_id", "content_hash"], "left_anti")

    def bootstrap(self) -> dict[str, int | bool]:
        """Project the older layout, if both new tables are empty and it is not."""
        documents, units = self.count_rows("raw_documents"), self.count_rows("memory_units")
        if documents or units:
            return {"migrated": False, "raw_documents": documents, "memory_units": units}
        messages, conversations, chunks = (self.table(t) for t in ("messages", "conversations", "chunks"))
        if messages.isEmpty() or chunks.isEmpty():
            return {"migrated": False, "raw_documents": 0, "memory_units": 0}
        self.commit({"raw_documents": bootstrap_documents(messages, conversations), "memory_units": bootstrap_units(messages, conversations, chunks)})
        return {"migrated": True, "raw_documents": self.count_rows("raw_documents"), "memory_units": self.count_rows("memory_units")}

    def save_conversations(self, conversations: DataFrame, messages: DataFrame) -> int:
        """Insert or replace conversations and messages; a replaced message loses its chunks."""
        return self.apply(
            {
                "conversations": (conversations, lambda old: upserted(old, conversations, ["conversation_id"])),
                "messages": (messages, lambda old: upserted(old, messages, ["message_id"])),
                "chunks": (messages, lambda old: old.join(messages.select("message_id"), "message_id", "left_anti")),
            }
        )

    def save_chunks(self, chunks: DataFrame) -> int:
        """Append chunks; those without a ``chunk_id`` get new numbers, by bucket, message and place."""
        if "chunk_id" in chunks.columns and chunks.filter("chunk_id IS NULL").isEmpty():
            return self.apply({"chunks": (chunks, lambda old: _added(old, chunks))})
        state = self.state()
        with self._staging() as staged:
            given, _ = staged(chunks.withColumn("_of", self._bucket("chunks", state)), "chunks")
            counts = {r["_of"]: r["count"] for r in given.groupBy("_of").count().collect()}  # a row a bucket
            if not counts:
                return state["version"]
            before, last = {}, self._chunk_ids(state)
            for bucket in sorted(counts):
                before[bucket], last = last, last + counts[bucket]
            offsets = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])
            place = F.row_number().over(Window.partitionBy("_of").orderBy("message_id", "chunk_index"))
            own = F.col("chunk_id") if "chunk_id" in chunks.columns else F.lit(None)
            numbered = given.withColumn("chunk_id", F.coalesce(own.cast("long"), offsets[F.col("_of").cast("long")] + place)).drop("_of")
            return self.apply({"chunks": (numbered, lambda old: _added(old, numbered))})

    def mark_embedded(self, name: str, key: str, ids: DataFrame) -> int:
        """Set the flag of the units or chunks that ``ids`` lists."""
        marked = ids.select(key).distinct()
        touched = self.table(name).join(marked, key, "left_semi")

        def change(old: DataFrame) -> DataFrame:
            rows = old.join(marked.withColumn("_marked", F.lit(True)), key, "left")
            flags = {"is_embedded": F.lit(1), "updated_at": F.current_timestamp()}
            return rows.withColumns({c: F.when(F.col("_marked"), value).otherwise(F.col(c)) for c, value in flags.items()})

        return self.apply({name: (touched, change)})

    def vectors_of(self, ids: Sequence[str]) -> DataFrame:
        return self.rows_of_units("vectors", ids)

    def delete_vectors(self, ids: Sequence[str]) -> int:
        if not ids:
            return self.state()["version"]
        touched = self.vectors_of(ids).select("metadata.raw_document_id")
        return self.apply({"vectors": (touched, lambda old: old.filter(~F.col("id").isin(*ids)))})

    def _documents_of_message(self, message_id: str, version: int | None = None) -> DataFrame:
        """A message's documents, however they came into the archive."""
        state = self.state() if version is None else self._version(version)
        if "external_ids" in state["tables"]:
            own = self.rows_of("external_ids", [message_id], version).filter(F.col("source_type").isin(*MESSAGE_TYPES))
            return self.rows_of("raw_documents", [r["raw_document_id"] for r in own.collect()], version)  # one of each type and source
        return self.table("raw_documents", version).filter((F.col("external_id") == message_id) & F.col("source_type").isin(*MESSAGE_TYPES))

    def edit_message(self, message_id: str, title: str, content: str, embedder: Embedder, sender: str = "") -> dict[str, int | list[int]]:
        """Change a message, its sender and its conversation's title in both layers, in one version.

        A blank title or sender keeps the old one. Of each table one bucket is read and
        written. Returns the number of chunks, their identifiers and the new version.
        Raises ``ValueError`` for blank content and ``KeyError`` for an unknown message.
        """
        content = content.strip()
        if not content:
            raise ValueError("content is empty")
        messages = self.rows_of("messages", [message_id])
        row = messages.first()
        if row is None:
            raise KeyError(message_id)
        conversations = self.rows_of("conversations", [row["conversation_id"]])
        talk = conversations.first()
        title = title.strip() or (talk["title"] if talk and talk["title"] else "").strip() or "Untitled conversation"
        sender = sender.strip() or (row["sender_type"] or "").strip() or "unknown"
        text, digest = F.lit(content), F.md5(F.lit(content).cast("binary"))
        one = messages.withColumns({"content": text, "content_length": F.lit(len(content)), "content_hash": digest, "sender_type": F.lit(sender)})
        retitled = conversations.withColumn("title", F.lit(title))
        with self._staging() as staged:
            new_chunks, made = staged(rechunked(one.select("message_id", "content"), self._chunk_ids(self.state())), "chunks")
            stored = self._documents_of_message(message_id)
            if stored.isEmpty():
                documents, units = bootstrap_documents(one, retitled), bootstrap_units(one, retitled, new_chunks)
            else:
                documents = stored.withColumns({"content": text, "content_hash": digest, "title": F.lit(title), "author": F.lit(sender)})
                units = memory_units(documents, embedder.version)
            documents, _ = staged(documents, "documents")
            units, _ = staged(units, "units")
            named = documents.withColumns({"title": filled(F.col("title"), F.lit("Untitled conversation")), "source": filled(F.col("source"), F.lit("Unknown source"))})
            with_document = units.join(F.broadcast(named.select("raw_document_id", document_facts().alias("document"))), "raw_document_id")  # one message's
            embedded = new_chunks.withColumn("is_embedded", F.lit(1))
            version = self.apply(
                {
                    "messages": (one, lambda old: upserted(old, one, ["message_id"])),
                    "conversations": (retitled, lambda old: upserted(old, retitled, ["conversation_id"])),
                    "chunks": (one, lambda old: children_replaced(old, embedded, one, "message_id")),
                    **self._archived(documents, units, vectors(with_document, embedder)),
                }
            )
            ids = [r["chunk_id"] for r in new_chunks.select("chunk_id").orderBy("chunk_index").collect()]  # of one message
        return {"chunks": made, "chunk_ids": ids, "version": version}

    def restore_message(self, message_id: str, version: int) -> int:
        """Put a message, its chunks, documents, units and vectors back as they were in ``version``, and its conversation's title.

        Later changes of other messages stay. Raises ``KeyError`` if the version lacks the message.
        """
        one = self.rows_of("messages", [message_id], version)
        row = one.first()
        if row is None:
            raise KeyError(message_id)
        then = self.rows_of("conversations", [row["conversation_id"]], version).first()
        now = self.rows_of("conversations", [row["conversation_id"]])
        retitled = now.withColumn("title", F.lit(then["title"] if then else None)) if then else now
        chunks = self.rows_of("chunks", [message_id], version)
        documents = self._documents_of_message(message_id, version)
        ids = [r["raw_document_id"] for r in documents.select("raw_document_id").collect()]  # one of each type and source
        gone = self._documents_of_message(message_id).select("raw_document_id")
        found = self.rows_of("vectors", ids, version)
        units = self.rows_of("memory_units", ids, version)
        archived = self._archived(documents, units, found, gone)
        # Units are restored as they were, also if they had no vectors yet.
        parents = archived["memory_units"][0]
        archived["memory_units"] = (parents, lambda old: children_replaced(old, units, parents, "raw_document_id"))
        # Also where the message had no document then.
        archived["external_ids"] = (one.select(F.col("message_id").alias("external_id")), archived["external_ids"][1])
        return self.apply(
            {
                "messages": (one, lambda old: upserted(old, one, ["message_id"])),
                "conversations": (retitled, lambda old: upserted(old, retitled, ["conversation_id"])),
                "chunks": (one, lambda old: children_replaced(old, chunks, one, "message_id")),
                **archived,
            }
        )

    def index_vectors(self, embedder: Embedder, **options) -> int:
        """Make the vector index of the embedder's vectors, for searches until it is made again.

        Buckets that change afterwards are searched exactly.
        """
        state = self.state()
        folder = f"index/{uuid.uuid4().hex}"
        own = self.table("vectors").filter(F.col("embedding_version") == embedder.version)
        rows = own.select("id", "embedding", F.col("metadata.raw_document_id").alias("raw_document_id"), self._bucket("vectors", state).cast("int").alias("bucket"))
        VectorIndex.build(rows, f"{self.root}/{folder}", **options)
        return self._go_on(state, state["tables"], index={"folder": folder, "version": embedder.version, "vectors": state["tables"].get("vectors", {})})

    def nearest_vectors(self, query: Sequence[float], k: int, version: str, probes: int | None = None, exact: bool = False) -> DataFrame:
        """``id, raw_document_id, score`` of the ``k`` vectors of a version that are nearest by cosine.

        From the index, and exactly from the buckets that changed since it was made.
        """

        def exactly(folders: Sequence[str]) -> DataFrame:
            own = of_version(self._read("vectors", folders), version).select("id", F.col("metadata.raw_document_id").alias("raw_document_id"), "embedding")
            return nearest(own, column, k).select("id", "raw_document_id", "score")

        state = self.state()
        index, now = state.get("index"), state["tables"].get("vectors", {})
        column = F.array(*[F.lit(float(x)) for x in query])
        if exact or not index or index["version"] != version:
            return exactly(list(now.values()))
        changed = {n: f for n, f in now.items() if index["vectors"].get(n) != f}
        dropped = [int(n) for n in index["vectors"] if n not in now or n in changed]
        found = VectorIndex(self.spark, f"{self.root}/{index['folder']}").nearest(query, k, probes, without=dropped)
        if changed:
            found = found.unionByName(exactly(list(changed.values())))
        return found.orderBy("score", "id").limit(k)
