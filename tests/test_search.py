"""Pruned lookups, the vector index, restores, reused vectors, replayed batches and numbered chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolith.operators import recall
from mnemolith.operators import store as stores
from mnemolith.operators.archive_search import ArchiveSearch
from mnemolith.operators.embedding import TermCountEmbedder
from mnemolith.operators.memory import raw_documents
from mnemolith.operators.store import MemoryStore
from mnemolith.operators.vector_index import VectorIndex
from mnemolith.settings import Settings
from mnemolith.streaming.ingest import ingest_stream

EMBEDDER = TermCountEmbedder(["alpha", "beta", "gamma"])
COLUMNS = "conversation_id string, title string, source string, message_id string, sender_type string, content string, sequence int, timestamp string, conversation_created_at string, sub_title string, model string, content_length int"


class CountedEmbedder(TermCountEmbedder):
    """One whose vectors are dear."""

    reuse = True


def messages(spark, texts):
    rows = [(f"c{k % 7}", f"t{k % 7}", "ChatGPT", f"m{k}", "user", x, k, f"2024-01-{k % 28 + 1:02} 00:00:00", "", "", "", len(x)) for k, x in texts]
    return spark.createDataFrame(rows, COLUMNS)


def prose(k):
    return f"Message {k} speaks of {'alpha ' * (k % 5)}{'beta ' * (k % 3)}{'gamma ' * (k % 11)}and of {'x' * (k % 17)} nothing else."


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    found = MemoryStore(spark, f"file://{tmp_path_factory.mktemp('archive')}/store", buckets=16)
    found.ingest(raw_documents(messages(spark, [(k, prose(k)) for k in range(300)])), EMBEDDER)
    return found


def opened(df, name):
    return {f.split("_bucket=")[1].split("/")[0] for f in df.inputFiles() if f"/{name}/" in f}


def test_lookups_open_one_bucket(store):
    search, name = ArchiveSearch(store, EMBEDDER), "chatgpt:conversation_message:m17"
    document, units, unit = search.document(name), search.units(name), search.unit(f"{name}:0")
    for df, table in ((document, "raw_documents"), (units, "memory_units"), (unit, "memory_units"), (unit, "raw_documents"), (store.vectors_of([f"{name}:0"]), "vectors")):
        assert len(opened(df, table)) == 1
    assert document.first().content == prose(17) and units.count() == 1 and unit.first().raw_document.content == prose(17)
    assert search.document("nobody").isEmpty() and search.unit("nobody:0").isEmpty() and store.vectors_of(["9"]).isEmpty()


def test_a_search_opens_its_hits_buckets(spark, store):
    search = ArchiveSearch(store, EMBEDDER)
    hits = search.memory("alpha gamma", 3)
    assert len(opened(hits, "memory_units")) <= 3 and len(opened(hits, "raw_documents")) <= 3
    whole = recall.search_memory(store.table("memory_units"), store.table("raw_documents"), store.table("vectors"), "alpha gamma", EMBEDDER, 3)
    assert [tuple(r) for r in hits.collect()] == [tuple(r) for r in whole.collect()]
    assert search.memory("  ").isEmpty()
    other = TermCountEmbedder(EMBEDDER.terms, "another version")
    assert ArchiveSearch(store, other).memory("alpha").isEmpty()


@pytest.mark.parametrize("given", [{"start_date": "2024-01-05", "end_date": "2024-01-05"}, {"min_length": "75", "sort": "time_desc"}, {"min_length": "5000"}, {}])
def test_a_selective_filter_fills_its_page(store, given):
    settings = Settings(default_search_k=4, max_results_display=6)
    filters = recall.Filters.parse(given)
    page = ArchiveSearch(store, EMBEDDER, settings).page("alpha gamma", filters)
    everything = Settings(default_search_k=1000, max_results_display=6)
    expected = recall.search(store.table("memory_units"), store.table("raw_documents"), store.table("vectors"), "alpha gamma", EMBEDDER, recall.Filters.parse(given | {"sort": ""}), everything if given else settings)
    expected = recall.in_order(expected, filters.sort)
    assert [tuple(r) for r in page.collect()] == [tuple(r) for r in expected.collect()]


def test_odd_vectors_are_no_hits(spark):
    rows = [("good", [1.0, 2.0]), ("far", [-2.0, 1.0]), ("zero", [0.0, 0.0]), ("longer", [1.0, 2.0, 0.0]), ("null", None), ("hole", [1.0, None]), ("nan", [float("nan"), 1.0]), ("a tie", [2.0, 4.0])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<double>")
    query = F.array(F.lit(1.0), F.lit(2.0))
    assert [r.id for r in recall.nearest(vectors, query, 3, digits=9).collect()] == ["a tie", "good", "far"]
    assert [r.id for r in recall.nearest(vectors, query, 8).collect()][-1] == "far"


def test_index_recall_and_lists_read(spark, tmp_path):
    chance = np.random.default_rng(3)
    groups = chance.standard_normal((60, 32))
    rows = groups[chance.integers(0, 60, 6000)] + 0.35 * chance.standard_normal((6000, 32))
    odd = [("zero", [0.0] * 32), ("null", None), ("short", [1.0, 2.0])]
    vectors = spark.createDataFrame([(f"v{i:04}", x.tolist()) for i, x in enumerate(rows)] + odd, "id string, embedding array<double>")
    index = VectorIndex.build(vectors, f"file://{tmp_path}/index", lists=64)
    assert index.lists().count() == 6000
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    found = 0
    for at in range(0, 6000, 500):
        probed = index.probed(rows[at].tolist())
        assert len(probed) <= 16
        hits = index.nearest(rows[at].tolist(), 10)
        files = {int(f.split("list=")[1].split("/")[0]) for f in hits.inputFiles()}
        assert files == set(probed) and len(files) < 64
        best = {f"v{i:04}" for i in np.argsort(-(unit @ unit[at]), kind="stable")[:10]}
        got = hits.collect()
        assert [r.score for r in got] == sorted(r.score for r in got)
        found += len(best & {r.id for r in got})
    assert found >= 0.95 * 120
    assert index.nearest([0.0] * 32, 3).isEmpty() and index.nearest([1.0], 3).isEmpty()


def test_store_searches_its_index_and_what_changed_since(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/store", buckets=8)
    store.ingest(raw_documents(messages(spark, [(k, prose(k)) for k in range(120)])), EMBEDDER)
    store.index_vectors(EMBEDDER, lists=12)
    search, exact = ArchiveSearch(store, EMBEDDER, probes=12), ArchiveSearch(store, EMBEDDER, exact=True)

    def both(query):
        return [[(r.memory_unit_id, round(r.score, 6)) for r in s.memory(query, 8).collect()] for s in (search, exact)]

    assert both("alpha gamma gamma")[0] == both("alpha gamma gamma")[1]
    store.ingest(raw_documents(messages(spark, [(k, "Now alpha alpha alpha beta, and hardly more.") for k in (3, 4, 500)])), EMBEDDER)
    one, other = both("alpha alpha alpha beta")
    assert one == other and any(":m500:" in i for i, _ in one)
    assert any("/index/" in f for f in store.nearest_vectors([1.0, 0.0, 0.0, 5.0], 5, EMBEDDER.version).inputFiles())


def test_restoring_one_message_keeps_later_changes_of_others(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/store", buckets=8)
    rows = messages(spark, [(k, prose(k)) for k in range(12)])
    talks = rows.select("conversation_id", "title", F.lit("2024").alias("created_at"), "source", F.lit(None).cast("string").alias("raw_meta")).distinct()
    store.save_conversations(talks, rows.drop("title", "source", "conversation_created_at").withColumn("content_hash", F.md5("content")))
    store.save_chunks(rows.select("message_id", F.lit(0).alias("chunk_index"), "content", F.md5("content").alias("hash"), F.lit(0).alias("is_embedded")))
    ids = [r.chunk_id for r in store.table("chunks").collect()]
    assert sorted(ids) == list(range(1, 13))  # numbered without any given
    assert store.bootstrap()["migrated"]
    before = store.state()["version"]
    first = store.edit_message("m1", "New", "The first edit of message one, which is long enough.", EMBEDDER)
    assert first["chunk_ids"] == [13] and first["chunks"] == 1
    second = store.edit_message("m2", "Other", "The only edit of message two, which is long enough.", EMBEDDER)
    assert second["chunk_ids"] == [14]
    assert len(store.state()["tables"]["messages"]) <= 8
    store.restore_message("m1", before)

    def facts(message):
        document = store.table("raw_documents").filter(F.col("external_id") == message).first()
        units = [r.content for r in store.table("memory_units").filter(F.col("raw_document_id") == document.raw_document_id).collect()]
        return document.content, store.rows_of("messages", [message]).first().content, units, [r.chunk_id for r in store.rows_of("chunks", [message]).collect()]

    content, message, units, chunks = facts("m1")
    assert content == message == prose(1) and units == [prose(1)] and len(chunks) == 1 and chunks[0] <= 12
    assert facts("m2")[0].startswith("The only edit") and facts("m2")[3] == [14]
    assert store.table("vectors").filter("metadata.raw_document_id = 'legacy:message:m1'").count() == 0  # had none then
    titles = {r.conversation_id: r.title for r in store.table("conversations").collect()}
    assert titles["c1"] == "t1" and titles["c2"] == "Other"
    store.restore_message("m4", before - 1)  # before it had a document
    assert store.table("raw_documents").filter("external_id = 'm4'").isEmpty() and store.rows_of("external_ids", ["m4"]).isEmpty()
    assert store.table("memory_units").filter("raw_document_id = 'legacy:message:m4'").isEmpty() and store.count_rows("raw_documents") == 11
    with pytest.raises(KeyError):
        store.restore_message("nobody", before)
    assert store.edit_message("m3", "", "Yet another edit of a message, long enough.", EMBEDDER)["chunk_ids"] == [15]


def test_vectors_are_reused_by_text_and_version(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/store", buckets=4)
    texts = [(k, prose(k % 10)) for k in range(30)]
    embedder = CountedEmbedder(EMBEDDER.terms, "one")
    assert store.ingest(raw_documents(messages(spark, texts)), embedder) == {"raw_documents": 30, "memory_units": 30, "embedded": 10}
    assert store.ingest(raw_documents(messages(spark, texts)), embedder)["embedded"] == 0
    plain = MemoryStore(spark, f"file://{tmp_path}/plain", buckets=4)
    plain.ingest(raw_documents(messages(spark, texts)), TermCountEmbedder(EMBEDDER.terms, "one"))
    assert store.table("vectors").exceptAll(plain.table("vectors")).isEmpty()
    assert store.ingest(raw_documents(messages(spark, texts[:20] + [(99, "Something new, all alpha.")])), CountedEmbedder(EMBEDDER.terms, "two"))["embedded"] == 11
    assert {r.embedding_version: r["count"] for r in store.table("vectors").groupBy("embedding_version").count().collect()} == {"one": 10, "two": 21}
    assert {r.memory_unit_id.split(":")[2] for r in ArchiveSearch(store, embedder).memory("alpha", 50).collect()} == {f"m{k}" for k in range(20, 30)}


def test_a_repeated_import_moves_keys_only(spark, tmp_path, monkeypatch):
    """Documents that come once are not sorted out, and rows that all go, or all stay, are not joined."""
    store = MemoryStore(spark, f"file://{tmp_path}/store", buckets=4)
    rows = messages(spark, [(k, prose(k)) for k in range(12)])
    once = raw_documents(rows)
    store.ingest(raw_documents(rows.unionByName(messages(spark, [(3, "The later reading of it.")]))), EMBEDDER)
    assert store.table("raw_documents").filter("external_id = 'm3'").first().content == "The later reading of it." and store.count_rows("raw_documents") == 12

    def never(*_):
        raise AssertionError("rows were sorted out")

    monkeypatch.setattr(stores, "last_wins", never)
    assert store.ingest(once, EMBEDDER)["raw_documents"] == 12
    assert store.table("raw_documents").filter("external_id = 'm3'").first().content == prose(3) and store.count_rows("vectors") == 12
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, n int")
    for parents, left, joined in (([], [1, 2, 3, 4], False), (["z"], [1, 2, 3, 4], False), (["a"], [3, 4], True), (["a", "b"], [4], True)):
        kept = stores.kept_apart(old, spark.createDataFrame([(k,) for k in parents], "k string"), "k")
        assert sorted(r.n for r in kept.collect()) == left and ("Join" in kept._jdf.queryExecution().optimizedPlan().toString()) == joined
    assert stores.kept_apart(old.filter("k = 'a'"), spark.createDataFrame([("a",)], "k string"), "k").isEmpty()


def test_a_batch_that_comes_again_is_skipped(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/store")
    rows = messages(spark, [(k, prose(k)) for k in range(5)])
    assert store.ingest(raw_documents(rows), EMBEDDER, batch=("s", 0))["raw_documents"] == 5
    state = store.state()
    assert store.ingest(raw_documents(rows), EMBEDDER, batch=("s", 0)) == {"raw_documents": 0, "memory_units": 0} and store.state() == state
    assert store.ingest(raw_documents(rows), EMBEDDER, batch=("s", 1))["raw_documents"] == 5 and store.state()["batches"] == {"s": 1}
    rows.write.parquet(f"file://{tmp_path}/in")
    checkpoint = f"file://{tmp_path}/seen"
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    ingest_stream(stream, store, EMBEDDER, checkpoint).awaitTermination()
    made = store.state()
    assert made["batches"][checkpoint] == 0
    assert store.ingest(raw_documents(rows), EMBEDDER, batch=(checkpoint, 0))["raw_documents"] == 0 and store.state() == made


def test_index_loses_no_vector_to_its_codes(spark, tmp_path):
    """Hundreds of near copies of the query have about one code; distances within 1e-6 are ties, which go by id."""
    chance = np.random.default_rng(5)
    rows = chance.standard_normal((4000, 32))
    rows[1000:1600] = rows[0] + 1e-2 * chance.standard_normal((600, 32))
    rows[2000:2600] = rows[1] + 1e-4 * chance.standard_normal((600, 32))
    rows[3000:3600] = rows[2]
    order = chance.permutation(4000)
    vectors = spark.createDataFrame([(int(i), rows[i].tolist()) for i in order], "id long, embedding array<double>")
    index = VectorIndex.build(vectors, f"file://{tmp_path}/index", lists=8)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for at in (0, 1, 2, 3):
        distance = np.round(1 - unit @ unit[at], 6)
        best = np.lexsort((np.arange(4000), distance))[:10]
        got = index.nearest(rows[at].tolist(), 10, probes=8, digits=6).collect()
        assert [r.id for r in got] == best.tolist()
        assert np.abs(np.array([r.score for r in got]) - distance[best]).max() < 1.5e-6
    assert index.nearest(rows[0].tolist(), 5000, probes=8).count() == 4000
