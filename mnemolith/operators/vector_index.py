"""An index of vectors by cosine: inverted lists around learnt centres, quantised residuals, exact ranking in the end.

Vectors of length one are dealt to the nearest of some centres, one folder a list, and the
rest that the centre leaves is kept as a code of ``parts`` bytes, each the nearest of 256 learnt
pieces, beside the length of what the code misses. A search goes through the lists nearest to the query
only. A code and that length bound a vector's cosine from both sides: the first pass reads them and finds what
the ``k`` nearest reach at least, the second ranks all vectors exactly that may reach it, however many
they are, so that nothing in the lists searched is lost to the codes. Centres and
pieces are learnt from an evenly hashed sample of at most ``max_sample`` vectors in
expectation; every vector is indexed. How many lists a search must go through for a
``recall`` depends on the vectors (few where they stand in groups, most where they stand
nowhere in particular), so it is measured on the sample and kept with the index. A list that holds very many
vectors is written as several files.

Vectors that are null, zero, of another length than most or not all numbers have no cosine and
are not indexed. Fewer vectors than ``least`` make one list, which is exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .recall import nearest


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of a column of lists of ``size`` numbers, of length one."""
    rows = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, size)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre nearest to each row, in blocks."""
    half = (centres * centres).sum(axis=1) / 2
    parts = [(half - part @ centres.T).argmin(axis=1) for part in np.array_split(rows, max(1, len(rows) * len(centres) >> 22))]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _centres(rows: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Centres of ``count`` groups, from a fixed start; a group that empties takes the row farthest from its centre."""
    chance = np.random.default_rng(7)
    centres = rows[chance.choice(len(rows), min(count, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        empty = np.flatnonzero(sizes == 0)
        if len(empty):
            far = np.argsort(-((rows - centres[own]) ** 2).sum(axis=1))[: len(empty)]
            centres[empty] = rows[far]
    return centres.astype(np.float32)


def _enough_lists(sample: np.ndarray, own: np.ndarray, centres: np.ndarray, recall: float, k: int = 10, queries: int = 200) -> int:
    """The fewest nearest lists that hold this share of the ``k`` nearest neighbours of some of the sample."""
    places = []
    for at in range(0, len(sample), max(1, len(sample) // queries)):
        near = np.argpartition(-(sample @ sample[at]), min(k, len(sample) - 1))[:k]
        rank = np.empty(len(centres), dtype=np.int64)
        rank[np.argsort(-(centres @ sample[at]))] = np.arange(len(centres))
        places.append(rank[own[near]])
    return int(np.quantile(np.concatenate(places), recall)) + 1


class VectorIndex:
    """An index that :meth:`build` wrote below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.model = pickle.loads(bytes(spark.read.parquet(f"{path}/model").first()["model"]))

    def lists(self, numbers: Sequence[int] | None = None) -> DataFrame:
        """The rows of some lists, or of all; only these lists' files are listed and read."""
        chosen = [n for n in self.model["present"] if numbers is None or n in set(numbers)]
        reader = self.spark.read.schema(self.model["schema"]).option("basePath", f"{self.path}/lists")
        return reader.parquet(*[f"{self.path}/lists/list={n}" for n in chosen])

    @staticmethod
    def build(vectors: DataFrame, path: str, lists: int | None = None, parts: int = 16, max_sample: int = 20_000, least: int = 1_000, recall: float = 0.98) -> VectorIndex:
        """Index ``vectors(id, embedding, …)``; further columns but the embedding are kept for what a search returns."""
        spark = vectors.sparkSession
        rows = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
        length = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x)
        rows = rows.filter(length.isNotNull() & ~F.isnan(length) & (length > 0) & (length < float("inf")))
        sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
        size, count = (sizes["size"], sizes["count"]) if sizes else (0, 0)
        model: dict = {"size": size}
        if count:
            rows = rows.filter(F.size("embedding") == size)
            share = min(1.0, max_sample / count)
            some = rows.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).select("id", "embedding").toArrow()
            order = pc.sort_indices(some, sort_keys=[("id", "ascending")])
            sample = _matrix(some.take(order).column("embedding").combine_chunks(), size)
            if not len(sample):
                sample = np.eye(1, size, dtype=np.float32)
            lists = lists or (1 if count < least else int(min(4096, max(1, round(count**0.5)))))
            parts = min(parts, size)
            centres = _centres(sample, lists)
            own = _nearest(sample, centres)
            rest = sample - centres[own]
            cuts = np.linspace(0, size, parts + 1).astype(int)
            model |= {"probes": _enough_lists(sample, own, centres, recall), "centres": centres, "cuts": cuts, "books": [_centres(rest[:, a:b], 256) for a, b in zip(cuts, cuts[1:])]}
            VectorIndex._coded(rows, model).hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
            back = spark.read.parquet(f"{path}/lists")
            model |= {"schema": back.schema, "present": sorted({int(f.rpartition("list=")[2].partition("/")[0]) for f in back.inputFiles()})}
        blob = pickle.dumps(model)  # lists * size and 256 * size numbers
        spark.createDataFrame([(bytearray(blob),)], "model binary").write.parquet(f"{path}/model")
        return VectorIndex(spark, path)

    @staticmethod
    def _coded(rows: DataFrame, model: dict) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                unit = _matrix(batch.column("embedding"), own["size"])
                at = _nearest(unit, own["centres"])
                rest = unit - own["centres"][at]
                cuts = own["cuts"]
                codes = np.column_stack([_nearest(rest[:, a:b], book) for a, b, book in zip(cuts, cuts[1:], own["books"])]).astype(np.uint8)
                missed = np.linalg.norm(rest - np.column_stack([book[c] for book, c in zip(own["books"], codes.T)]), axis=1)
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())])
                columns = [pa.array(at.astype(np.int32)), fixed.cast(pa.binary()), pa.array(missed.astype(np.float32)), *batch.columns]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "code", "missed", *batch.schema.names])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"list int, code binary, missed float, {kinds}")

    def probed(self, query: Sequence[float], probes: int | None = None) -> list[int]:
        """The lists nearest to the query, as many as the sample showed to be enough if no number is given."""
        unit = np.asarray(query, dtype=np.float32)
        near = self.model["centres"] @ (unit / np.linalg.norm(unit))
        present = np.array(self.model["present"])
        return sorted(present[np.argsort(-near[present])[: probes or self.model["probes"]]].tolist())

    def nearest(self, query: Sequence[float], k: int, probes: int | None = None, without: Sequence[int] = (), digits: int | None = None) -> DataFrame:
        """The ``k`` nearest rows that the probed lists hold, with their ``score``; rows of the buckets ``without`` are left out.

        Exact for these lists; ties as in :func:`recall.nearest`.
        """
        unit = np.asarray(query, dtype=np.float64)
        if not self.model["size"]:
            return self.spark.createDataFrame([], "id string, raw_document_id string, score double")
        names = self.model["schema"].names
        kept = [c for c in names if c not in ("list", "code", "missed", "embedding", "bucket")]
        size = np.linalg.norm(unit)
        if len(unit) != self.model["size"] or not np.isfinite(size) or not size:
            return self.lists(self.model["present"][:1]).limit(0).select(*kept, F.lit(0.0).alias("score"))
        unit = unit / size
        here = self.lists(self.probed(query, probes))
        if without:
            here = here.filter(~F.col("bucket").isin(*without))
        if "missed" not in names:
            here = here.withColumn("missed", F.lit(2.0).cast("float"))  # an older index does not say: no vector is too far
        model = self.model
        # What each byte of a code adds to the product with the query.
        gains = np.zeros((len(model["books"]), 256), dtype=np.float32)
        for i, (a, b, book) in enumerate(zip(model["cuts"], model["cuts"][1:], model["books"])):
            gains[i, : len(book)] = book @ unit[a:b]
        base = model["centres"] @ unit
        rounded = 1e-5  # more than single precision loses in such a sum
        within = 1e-9 if digits is None else 1e-9 + 10.0**-digits  # what may still be a tie

        def by_code(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(-1, len(gains))
            product = base[batch.column("list").to_numpy()] + gains[np.arange(len(gains)), codes].sum(axis=1)
            return product, batch.column("missed").to_numpy().astype(np.float64) + rounded

        most = max(k, 1)

        def greatest(values: np.ndarray) -> np.ndarray:
            return -np.partition(-values, most - 1)[:most] if len(values) > most else values

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.zeros(0)
            for batch in batches:
                if batch.num_rows:
                    product, missed = by_code(batch)
                    best = greatest(np.append(best, product - missed))
            yield pa.RecordBatch.from_arrays([pa.array(best)], names=["least"])

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, bar = np.zeros(0), floor
            for batch in batches:
                if not batch.num_rows:
                    continue
                product, missed = by_code(batch)
                batch = batch.filter(pa.array(~(product + missed < bar - within)))
                if not batch.num_rows:
                    continue
                rows = pc.list_flatten(batch.column("embedding")).to_numpy(zero_copy_only=False).reshape(-1, len(unit))
                cosine = rows @ unit / np.linalg.norm(rows, axis=1)
                best = greatest(np.append(best, cosine))
                bar = max(bar, best.min()) if len(best) == most else bar
                yield batch.filter(pa.array(~(cosine < bar - within))).select([*kept, "embedding"])

        # As many numbers of each task as are asked for, and as many in the end.
        reached = [r["least"] for r in here.select("list", "code", "missed").mapInArrow(least, "least double").orderBy(F.desc("least")).limit(most).collect()]
        floor = min(reached) if len(reached) == most else -np.inf
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in here.select(*kept, "embedding").schema)
        ranked = here.select("list", "code", "missed", *kept, "embedding").mapInArrow(possible, kinds)
        return nearest(ranked, F.array(*[F.lit(float(x)) for x in query]), k, digits=digits).select(*kept, "score")
