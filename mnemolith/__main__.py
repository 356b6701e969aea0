"""Import one export into a store: ``python -m mnemolith --file PATH --store PATH``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.embedding import TermCountEmbedder, resolve_embedder
from .operators.store import MemoryStore
from .streaming.ingest import ingest_export


def main(arguments: list[str] | None = None) -> dict[str, int]:
    parser = argparse.ArgumentParser(prog="mnemolith", description=__doc__)
    parser.add_argument("--file", required=True, help="export file or folder that Spark can read")
    parser.add_argument("--store", required=True, help="root folder of the store")
    parser.add_argument("--terms", nargs="*", help="embed by counts of these terms instead of the sentence model")
    parser.add_argument("--supersede", action="store_true", help="replace documents that share a source and external identifier")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("mnemolith").getOrCreate()
    embedder = resolve_embedder(TermCountEmbedder(given.terms) if given.terms is not None else None)
    counters = ingest_export(spark, given.file, MemoryStore(spark, given.store), embedder, given.supersede)
    print(json.dumps(counters))
    return counters


if __name__ == "__main__":
    main()
