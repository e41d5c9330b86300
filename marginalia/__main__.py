"""Commands: ``python -m marginalia index|search|serve``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from marginalia.control import files, listener, tools
from marginalia.operators import chunker, lexical
from marginalia.operators.refresh import Store
from marginalia.sources import vault


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="marginalia")
    p.add_argument("command", choices=["index", "search", "serve"])
    p.add_argument("vault", help="folder of notes")
    p.add_argument("--store", required=True, help="folder of the index")
    p.add_argument("--query", default="")
    p.add_argument("--limit", type=int, default=8)
    p.add_argument("--port", type=int, default=0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("marginalia").getOrCreate()
    store = Store(spark, a.store)

    def build() -> int:
        notes = vault.scan_notes(spark, a.vault)
        chunks = chunker.chunk_notes(notes).withColumn("run_id", _lit(0)).withColumn("indexed_at", _now())
        store.save(chunks)
        return notes.count()

    if a.command == "index":
        n = build()
        print(f"{n} notes, {store.load().count()} chunks")
        return 0
    chunks = store.load()
    if chunks is None:
        print("no index: run the command index first")
        return 1
    index = lexical.as_index(lexical.distinct_chunks(chunks))
    if a.command == "search":
        asked = spark.createDataFrame([(0, a.query)], "query_id int, query string")
        for r in lexical.search(index, asked, a.limit).orderBy("rank").collect():
            print(f"{r['rank']}. {r['note_path']} ({r['score']:.3f})")
        return 0

    def again():
        n = build()
        new = lexical.distinct_chunks(store.load())
        return n, new, lexical.as_index(new)

    desk = tools.Desk(lexical.distinct_chunks(chunks), index, files.MemoryFiles(spark, a.vault), again)
    http = listener.listener(tools.server(desk), os.environ.get("MARGINALIA_TOKEN", ""), port=a.port)
    print(f"listening on port {http.server_address[1]}")
    http.serve_forever()
    return 0


def _lit(value: int):
    from pyspark.sql import functions as F

    return F.lit(value)


def _now():
    from pyspark.sql import functions as F

    return F.current_timestamp()


if __name__ == "__main__":
    raise SystemExit(main())
