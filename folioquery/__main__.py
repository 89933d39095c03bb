"""python -m folioquery
    list | run NAME DIR [ROWS] | explain NAME DIR        queries over a data folder
    parse FOLDER | images FOLDER | intent TEXT
    index STORE FOLDER [SOURCE] | embed STORE            files into a store, and their vectors
    search STORE TEXT | agent STORE TEXT
    documents STORE | info STORE ID | stats STORE | duplicates STORE FOLDER
    delete STORE ID... | cleanup STORE
"""

from __future__ import annotations

import sys
import uuid


def session():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    return SparkSession.builder.config(map=conf).getOrCreate()


def opened(path: str):
    from folioquery.operators.store import Store

    return Store(session(), path)


def shortened(text: str | None, size: int = 80) -> str:
    """One line of at most so many characters, with three points where it was cut."""
    line = " ".join((text or "").split())
    return line if len(line) <= size else line[: max(0, size - 3)] + "..."


def asked(store, text: str, agent: bool = False):
    """Rows of a search of one text."""
    from pyspark.sql import functions as F

    from folioquery.operators import embedding, unified

    v = store.table("vectors").withColumn("vec_id", F.xxhash64("document_id", "block_id", "chunk_idx", "model"))
    t = unified.Tables(store.table("documents"), store.table("blocks"), store.table("postings"), store.table("stats"), v, store.table("tags"))
    q = session().createDataFrame([(0, text)], "query_id long, query_text string")
    o = unified.Options(stemming=True, metadata=True, context_window=1 if agent else 0)
    return (unified.for_agents if agent else unified.search_store)(q, t, o, embedding.HashProvider()).orderBy("rank")


def main(args: list[str]) -> int:
    from folioquery.plans import catalog

    queries = catalog.queries()
    match args:
        case ["list"]:
            print(*sorted(queries), sep="\n")
        case ["run" | "explain", name, folder, *rows] if name in queries:
            df = queries[name](session(), folder)
            df.explain("formatted") if args[0] == "explain" else df.show(int(rows[0]) if rows else 20, truncate=80)
        case ["parse", folder]:
            from folioquery.sources import files

            files.parsed(files.files(session(), folder)).select("path", "page", "type", "content", "error").show(100, truncate=100)
        case ["images", folder]:
            from folioquery.sources import files, images

            images.extracted(files.files(session(), folder)).select("path", "page", "format", "width", "height", "error").show(100, truncate=100)
        case ["intent", text]:
            from pyspark.sql import functions as F

            from folioquery.functions import text as T

            kind = T.query_kind(F.col("t"))
            r = session().createDataFrame([(text,)], "t string").select(kind.alias("kind"), T.suggested_mode(kind).alias("mode")).first()
            print(r["kind"], r["mode"])
        case ["index", path, folder, *source]:
            from folioquery.operators import ingest
            from folioquery.sources import files

            bad = ingest.index_files(opened(path), uuid.uuid4().hex, files.files(session(), folder), ingest.IndexOptions(source=source[0] if source else None), lambda stage, n: print(stage, n))
            for r in bad.limit(20).collect():
                print("failed", r["path"], r["error"])
        case ["embed", path]:
            from folioquery.operators import embedding

            s = opened(path)
            s.repair(uuid.uuid4().hex, embedding.HashProvider())
            print("waiting", s.waiting().count())
        case ["search", path, text]:
            for r in asked(opened(path), text).collect():
                print(r["rank"], round(r["score"], 4), r["document_name"], r["block_id"], shortened(r["snippet"]))
        case ["agent", path, text]:
            for r in asked(opened(path), text, agent=True).collect():
                print(r["citation"], r["kind"], r["tokens"], r["document_name"], r["block_id"], shortened(r["content"]))
        case ["documents", path]:
            opened(path).table("documents").select("document_id", "name", "source", "page_count", "updated_at").orderBy("name", "document_id").show(100, truncate=60)
        case ["info", path, document]:
            s = opened(path)
            s.document(document).show(1, vertical=True, truncate=False)
            s.table("blocks").filter(f"document_id = '{document.replace(chr(39), '')}'").orderBy("sequence").select("block_id", "page", "type", "content").show(50, truncate=80)
        case ["stats", path]:
            from folioquery.operators import lifecycle

            s = opened(path)
            lifecycle.by_source(s.table("documents"), s.table("blocks"), s.table("vectors")).show(100, truncate=False)
            print(s.info())
        case ["duplicates", path, folder]:
            from folioquery.sources import files

            d = files.documents(files.files(session(), folder)).select("original_path", "checksum")
            d.join(opened(path).table("documents").select("checksum", "document_id", "name"), "checksum").drop("checksum").show(100, truncate=False)
        case ["delete", path, *documents] if documents:
            opened(path).delete(uuid.uuid4().hex, session().createDataFrame([(d,) for d in documents], "document_id string"))
        case ["cleanup", path]:
            opened(path).compact()
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
