"""Command line: python -m papyra stats|list|tree|search|symbols|similar|draft ... over folders of markdown and code.

  python -m papyra --docs FOLDER [--code FOLDER] [--glossary FILE] stats
  python -m papyra --docs FOLDER list [QUERY] | tree DOC_ID | search QUERY | symbols QUERY | similar FILE | draft TOPIC FILE
  python -m papyra --index PATH search QUERY        (an index saved with `save PATH`)
  python -m papyra --code FOLDER --report FOLDER benchmark QUERY ...    (figures of indexing, and each query's results, as benchmark.md)
"""

from __future__ import annotations

import argparse
import json

from papyra.operators import catalog, curate, evaluate, render, search, tree
from papyra.operators.indexing import Index
from papyra.operators.schema import Collection, Config
from papyra.session import local_session
from papyra.sources.files import open_index, scan_all


def main() -> None:
    p = argparse.ArgumentParser(prog="papyra", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--docs", action="append", default=[], help="folder of markdown; name=folder names the collection")
    p.add_argument("--code", action="append", default=[], help="folder of source files")
    p.add_argument("--glossary")
    p.add_argument("--index", help="a saved index")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--report", help="folder for the report of a benchmark")
    p.add_argument("command", choices=["stats", "list", "tree", "search", "symbols", "similar", "draft", "save", "benchmark"])
    p.add_argument("rest", nargs="*")
    a = p.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    named = lambda x, d: x.split("=", 1) if "=" in x else (d, x)
    collections = [Collection(*named(x, "docs")) for x in a.docs] + [Collection(*named(x, "code"), kind="code") for x in a.code]
    if a.command == "benchmark":
        lines = evaluate.benchmark(scan_all(spark, collections)).lines(", ".join(c.root for c in collections), spark.createDataFrame([(f"{k:04}", q) for k, q in enumerate(a.rest)], "qid string, query string"), a.limit)
        print("\n".join(r["text"] for r in lines.orderBy("section", "place").collect()))
        if a.report:
            evaluate.write_report(lines, a.report, "benchmark.md")
        spark.stop()
        return
    index = Index.load(spark, a.index) if a.index else open_index(spark, Config(tuple(collections), glossary_path=a.glossary))
    say = lambda df: print("\n".join(r["text"] for r in df.collect()))  # noqa: E731  results are bounded by the limit
    arg = " ".join(a.rest)
    if a.command == "stats":
        print(catalog.stats_json(index).first()["json"])
    elif a.command == "list":
        page, total = catalog.list_documents(index, a.limit, query=arg or None)
        say(render.listing(page))
        print(f"{total} documents")
    elif a.command == "tree":
        say(render.outline(tree.outline(index, arg)))
    elif a.command == "search":
        say(render.results(index, search.search(index, arg, a.limit)))
    elif a.command == "symbols":
        say(render.symbols(search.find_symbol(index, arg, limit=a.limit)))
    elif a.command == "similar":
        with open(arg, encoding="utf-8") as f:
            say(render.as_json(search.find_similar(index, f.read(), a.limit)).withColumnRenamed("json", "text"))
    elif a.command == "draft":
        with open(a.rest[1], encoding="utf-8") as f:
            print(json.dumps(curate.draft(index, a.rest[0], f.read()), indent=1))
    else:
        index.save(arg)
    spark.stop()


if __name__ == "__main__":
    main()
