"""python -m gridloom extract|chunk|model-year|link|serve"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import api
from .operators import model_year


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("extract", help="PDF files or URLs to a saved corpus and, if asked for, chunks")
    p.add_argument("sources", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--chunks")
    p = sub.add_parser("chunk", help="a blocks.json to a chunks.json")
    p.add_argument("blocks")
    p.add_argument("output")
    p.add_argument("--size", type=int, default=450)
    p.add_argument("--overlap", type=int, default=60)
    p = sub.add_parser("model-year", help="a brochure (PDF, or its blocks.json) to a linked document")
    p.add_argument("source")
    p.add_argument("output")
    for o in ("--schema", "--name", "--valid-from"):
        p.add_argument(o)
    p.add_argument("--profile", default="auto")
    p = sub.add_parser("link", help="a draft document to a linked one")
    p.add_argument("source")
    p.add_argument("output")
    p.add_argument("--schema")
    p.add_argument("--codes", nargs="*")
    p = sub.add_parser("serve", help="the HTTP service")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    a = top.parse_args(args)
    try:
        if a.command == "link":
            model_year.link_file(a.source, a.output, a.schema, a.codes)
            return 0
        if a.command == "model-year" and a.source.endswith(".json"):
            model_year.build_file(a.source, a.output, a.schema, name=a.name, valid_from_=a.valid_from, profile=a.profile)
            return 0
        spark = SparkSession.builder.appName("gridloom").getOrCreate()
        if a.command == "extract":
            saved = api.extract_corpus(spark, a.sources, a.output, progress=lambda x: print(x, file=sys.stderr))
            if a.chunks:
                api.build_chunks(spark, saved.blocks_path, a.chunks)
            print(saved.blocks_path)
        elif a.command == "chunk":
            api.build_chunks(spark, a.blocks, a.output, chunk_size=a.size, chunk_overlap=a.overlap)
        elif a.command == "model-year":
            api.extract_model_year_options(spark, a.source, output_path=a.output, schema_path=a.schema, profile=a.profile, name=a.name, valid_from=a.valid_from)
        else:
            from .service import server

            server(spark, a.host, a.port).serve_forever()
    except (ValueError, RuntimeError, OSError) as e:
        print(f"gridloom: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
