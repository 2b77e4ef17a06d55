"""Command line: python -m folioloom convert | contents | rewrite | check | repair."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

log = logging.getLogger("folioloom")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="folioloom", description=__doc__)
    parser.add_argument("--debug", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="one document into folders of text files")
    convert.add_argument("path")
    convert.add_argument("out")
    convert.add_argument("--first", type=int, help="first page, counted from 1 (PDF only)")
    convert.add_argument("--last", type=int, help="last page (PDF only)")
    convert.add_argument("--no-images", action="store_true")
    convert.add_argument("--no-tables", action="store_true", help="(PDF only)")
    contents = commands.add_parser("contents", help="the contents list of word-processing documents")
    contents.add_argument("path")
    contents.add_argument("out")
    contents.add_argument("--json", action="store_true")
    rewrite = commands.add_parser("rewrite", help="a word-processing document with bookmarks, and list numbers as text")
    rewrite.add_argument("path")
    rewrite.add_argument("out")
    rewrite.add_argument("--no-bookmarks", action="store_true")
    rewrite.add_argument("--keep-numbering", action="store_true")
    check = commands.add_parser("check", help="whether PDF files can be read")
    check.add_argument("path")
    check.add_argument("--timeout", type=float, default=10.0)
    repair = commands.add_parser("repair", help="a PDF file with a new table of offsets")
    repair.add_argument("path")
    repair.add_argument("out")
    return parser


def unused(kind: str, first: int | None, last: int | None) -> list[str]:
    """Options given that files of this kind do not have."""
    return [name for name, value in (("--first", first), ("--last", last)) if value is not None and kind != "pdf"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from folioloom.operators import contents
    from folioloom.plans import documents
    from folioloom.sinks import render
    from folioloom.sources import docx, files, precheck

    args = arguments().parse_args(argv)
    logging.basicConfig(stream=sys.stdout, level=logging.DEBUG if args.debug else logging.INFO, format="%(levelname)s %(message)s")
    if args.command == "repair":
        with open(args.path, "rb") as f:
            content = precheck.mended(f.read())
        with open(args.out, "xb") as f:
            f.write(content)
        return 0
    spark = spark or SparkSession.builder.appName("folioloom").getOrCreate()
    try:
        match args.command:
            case "convert":
                for name in unused(documents.detect_file_type(args.path), args.first, args.last):
                    log.warning("%s is for PDF files only and has no effect", name)
                log.info("%s", documents.convert_document(spark, args.path, args.out, args.first, args.last, not args.no_images, not args.no_tables))
            case "contents":
                rows = docx.body(files.files(spark, args.path)).where("kind = 'p'").withColumnRenamed("path", "doc_id")
                entries = contents.entries(rows)
                if args.json:
                    render.write_files(render.contents_json(entries), args.out, "doc_id")
                else:
                    render.write_files(render.contents_text(entries), args.out, "ord", "part")
            case "rewrite":
                documents.rewrite_document(spark, args.path, args.out, not args.no_bookmarks, not args.keep_numbering)
            case "check":
                bad = 0
                for row in precheck.checked(files.files(spark, args.path), args.timeout).select("path", "state", "error").toLocalIterator():
                    log.info("%s: %s %s", row["path"], row["state"], row["error"] or "")
                    bad += row["state"] != "ok"
                return int(bad > 0)
    except (FileNotFoundError, ValueError, RuntimeError) as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
