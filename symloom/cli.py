"""Command line: symbol tables in, one triples file out.  Exit code 0, or 1 on any failure."""

from __future__ import annotations

import argparse
import sys
import traceback

from pyspark.sql import SparkSession

from symloom.options import ExtractionOptions
from symloom.plans.extract import Extraction
from symloom.sources import triples
from symloom.sources.loader import Loader

SUFFIX = {"NTriples": "nt", "Turtle": "ttl"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symloom")
    p.add_argument("input", help="folder of symbol tables")
    p.add_argument("-r", "--reference", action="extend", nargs="+", default=[], help="further folders of symbol tables")
    p.add_argument("-s", "--search-dir", action="extend", nargs="+", default=[], help="folders to look in for assemblies that the input refers to")
    p.add_argument("-o", "--output", help="output folder; the input's name with .nt or .ttl by default")
    p.add_argument("-f", "--format", choices=tuple(SUFFIX), default="NTriples")
    p.add_argument("-b", "--base-uri", default=ExtractionOptions.base_uri)
    p.add_argument("--include-private", action="store_true")
    p.add_argument("--include-internal", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--include-compiler-generated", action="store_true")
    p.add_argument("--extract-exceptions", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--extract-seealso", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--exclude-attributes", action="store_true")
    p.add_argument("--exclude-external-types", action="store_true")
    p.add_argument("--first-touch", action="store_true")
    p.add_argument("--one-file", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def options(a: argparse.Namespace) -> ExtractionOptions:
    return ExtractionOptions(
        base_uri=a.base_uri,
        include_private=a.include_private,
        include_internal=a.include_internal,
        include_compiler_generated=a.include_compiler_generated,
        extract_exceptions=a.extract_exceptions,
        extract_see_also=a.extract_seealso,
        include_attributes=not a.exclude_attributes,
        include_external_types=not a.exclude_external_types,
        log_level="quiet" if a.quiet else "verbose" if a.verbose else "info",
        mode="first_touch" if a.first_touch else "canonical",
    )


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    o, fmt = options(a), SUFFIX[a.format]
    say = (lambda *x: None) if o.log_level == "quiet" else print
    output = a.output or f"{a.input.rstrip('/')}.{fmt}"
    try:
        spark = spark or SparkSession.builder.appName("symloom").getOrCreate()
        say(f"Loading {a.input}")
        loader = Loader(spark)
        for path in a.reference:
            loader.add_reference(path)
        for path in a.search_dir:
            loader.add_search_dir(path)
        x = Extraction(loader.load(a.input), o)
        say(f"Output: {output}")
        bag = x.store  # written once, for the count and the lines
        n = bag.count()
        say(f"Extracted {x.full.count()} types, {n} triples")
        triples.write_lines(bag, output, fmt, triples.standard_prefixes(o.base_uri), one_file=a.one_file)
        say(f"Done. {n} triples written to {output}")
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        if o.log_level == "verbose":
            traceback.print_exc()
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
