"""Command line: python -m poslex COMMAND ...

encode CONFIG [TEXT]        encode vertical text (files, or - or nothing for standard input) into the collection's folder
index CONFIG ATTRIBUTE ...  write the inverted indexes of attributes ``a`` or ``s.a`` (all, if none is named)
convert CONFIG FOLDER       make a collection in FOLDER of the compiled files that the configuration names
raw TEXT FOLDER             encode every line of a text as a token, as one column
dump CONFIG FOLDER [HEAD]   write the word sketches (of one head) as tab-separated text
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import collection
from .operators._shared import clean_up, new_path
from .sources import compiled, vertical
from .sources.config import Config


def _standard_input(spark: SparkSession) -> str:
    """Standard input as a file in the shared folder."""
    folder = new_path(spark, "input")
    system, at = compiled._file(f"{folder}/lines")
    with system.open_output_stream(at) as out:
        while part := sys.stdin.buffer.read(1 << 20):
            out.write(part)
    return folder


def main(args: list[str], spark: SparkSession | None = None) -> int:
    command, *rest = args or [""]
    need = {"encode": (1, 2), "index": (1, 1000), "convert": (2, 2), "raw": (2, 2), "dump": (2, 3)}.get(command)
    if need is None or not need[0] <= len(rest) <= need[1]:
        print(__doc__, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("poslex").getOrCreate()
    try:
        if command == "raw":
            collection._write_column(spark, vertical.raw_tokens(vertical.Lines.of_files(spark, rest[0])), f"{rest[1].rstrip('/')}/word")
            return 0
        config = Config.open(rest[0])
        if command == "encode":
            text = rest[1] if rest[1:] not in ([], ["-"]) else _standard_input(spark)
            for row in collection.encode(spark, config, text).problems().groupBy("kind").sum("n").orderBy("kind").collect():
                print(f"{row[0]}: {row[1]}", file=sys.stderr)
        elif command == "index":
            out = collection.Collection(spark, config)
            every = [n for n, _ in config.positional()] + [f"{s}.{a}" for s, own in config.structures().items() for a, _ in own]
            for name in rest[1:] or every:
                collection.index(out, name)
        elif command == "convert":
            collection.convert(spark, config, rest[1])
        else:
            sketch = collection.Collection(spark, config).sketch()
            if rest[2:] and sketch.words.where(sketch.words["value"] == rest[2]).isEmpty():
                print(f"no head {rest[2]!r}", file=sys.stderr)
                return 1
            sketch.write_tsv(*rest[1:])
        return 0
    finally:
        clean_up(spark)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
