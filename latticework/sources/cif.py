"""STAR files (mmCIF): a tokeniser of quotes, text fields and loops, and tables of one category each."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A text field between lines that begin with a semicolon, a quoted value, a comment, or a bare word. A quote ends before white space only.
TOKEN = re.compile(r"^;(?P<text>.*?)^;(?=\s|\Z)|'(?P<one>[^\n]*?)'(?=\s|\Z)|\"(?P<two>[^\n]*?)\"(?=\s|\Z)|\#[^\n]*|(?P<word>\S+)", re.DOTALL | re.MULTILINE)


def tokens(text: str) -> Iterator[tuple[bool, str | None]]:
    """(bare, value): bare words may be names and keywords; an unquoted . or ? is a missing value."""
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            word = m["word"]
            yield (False, None) if word in (".", "?") else (True, word)
        elif kind == "text":
            yield False, m["text"].removesuffix("\n")
        elif kind:
            yield False, m[kind]


def category_rows(text: str, category: str) -> Iterator[tuple[str, dict[str, str | None]]]:
    """(block, values by lower-case name) of every row of a category, from loops and from single items alike.

    A loop whose values do not fill its last row is an error, and so is an item without a value.
    """
    prefix, block = f"{category.lower()}.", ""
    single: dict[str, str | None] = {}
    names: list[str] = []
    row: list[str | None] = []
    in_loop = heading = False
    pending: str | None = None

    def wanted(all_names):
        return [(k, n.lower().removeprefix(prefix)) for k, n in enumerate(all_names) if n.lower().startswith(prefix)]

    def close():
        if in_loop and row:
            raise ValueError(f"a loop of {names[0] if names else 'no names'} ends within a row")
        if pending is not None:
            raise ValueError(f"{pending} has no value")

    keep: list[tuple[int, str]] = []
    for bare, value in tokens(text):
        low = value.lower() if bare else ""
        if bare and (low == "loop_" or low.startswith(("data_", "save_", "global_")) or (value.startswith("_") and not heading)):
            close()
            if not value.startswith("_"):
                in_loop = heading = low == "loop_"
                names, row, pending = [], [], None
                if low.startswith("data_"):
                    if single:
                        yield block, single
                        single = {}
                    block = value[5:]
            else:
                in_loop, pending = False, value
        elif bare and heading and value.startswith("_"):
            names.append(value)
        elif in_loop:
            if heading:
                heading, keep = False, wanted(names)
                if not names:
                    raise ValueError("a loop has no names")
            row.append(value)
            if len(row) == len(names):
                if keep:
                    yield block, {n: row[k] for k, n in keep}
                row = []
        elif pending is not None:
            if pending.lower().startswith(prefix):
                single[pending.lower().removeprefix(prefix)] = value
            pending = None
        else:
            raise ValueError(f"a value without a name: {value}")
    close()
    if single:
        yield block, single


def read_star(spark: SparkSession, path: str | list[str], category: str, columns: list[str], required: bool = False) -> DataFrame:
    """(path, block, columns): the rows of a category such as _atom_site, with the named items as strings, null where a file lacks one.

    Files are read whole, one a row, by Spark, so that any of its file systems and gzipped files do; only the named items leave the tokeniser. With
    required, a file without a row of the category is an error.
    """
    lower = [c.lower() for c in columns]

    def run(batches):
        for b in batches:
            for file, text in zip(b.column("path").to_pylist(), b.column("value").to_pylist()):
                blocks, found = [], []
                for block, values in category_rows(text, category):
                    blocks.append(block)
                    found.append([values.get(c) for c in lower])
                if required and not found:
                    raise ValueError(f"{file} has no row of {category}")
                for k in range(0, len(found), 65536):
                    part = found[k : k + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part), pa.string()), pa.array(blocks[k : k + 65536], pa.string()), *(pa.array(c, pa.string()) for c in zip(*part))], ["path", "block", *columns])

    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.mapInArrow(run, ", ".join(["path string", "block string", *[f"`{c}` string" for c in columns]]))
