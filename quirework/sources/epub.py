"""E-book archives as a distributed source: books, and their entries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.runtime import ship

BOOKS = "book_id string, path string, length bigint, content binary"
ENTRIES = "book_id string, entry_idx int, entry_path string, size bigint, data binary, error_kind string, error_msg string"
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def read_books(spark: SparkSession, *paths: str, pattern: str | None = "*.epub") -> DataFrame:
    """Books of files or directories (not recursive); lazy, nothing is opened. ``pattern`` None takes every file."""
    reader = ship(spark).read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return as_books(reader.load(list(paths)))


def as_books(files: DataFrame) -> DataFrame:
    """The books schema from the schema of binary files; the path is the book's id."""
    return files.select(F.col("path").alias("book_id"), "path", "length", "content")


def books_from_bytes(spark: SparkSession, books: Iterable[tuple[str, bytes]]) -> DataFrame:
    """Books held in memory: (name, bytes)."""
    return ship(spark).createDataFrame([(name, name, len(data), bytes(data)) for name, data in books], BOOKS)


def accepted(books: DataFrame, media_type: str | None = None) -> DataFrame:
    """Books that look like e-books by name, or by their MIME type where a column ``media_type`` tells it."""
    by_name = F.lower("path").endswith(".epub")
    return books.where(by_name | (F.coalesce(F.col(media_type), F.lit("")) == "application/epub+zip") if media_type else by_name)


def entries(books: DataFrame, wanted: Iterable[str] | None = None, endings: Iterable[str] | None = None) -> DataFrame:
    """Every file of every archive, in the archive's order; a book that can't be read is one row with an error.

    ``wanted`` and ``endings`` are names and name endings to inflate: the directory of an archive is read at its end, and only these
    entries are decompressed; the others keep their row with null data.
    """
    names = None if wanted is None else frozenset(wanted)
    ends = None if endings is None else tuple(endings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, content in zip(batch["book_id"], batch["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                        for i, info in enumerate(archive.infolist()):
                            if info.is_dir():
                                continue
                            if (names is not None and info.filename not in names) and not (ends and info.filename.endswith(ends)):
                                rows.append((book, i, info.filename, info.file_size, None, None, None))
                                continue
                            try:
                                rows.append((book, i, info.filename, info.file_size, archive.read(info), None, None))
                            except Exception as error:  # unknown compression, bad checksum, encrypted
                                rows.append((book, i, info.filename, info.file_size, None, "Zip", str(error)))
                except Exception as error:
                    rows.append((book, -1, None, None, None, "Zip", str(error)))
                yield pd.DataFrame(rows, columns=["book_id", "entry_idx", "entry_path", "size", "data", "error_kind", "error_msg"])

    return books.select("book_id", "content").mapInPandas(run, ENTRIES)


def read_entry(entries_: DataFrame, name: str) -> DataFrame:
    """(book_id, data, error_kind) of the first entry of exactly that name in every book; MissingFile where there is none."""
    first = entries_.where(F.col("entry_path") == name).groupBy("book_id").agg(F.min_by("data", "entry_idx").alias("data"), F.min_by("error_kind", "entry_idx").alias("error_kind"), F.lit(True).alias("hit"))
    books = entries_.select("book_id").distinct()
    return books.join(first, "book_id", "left").select("book_id", "data", F.when(F.col("hit").isNull(), "MissingFile").otherwise(F.col("error_kind")).alias("error_kind"))


def write_archive(files: Iterable[tuple[str, bytes]], compress: bool = True, level: int | None = None) -> bytes:
    """An archive of the given files, in order; for tests and exports of single books."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED, compresslevel=level) as archive:
        for name, data in files:
            archive.writestr(name, data)
    return out.getvalue()
