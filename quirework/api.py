"""Functions for one book or a few: what a caller of a reading library expects, on top of ``Library``."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from quirework.functions import opf
from quirework.operators.library import METADATA, Library


class Book:
    """One book, opened lazily: nothing is read before the first question, and answers are kept."""

    def __init__(self, spark: SparkSession, source, name: str = "book.epub"):
        """``source`` is a path, the archive's bytes, or anything with ``read()`` that gives them."""
        if hasattr(source, "read"):
            source = source.read()
        self._library = Library.read(spark, source, pattern=None) if isinstance(source, str) else Library.from_bytes(spark, [(name, source)])
        self._kept: dict = {}

    def _once(self, key: str, make):
        if key not in self._kept:
            self._kept[key] = make()
        return self._kept[key]

    def _checked(self) -> dict:
        row = self._once("package", lambda: self._library.packages().first())
        if row is None:
            raise opf.BookError("MissingFile", "there is no such book")
        if row.error_kind:
            raise opf.BookError(row.error_kind, row.error_msg)
        return row.asDict(recursive=True)

    def get_metadata(self) -> dict:
        self._checked()
        return {k: v for k, v in self._once("metadata", lambda: self._library.metadata().first().asDict(recursive=True)).items() if k in METADATA}

    def get_metadata_json(self) -> str:
        return json.dumps(self.get_metadata(), ensure_ascii=False)

    def validate_metadata(self) -> list[str]:
        self._checked()
        return self._once("validation", lambda: list(self._library.validation().first().errors))

    def get_metadata_is_valid(self) -> bool:
        return not self.validate_metadata()

    def get_title(self) -> str:
        return self.get_metadata()["title"] or ""

    def get_chapter_count(self) -> int:
        return self.get_metadata()["chapter_count"]

    def extract_chapters(self, with_ast: bool = False) -> list[dict]:
        self._checked()
        rows = self._once(f"chapters{with_ast}", lambda: sorted(self._library.chapters(with_ast=with_ast).collect(), key=lambda r: r.spine_pos))
        return [r.asDict() | {"ast": json.loads(r.ast) if r.ast else None} for r in rows]

    def extract_text_only(self) -> list[str]:
        return [c["content"] for c in self.extract_chapters()]

    def extract_ast(self) -> list[dict]:
        return self.extract_chapters(with_ast=True)

    extract_with_ast = extract_ast

    def stream_chapters(self):
        """Chapters one after the other with their errors, as the stream policy gives them."""
        self._checked()
        yield from self._library.chapters("report").orderBy("spine_pos").toLocalIterator()

    def get_chapters_text(self) -> str:
        return json.dumps(self.extract_text_only(), ensure_ascii=False)

    def get_chapter(self, number: int) -> dict:
        chapters = self.extract_ast()
        if not 0 <= number < len(chapters):
            raise opf.BookError("ChapterError", "Chapter index out of bounds")
        return chapters[number]

    def get_chapters_text_json(self) -> str:
        return self.get_chapters_text()

    def get_chapter_text(self, number: int) -> str:
        self._checked()
        texts = self._kept.get("chaptersFalse") or self._kept.get("chaptersTrue")
        if texts is not None:
            row = texts[number] if 0 <= number < len(texts) else None
        else:
            row = self._once(f"text{number}", lambda: self._library.chapter(number).first())
        if row is None:
            raise opf.BookError("ChapterError", "Chapter index out of bounds")
        return row["content"]

    def get_chapter_json(self, number: int) -> str:
        return json.dumps(self.get_chapter(number), ensure_ascii=False)

    def get_toc(self) -> list[dict]:
        self._checked()
        return self._once("toc", lambda: [r.asDict() for r in sorted(self._library.toc().drop("book_id").collect(), key=lambda r: r.chapter_index)])

    def get_toc_json(self) -> str:
        return json.dumps(self.get_toc(), ensure_ascii=False)

    def total_word_count(self) -> int:
        return sum(c["word_count"] for c in self.extract_chapters())

    def total_char_count(self) -> int:
        return sum(c["char_count"] for c in self.extract_chapters())

    get_total_word_count, get_total_char_count = total_word_count, total_char_count

    def has_cover(self) -> bool:
        return self.get_metadata()["has_cover"]

    def get_cover_image(self) -> bytes:
        self._checked()
        row = self._once("cover", lambda: self._library.covers().first())
        if row.error_kind:
            raise opf.BookError(row.error_kind, row.error_msg)
        return bytes(row.data)

    def get_cover_image_json(self) -> str:
        return json.dumps(list(self.get_cover_image()))

    def get_cover_image_len(self) -> int:
        return len(self.get_cover_image()) if self.has_cover() else 0

    def get_cover_image_format(self) -> str:
        return self.get_metadata()["cover_image_format"] or ""

    def cover_image_to_writer(self, writer) -> int:
        return writer.write(self.get_cover_image())

    def read_resource(self, name: str) -> bytes:
        row = self._library.read_resource(name).first()
        if row is None or row.error_kind or row.data is None:
            raise opf.BookError(row.error_kind if row is not None and row.error_kind else "MissingFile", name)
        return bytes(row.data)

    get_resource = read_resource

    def read_file_to_writer(self, name: str, writer) -> int:
        return writer.write(self.read_resource(name))

    def get_resource_json(self, name: str) -> str:
        return json.dumps(list(self.read_resource(name)))

    def _wanted(self, number: int, href: str):
        books = self._library.books
        from pyspark.sql import functions as F

        return books.select("book_id", F.lit(number).cast("bigint").alias("chapter_index"), F.lit(href).alias("href"))

    def resolve_chapter_resource_path(self, number: int, href: str) -> str:
        row = self._library.resolve(self._wanted(number, href)).first()
        if row.error_kind:
            raise opf.BookError(row.error_kind, "Chapter index out of bounds")
        return row.path

    def read_chapter_resource(self, number: int, href: str) -> bytes:
        row = self._library.read_chapter_resource(self._wanted(number, href)).first()
        if row.error_kind:
            raise opf.BookError(row.error_kind, href)
        return bytes(row.data)

    get_chapter_resource = read_chapter_resource

    def get_chapter_resource_json(self, number: int, href: str) -> str:
        return json.dumps(list(self.read_chapter_resource(number, href)))

    def page_number(self, wanted, current: int = 0) -> int:
        """A chapter number within bounds: what isn't a number stays where it is, the ends hold."""
        try:
            wanted = int(wanted)
        except (TypeError, ValueError):
            wanted = current
        return max(0, min(wanted, len(self.extract_chapters()) - 1))

    def rendered(self, number: int) -> str:
        """Safe markup of a chapter with its styles; paragraphs of its text where it has no tree."""
        from html import escape

        from quirework.functions import html

        chapter = self.get_chapter(number)
        if not chapter["ast"]:
            return "".join(f"<p>{escape(p)}</p>" for p in chapter["content"].split("\n"))
        nodes, styles, stack = html.from_tree(chapter["ast"]), {}, [chapter["ast"]]
        for i in range(len(nodes)):
            node = stack.pop()
            styles[i] = node.get("styles") or {}
            stack.extend(reversed(node.get("children", ())))
        return html.rendered(nodes, styles)

    def analyze(self) -> dict:
        """Metadata, chapter_count, total_words, total_chars and first_chapter_preview, from one pass over the archive."""
        self._checked()
        row = self._once("analysis", lambda: self._library.analysis().first().asDict(recursive=True))
        return {"metadata": {k: row[k] for k in METADATA}, "chapter_count": row["n_chapters"], "total_words": row["total_words"], "total_chars": row["total_chars"], "first_chapter_preview": row["first_chapter_preview"]}

    def report(self) -> str:
        """A plain report of metadata, statistics and the beginning of the text."""
        errors, meta, texts = self.validate_metadata(), self.get_metadata(), self.extract_text_only()
        lines = ["About the book", "  complete: " + ("yes" if not errors else f"no ({', '.join(errors)})")]
        for label, key in (("Version", "version"), ("Has cover", "has_cover"), ("Cover format", "cover_image_format"), ("Title", "title"), ("Authors", "authors"), ("Languages", "languages"), ("Publisher", "publisher"), ("Publication date", "publication_date")):
            value = meta[key]
            if key == "title":
                value = value or "no title"
            if value not in (None, []):
                lines.append(f"  {label.lower()}: {', '.join(value) if isinstance(value, list) else value}")
        lines += ["", "Its text", f"  chapters: {len(texts)}", f"  words: {self.total_word_count()}", f"  characters: {self.total_char_count()}"]
        if texts:
            lines += ["", "It begins", "  " + texts[0][:300].strip()]
        lines += ["", f"Node trees: {len(self.extract_ast())}"]
        return "\n".join(lines)


def extract_text_only(spark: SparkSession, path: str) -> list[str]:
    return Book(spark, path).extract_text_only()


def extract_ast(spark: SparkSession, path: str) -> list[dict]:
    return Book(spark, path).extract_ast()


def get_metadata(spark: SparkSession, path: str) -> dict:
    return Book(spark, path).get_metadata()


def analyze_path(spark: SparkSession, path: str) -> dict:
    """The analysis report of a book: metadata, number of chapters, sums, and the beginning of the first chapter."""
    return Book(spark, path).analyze()


def analyze_reader(spark: SparkSession, reader) -> dict:
    """The analysis report of a book from anything with ``read()``."""
    return Book(spark, reader).analyze()


analyze_sync_reader = analyze_reader


def main(arguments: list[str] | None = None) -> int:
    """``python -m quirework.api BOOK``: print the report of a book."""
    import os
    import sys

    arguments = sys.argv[1:] if arguments is None else arguments
    if len(arguments) != 1 or not os.path.exists(arguments[0]):
        print("usage: python -m quirework.api BOOK" if len(arguments) != 1 else f"no such file: {arguments[0]}")
        return 1
    spark = SparkSession.builder.getOrCreate()
    try:
        print(Book(spark, arguments[0]).report())
    except opf.BookError as error:
        print(f"{error.kind}: {error}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
