"""A library of e-books as lazily evaluated DataFrames.

Every book is opened in one task and once: a single Python pass reads container, package document and - where they are wanted - the spine's
chapters straight from the archive's directory, so only needed entries are decompressed and no binary is ever shuffled. What
follows (projections, aggregates, link resolution) is DataFrame expressions keyed by ``book_id``.

Errors are data: a book that can't be read has ``error_kind`` and ``error_msg`` in ``packages()`` and no rows elsewhere. Chapters follow
one of three policies: ``skip`` leaves out missing, undecodable and unparsable files; ``report`` keeps a row with the error for a missing file
and replaces invalid bytes; ``lossy`` leaves out missing files and replaces invalid bytes. Spine items that the manifest
doesn't have are left out by all three.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import css, html, links, opf, text
from quirework.sources import epub

CONTAINER = "META-INF/container.xml"
LINKS = 1024  # chapters of a book whose links are answered at once
_LISTS = "authors array<string>, languages array<string>, subjects array<string>, identifiers array<string>, contributors array<string>"
PACKAGES = (
    "book_id string, path string, opf_path string, version string, title string, description string, publisher string, publication_date string, rights string, "
    f"{_LISTS}, spine array<string>, manifest array<struct<pos int, item_id string, href string, media_type string, properties string>>, cover_image_id string, error_kind string, error_msg string"
)
CHAPTERS = (
    "book_id string, spine_pos int, chapter_index bigint, id string, href string, media_type string, title string, content string, "
    "word_count bigint, char_count bigint, ast string, error_kind string, error_msg string"
)
METADATA = [
    "title", "version", "authors", "description", "languages", "subjects", "publisher", "publication_date", "identifiers", "rights", "contributors",
    "spine", "has_cover", "cover_image_format", "chapter_count",
]
NODES = (
    "book_id string, chapter_index bigint, node_id int, parent_id int, child_pos int, depth int, kind string, tag string, "
    "attrs map<string,string>, styles map<string,string>, content string"
)
PIECE = 4096  # rows of nodes or rules that leave a Python pass at once
RULES = (
    "book_id string, sheet_pos int, href string, rule_id int, parent_rule_id int, kind string, selectors string, query string, name string, declarations map<string,string>, content string"
)
_MAP = pa.map_(pa.string(), pa.string())
#: the same as Arrow schemas, for passes whose rows leave in pieces
BOOKS = pa.schema([("book_id", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
_NODES = pa.schema([
    ("book_id", pa.string()), ("chapter_index", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("child_pos", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("tag", pa.string()),
    ("attrs", _MAP), ("styles", _MAP), ("content", pa.string()),
])
_RULES = pa.schema([
    ("book_id", pa.string()), ("sheet_pos", pa.int32()), ("href", pa.string()), ("rule_id", pa.int32()), ("parent_rule_id", pa.int32()), ("kind", pa.string()), ("selectors", pa.string()), ("query", pa.string()),
    ("name", pa.string()), ("declarations", _MAP), ("content", pa.string()),
])


def in_pieces(rows: Iterable[tuple], schema: pa.Schema, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``size``, so that a pass holds no more, however many rows its input makes."""
    left = iter(rows)
    while piece := list(islice(left, size)):
        columns = ([None if x is None else list(x.items()) for x in c] if kind == _MAP else c for c, kind in zip(zip(*piece), schema.types))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, schema.types)], schema=schema)


class Archive:
    """One opened archive: the first entry of a name counts."""

    def __init__(self, content: bytes | None):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content or b""))
        except Exception as error:
            raise opf.BookError("Zip", str(error)) from None
        self.first: dict[str, zipfile.ZipInfo] = {}
        for info in self.zip.infolist():
            self.first.setdefault(info.filename, info)

    def read(self, name: str) -> bytes:
        if name not in self.first:
            raise opf.BookError("MissingFile", name)
        try:
            return self.zip.read(self.first[name])
        except Exception as error:
            raise opf.BookError("Zip", str(error)) from None

    def package(self) -> tuple[str, dict]:
        path = opf.parse_container(self.read(CONTAINER))
        return path, opf.parse_package(self.read(path))


def joined(opf_path: str, href: str) -> str:
    """Path of a manifest link beside its package document; ``..`` isn't resolved."""
    folder = opf_path.rpartition("/")[0]
    return href if href.startswith("/") or not folder else f"{folder}/{href}"


def resolved(base_file: str, href: str) -> str:
    """A link against the file it stands in; the Python twin of ``links.resolved`` for trees."""
    if not href.strip():
        return base_file
    if href.startswith(("#", "http://", "https://", "mailto:", "data:", "blob:")):
        return href
    path, mark, fragment = href.partition("#")
    folder = base_file.rpartition("/")[0]
    full = path if path.startswith(("/", "\\")) or not folder else f"{folder}/{path}"
    done: list[str] = []
    for step in full.replace("\\", "/").split("/"):
        if step == "..":
            del done[-1:]
        elif step not in ("", "."):
            done.append(step)
    return "/".join(done) + mark + fragment


def resolve_in(nodes: list[list], href: str) -> None:
    """Links of a tree against the file it stands in."""
    for node in nodes:
        for k in ("href", "src"):
            if node[3] and k in node[3]:
                node[3][k] = resolved(href, node[3][k])


def style_sheets(archive: Archive, opf_path: str, package: dict) -> list[tuple[int, str, str]]:
    """(manifest position, href, text) of the readable style sheets, in manifest order."""
    out = []
    for pos, (_, href, media_type, _) in enumerate(package["manifest"]):
        if media_type == "text/css":
            try:
                out.append((pos, href, archive.read(joined(opf_path, href)).decode("utf-8", "replace")))
            except opf.BookError:
                continue
    return out


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Archive, str, dict]]:
    """(book, archive, path of the package document, package) of the books that can be read, one after another."""
    for batch in batches:
        for book, content in zip(batch.column("book_id"), batch.column("content")):
            try:
                archive = Archive(content.as_py())
                opf_path, package = archive.package()
            except opf.BookError:
                continue
            yield book.as_py(), archive, opf_path, package


def readable(archive: Archive, opf_path: str, package: dict, policy: str, scanner: bool = False, problems: list | None = None, texts: bool = True) -> Iterator[tuple]:
    """(spine position, id, href, media type, nodes or None, text or None) of the chapters that a policy keeps, in spine order; missing files go to ``problems``."""
    manifest = {item: (href, kind) for item, href, kind, _ in package["manifest"]}
    for pos, idref in enumerate(package["spine"]):
        if idref not in manifest:
            continue
        href = joined(opf_path, manifest[idref][0])
        try:
            markup = archive.read(href).decode("utf-8", "strict" if policy == "skip" else "replace")
            nodes = None if scanner else html.parse(markup)
        except opf.BookError as error:
            if problems is not None:
                problems.append((pos, href, error))
            continue
        except (UnicodeDecodeError, AssertionError):
            continue
        yield pos, idref, href, manifest[idref][1], nodes, scanned(markup) if scanner else html.text_of(nodes) if texts else None


class Library:
    """Operators over a DataFrame of books (``book_id, path, length, content``)."""

    def __init__(self, books: DataFrame):
        self.books = books

    @classmethod
    def read(cls, spark, *paths: str, pattern: str | None = "*.epub") -> Library:
        return cls(epub.read_books(spark, *paths, pattern=pattern))

    @classmethod
    def from_bytes(cls, spark, books) -> Library:
        return cls(epub.books_from_bytes(spark, books))

    # sources -------------------------------------------------------------------------------------------------------

    def entries(self, wanted=None) -> DataFrame:
        return epub.entries(self.books, wanted)

    def read_resource(self, name: str) -> DataFrame:
        """(book_id, data, error_kind) of one entry of every book; only that entry is decompressed."""
        return epub.read_entry(self.entries([name]), name)

    def packages(self) -> DataFrame:
        """One row per book: its package document, or the error that prevented reading it."""
        columns = [c.strip().split(" ")[0] for c in PACKAGES.replace("array<struct<pos int, item_id string, href string, media_type string, properties string>>", "x").split(",")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for book, path, content in zip(batch["book_id"], batch["path"], batch["content"]):
                    row = dict.fromkeys(columns) | {"book_id": book, "path": path}
                    try:
                        row["opf_path"], package = Archive(content).package()
                        package["manifest"] = [{"pos": i, "item_id": a, "href": b, "media_type": c, "properties": d} for i, (a, b, c, d) in enumerate(package["manifest"])]
                        row |= package
                    except opf.BookError as error:
                        row |= {"error_kind": error.kind, "error_msg": str(error)} | {c: [] for c in ("authors", "languages", "subjects", "identifiers", "contributors", "spine", "manifest")}
                    rows.append(row)
                yield pd.DataFrame(rows, columns=columns)

        return self.books.select("book_id", "path", "content").mapInPandas(run, PACKAGES)

    # projections ---------------------------------------------------------------------------------------------------

    def metadata(self) -> DataFrame:
        """The fifteen metadata fields of every readable book, with book_id and opf_path."""
        last = F.element_at(F.filter("manifest", lambda m: m["item_id"] == F.col("cover_image_id")), -1)
        found = F.size(F.filter("manifest", lambda m: m["item_id"] == F.col("cover_image_id"))) > 0
        full = self.packages().where("error_kind IS NULL").select(
            "*", F.col("cover_image_id").isNotNull().alias("has_cover"), F.when(found, last["media_type"]).alias("cover_image_format"), F.size("spine").cast("bigint").alias("chapter_count")
        )
        return full.select("book_id", "path", "opf_path", *METADATA)

    def manifest(self) -> DataFrame:
        """(book_id, pos, item_id, href, media_type, properties); of equal ids the last counts."""
        rows = self.packages().select("book_id", F.explode("manifest").alias("m")).select("book_id", "m.*")
        return rows.withColumn("r", F.row_number().over(Window.partitionBy("book_id", "item_id").orderBy(F.desc("pos")))).where("r = 1").drop("r")

    def spine(self) -> DataFrame:
        return self.packages().select("book_id", F.posexplode("spine").alias("pos", "idref"))

    def validation(self) -> DataFrame:
        """(book_id, is_valid, errors): whether title, a language and an identifier are there."""
        return self.metadata().select("book_id", text.validation_errors(F.col("title"), F.col("languages"), F.col("identifiers")).alias("errors")).select("book_id", (F.size("errors") == 0).alias("is_valid"), "errors")

    def grid(self) -> DataFrame:
        """(book_id, title, has_cover): every book, also unreadable ones, by its title or its file name."""
        name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.epub$", "")
        return self.packages().select("book_id", F.coalesce("title", name).alias("title"), F.col("cover_image_id").isNotNull().alias("has_cover"))

    # chapters ------------------------------------------------------------------------------------------------------

    def chapters(self, policy: str = "skip", with_ast: bool = False, scanner: bool = False) -> DataFrame:
        """Chapters in spine order under an error policy; ``with_ast`` adds the styled tree with resolved links as JSON.

        ``scanner`` takes the low-memory text form, which knows no entities. Text-only plans parse no style sheets.
        """
        if policy not in ("skip", "report", "lossy"):
            raise ValueError(f"unknown policy {policy!r}")
        names = [c.split(" ")[0] for c in CHAPTERS.split(", ")]

        def one(book: str, content: bytes) -> list[tuple]:
            rows: list[tuple] = []
            try:
                archive = Archive(content)
                opf_path, package = archive.package()
            except opf.BookError:
                return rows
            sheet = css.rules("".join(f"{s}\n" for _, _, s in style_sheets(archive, opf_path, package))) if with_ast else []
            problems: list[tuple] | None = [] if policy == "report" else None
            for index, (pos, idref, href, kind, nodes, body) in enumerate(readable(archive, opf_path, package, policy, scanner and not with_ast, problems)):
                shown, kind = ("", "application/xhtml+xml") if policy == "report" else (idref, kind)
                title = tree = None
                if policy != "report":
                    first = next(iter(body.split("\n")), "").strip() or None
                    title = (html.title_of(nodes) if with_ast else None) or first
                if with_ast:
                    resolve_in(nodes, href)
                    tree = json.dumps(html.to_tree(nodes, css.cascade(nodes, sheet)), ensure_ascii=False)
                rows.append((book, pos, index, shown, href, kind, title, body, len(body.split()), len(body), tree, None, None))
            rows += [(book, pos, None, "", href, "application/xhtml+xml", None, None, None, None, None, error.kind, str(error)) for pos, href, error in problems or ()]
            return sorted(rows, key=lambda r: r[1])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for book, content in zip(batch["book_id"], batch["content"]):
                    yield pd.DataFrame(one(book, content), columns=names).astype({"spine_pos": "Int32", "chapter_index": "Int64", "word_count": "Int64", "char_count": "Int64"})

        return self.books.select("book_id", "content").mapInPandas(run, CHAPTERS)

    def kept(self) -> Library:
        """The same library with its books persisted, for several questions about one set; without it each question reads anew."""
        return Library(self.books.persist())

    def kept_chapters(self, policy: str = "skip", with_ast: bool = False) -> DataFrame:
        """Chapters persisted in their own, small form, for several questions about them; archives are not kept."""
        return self.chapters(policy, with_ast).persist()

    def texts(self) -> DataFrame:
        """(book_id, chapter_index, content)."""
        return self.chapters().select("book_id", "chapter_index", "content")

    def chapter(self, number: int, with_ast: bool = False) -> DataFrame:
        """The chapter of that index of every book that has one."""
        return self.chapters(with_ast=with_ast).where(F.col("chapter_index") == number)

    def toc(self) -> DataFrame:
        """(book_id, chapter_index, chapter_id, chapter_href, title)."""
        return table_of_contents(self.chapters().withColumn("chapter_id", F.col("id")).withColumn("chapter_href", F.col("href")))

    def totals(self) -> DataFrame:
        """(book_id, chapters, words, chars) of the readable chapters, in one aggregate."""
        return book_totals(self.chapters())

    def analysis(self) -> DataFrame:
        """Metadata, number of chapters, sums and the beginning of the first chapter, one row per readable book; every archive is opened once."""
        fields = {"manifest": "x", "cover_image_id": "x"}
        names = ["book_id", "path", "opf_path", *METADATA, "n_chapters", "total_words", "total_chars", "first_chapter_preview"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for book, path, content in zip(batch["book_id"], batch["path"], batch["content"]):
                    try:
                        archive = Archive(content)
                        opf_path, package = archive.package()
                    except opf.BookError:
                        continue
                    texts = [(len(body.split()), len(body), body) for *_, body in readable(archive, opf_path, package, "lossy")]
                    cover, kinds = package["cover_image_id"], {item: kind for item, _, kind, _ in package["manifest"]}
                    row = {k: v for k, v in package.items() if k not in fields} | {
                        "book_id": book, "path": path, "opf_path": opf_path, "has_cover": cover is not None, "cover_image_format": kinds.get(cover), "chapter_count": len(package["spine"]), "n_chapters": len(texts),
                        "total_words": sum(t[0] for t in texts), "total_chars": sum(t[1] for t in texts), "first_chapter_preview": texts[0][2][:300] if texts else None,
                    }
                    rows.append(row)
                yield pd.DataFrame(rows, columns=names)

        scalars = "title version description publisher publication_date rights cover_image_format".split()
        kinds = {c: "string" for c in ("book_id", "path", "opf_path", *scalars, "first_chapter_preview")} | {"has_cover": "boolean"} | dict.fromkeys(("chapter_count", "n_chapters", "total_words", "total_chars"), "bigint")
        return self.books.select("book_id", "path", "content").mapInPandas(run, ", ".join(f"{c} {kinds.get(c, 'array<string>')}" for c in names))

    # trees and style sheets -----------------------------------------------------------------------------------------

    def ast_nodes(self, styled: bool = True, only: str | None = None) -> DataFrame:
        """The trees of all chapters, one row per node, in document order, with the chapter's id as ``chapter_id``.

        Without ``styled`` no style sheet is parsed and styles are null; ``only`` is the one kind of nodes that leaves the pass.
        """
        schema = _NODES.append(pa.field("chapter_id", pa.string()))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for book, archive, opf_path, package in opened(batches):
                sheet = css.rules("".join(f"{s}\n" for _, _, s in style_sheets(archive, opf_path, package))) if styled else []
                for index, (_, idref, href, _, nodes, _) in enumerate(readable(archive, opf_path, package, "skip", texts=False)):
                    resolve_in(nodes, href)
                    styles = css.cascade(nodes, sheet) if styled else {}
                    depths, below = [0] * len(nodes), [0] * len(nodes)
                    for i, (parent, kind, tag, attributes, content) in enumerate(nodes):
                        place = 0
                        if parent is not None:
                            depths[i], place = depths[parent] + 1, below[parent]
                            below[parent] += 1
                        if only in (None, kind):
                            yield book, index, i, parent, place, depths[i], kind, tag, attributes, styles.get(i), content, idref

        return self.books.select("book_id", "content").mapInArrow(lambda batches: in_pieces(rows(batches), schema), f"{NODES}, chapter_id string")

    def css_rules(self) -> DataFrame:
        """The rules of all style sheets, in manifest and source order; rules inside media and supports blocks name their parent."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for book, archive, opf_path, package in opened(batches):
                for pos, href, source in style_sheets(archive, opf_path, package):
                    for r in css.rules(source):
                        yield book, pos, href, r["rule"], r["parent"], r["kind"], r["selectors"], r["query"], r["name"], r["declarations"], r["content"]

        return self.books.select("book_id", "content").mapInArrow(lambda batches: in_pieces(rows(batches), _RULES), RULES)

    # covers and resources -------------------------------------------------------------------------------------------

    def covers(self) -> DataFrame:
        """(book_id, media_type, data, size, error_kind, error_msg): every readable book's cover, or why it has none."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for book, content in zip(batch["book_id"], batch["content"]):
                    kind = data = error = None
                    try:
                        archive = Archive(content)
                        opf_path, package = archive.package()
                        items = {item: (href, media_type) for item, href, media_type, _ in package["manifest"]}
                        cover = package["cover_image_id"]
                        if cover is None:
                            raise opf.BookError("MissingFile", "the book has no cover image")
                        if cover not in items:
                            raise opf.BookError("MissingFile", f"the cover {cover!r} is not in the manifest")
                        kind = items[cover][1]
                        data = archive.read(joined(opf_path, items[cover][0]))
                    except opf.BookError as problem:
                        error = problem
                    rows.append((book, kind, data, None if data is None else len(data), error and error.kind, error and str(error)))
                yield pd.DataFrame(rows, columns=["book_id", "media_type", "data", "size", "error_kind", "error_msg"]).astype({"size": "Int64"})

        return self.books.select("book_id", "content").mapInPandas(run, "book_id string, media_type string, data binary, size bigint, error_kind string, error_msg string")

    def _by_link(self, wanted: DataFrame, with_data: bool) -> DataFrame:
        """Links answered inside the pass that opens their book: only wanted books are joined, each of them is opened once for up to ``LINKS`` chapters' links."""
        asked = wanted.select("book_id", F.struct("chapter_index", "href").alias("w"), F.expr(f"chapter_index div {LINKS}").alias("part")).groupBy("book_id", "part").agg(F.collect_set("w").alias("wanted"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for book, content, links_ in zip(batch["book_id"], batch["content"], batch["wanted"]):
                    rows, archive, files = [], None, None
                    try:
                        archive = Archive(content)
                    except opf.BookError as problem:
                        broken = problem.kind
                    for one in links_:
                        index, href, path, data, error = one["chapter_index"], one["href"], None, None, None
                        index = None if index is None or index != index else int(index)  # pandas has no null among integers
                        if archive is None:
                            error = broken
                        elif href is not None:
                            path, known = found_path(archive.first, href)
                            if not known:
                                if files is None:
                                    try:
                                        files = [x[2] for x in readable(archive, *archive.package(), "skip")]
                                    except opf.BookError:
                                        files = []
                                if index is not None and 0 <= index < len(files):
                                    path = resolved(files[index], href)
                                else:
                                    path, error = None, "ChapterError"
                            if with_data and error is None:
                                try:
                                    data = archive.read(path.partition("#")[0])
                                except opf.BookError as problem:
                                    error = problem.kind
                        rows.append((book, index, href, path, data, error))
                    yield pd.DataFrame(rows, columns=["book_id", "chapter_index", "href", "path", "data", "error_kind"]).astype({"chapter_index": "Int64"})

        schema = "book_id string, chapter_index bigint, href string, path string, data binary, error_kind string"
        return self.books.select("book_id", "content").join(asked, "book_id").select("book_id", "content", "wanted").mapInPandas(run, schema)

    def resolve(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (book_id, chapter_index, href) with ``path`` and ``error_kind``, one row per different link: see ``resolve_links`` for the rules."""
        return self._by_link(wanted, False).drop("data")

    def read_chapter_resource(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (book_id, chapter_index, href) with ``data`` and ``error_kind``, one row per different link; external links and fragments are missing files."""
        return self._by_link(wanted, True).drop("path")

    def showcase(self) -> DataFrame:
        """(book_id, title, has_cover, media_type, data): every book, also unreadable ones, with its cover; null data asks for a placeholder."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for book, path, content in zip(batch["book_id"], batch["path"], batch["content"]):
                    title = kind = data = None
                    has = False
                    try:
                        archive = Archive(content)
                        opf_path, package = archive.package()
                        title, cover = package["title"], package["cover_image_id"]
                        has = cover is not None
                        items = {item: (href, media_type) for item, href, media_type, _ in package["manifest"]}
                        if cover in items:
                            data, kind = archive.read(joined(opf_path, items[cover][0])), items[cover][1]
                    except opf.BookError:
                        pass
                    name = path.rpartition("/")[2]
                    rows.append((book, title or (name[:-5] if name.lower().endswith(".epub") else name), has, kind, data))
                yield pd.DataFrame(rows, columns=["book_id", "title", "has_cover", "media_type", "data"])

        return self.books.select("book_id", "path", "content").mapInPandas(run, "book_id string, title string, has_cover boolean, media_type string, data binary")

    # sinks ---------------------------------------------------------------------------------------------------------

    def write_resources(self, folder: str, wanted=None) -> None:
        """Write the entries' bytes as a table (path, size and data), the sink for covers and resources of whole libraries."""
        self.entries(wanted).where("data IS NOT NULL").write.mode("overwrite").parquet(folder)


def found_path(names, href: str) -> tuple[str, bool]:
    """(path, whether it is settled) of a link by what exists in the book; the Python twin of the first forms of ``resolve_links``."""
    clean = href.strip()
    if clean == "" or clean.startswith(("#", "http://", "https://", "mailto:", "data:", "blob:")):
        return clean, True
    pieces = clean.split("#")
    if pieces[0] in names:
        return clean.replace("\\", "/"), True
    normal = resolved("", "/" + pieces[0])
    return (normal + (f"#{pieces[1]}" if len(pieces) > 1 else ""), True) if normal in names else (normal, False)


def scanned(markup: str) -> str:
    """Python twin of ``text.markup_text`` for text that is at hand already."""
    import re

    marked = re.sub(r"<\s*/*(?:p|div|br|h|li)[^>]*>", "\x01", markup, flags=re.I)
    bare = re.sub(r"\s+", " ", re.sub(r"<[^>]*(?:>|$)", "", marked))
    return "\n".join(x for x in (line.strip() for line in bare.split("\x01")) if x)


# operators over tables of chapters, manifests and links, of whatever origin ------------------------------------------


def spine_manifest(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book_id, pos, idref, href, media_type): spine items with their manifest item, in the spine's positions.

    Items that the manifest lacks are left out, repeated ones stay, of several manifest items with one id the last counts. Both sides
    are partitioned by book and item, so one hot book spreads over many tasks.
    """
    last = manifest.groupBy("book_id", "item_id").agg(F.max_by(F.struct("href", "media_type"), "pos").alias("m"))
    return spine.join(last, (spine["book_id"] == last["book_id"]) & (spine["idref"] == last["item_id"])).select(spine["book_id"], spine["pos"], "idref", "m.href", "m.media_type")


def table_of_contents(chapters: DataFrame) -> DataFrame:
    return chapters.select("book_id", "chapter_index", "chapter_id", "chapter_href", text.toc_title(F.col("title"), F.col("chapter_href")).alias("title"))


def dense_index(chapters: DataFrame, name: str = "chapter_index", block: int = 1024) -> DataFrame:
    """Chapters with their number from 0 in spine order within the book, without gaps.

    A book is numbered in blocks of spine positions with summed offsets, so that a book with most of the rows spreads over many tasks.
    """
    rows = chapters.withColumn("__block", F.expr(f"spine_pos div {block}"))
    own = F.row_number().over(Window.partitionBy("book_id", "__block").orderBy("spine_pos")) - 1
    before = F.sum("__n").over(Window.partitionBy("book_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy("book_id", "__block").agg(F.count("*").alias("__n")).select("book_id", "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    keep = [c for c in chapters.columns if c != name]
    return rows.withColumn("__own", own).join(sizes, ["book_id", "__block"]).select(*(F.col(f"`{c}`") for c in keep), (F.col("__before") + F.col("__own")).cast("bigint").alias(name))


def book_totals(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book_id").agg(F.count("*").alias("n_chapters"), F.sum("word_count").cast("bigint").alias("total_words"), F.sum("char_count").cast("bigint").alias("total_chars"))


def analysis_of(chapters: DataFrame) -> DataFrame:
    """Number of chapters, sums, and the first 300 characters of the first chapter of every book; one map-side-combined aggregate."""
    return chapters.groupBy("book_id").agg(
        F.count("*").alias("n_chapters"), F.sum("word_count").cast("bigint").alias("total_words"), F.sum("char_count").cast("bigint").alias("total_chars"),
        F.min_by(text.preview(F.col("content")), "spine_pos").alias("first_chapter_preview"),
    )


def resolve_links(wanted: DataFrame, names: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_index, href, path, error_kind) of links by what exists in the book.

    ``names`` is (book_id, entry_path), ``chapters`` (book_id, chapter_index, chapter_href). External links stay as they are, trimmed. A
    link whose path is an entry keeps its form with forward slashes; one whose normal form is an entry takes that; any
    other is resolved against its chapter's file. A chapter index without a chapter is an error only then.
    """
    known = names.select(F.col("book_id").alias("__book"), F.col("entry_path").alias("__entry")).distinct()
    clean = F.regexp_replace("href", r"(?U)^\s+|\s+$", "")
    rows = wanted.select("book_id", "chapter_index", "href").withColumn("__clean", clean).withColumn("__raw", F.regexp_replace("__clean", r"(?s)#.*$", "")).withColumn("__normal", links.normal_path(F.col("__raw")))
    for name in ("__raw", "__normal"):
        hit = known.select(F.col("__book").alias(f"{name}_book"), F.col("__entry").alias(f"{name}_entry"))
        rows = rows.join(hit, (F.col("book_id") == F.col(f"{name}_book")) & (F.col(name) == F.col(f"{name}_entry")), "left")
    rows = rows.join(chapters, ["book_id", "chapter_index"], "left")
    # of several fragments, the text between the first and the second mark is kept
    second = F.split("__clean", "#")
    fragment = F.when(F.size(second) > 1, F.concat(F.lit("#"), F.try_element_at(second, F.lit(2)))).otherwise("")
    external = links.is_external(F.col("__clean"))
    path = (
        F.when(external, F.col("__clean")).when(F.col("__raw_entry").isNotNull(), F.regexp_replace("__clean", r"\\", "/"))
        .when(F.col("__normal_entry").isNotNull(), F.concat("__normal", fragment)).otherwise(links.resolved(F.col("chapter_href"), F.col("href")))
    )
    failed = ~external & F.col("__raw_entry").isNull() & F.col("__normal_entry").isNull() & F.col("chapter_href").isNull()
    return rows.select("book_id", "chapter_index", "href", path.alias("path"), F.when(failed, "ChapterError").alias("error_kind"))


def link_targets(found: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, path, chapter_index, fragment): the chapter that an inner link leads to, and the place in it; of several entries of one file the last counts."""
    keyed = toc.select("book_id", links.chapter_key(F.col("chapter_href")).alias("key"), F.col("chapter_index").alias("target")).groupBy("book_id", "key").agg(F.max("target").alias("target"))
    inner = found.where(~links.is_external(F.col("path"))).withColumn("key", links.chapter_key(F.col("path")))
    fragment = F.nullif(F.coalesce(F.try_element_at(F.split("path", "#"), F.lit(2)), F.lit("")), F.lit(""))
    return inner.join(keyed, ["book_id", "key"], "left").select("book_id", "path", F.col("target").alias("chapter_index"), fragment.alias("fragment"))


def navigation(found: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, path, action, chapter_index, fragment): what following a link does - ``scroll`` to a place on the page, ``open`` outside, ``go`` to a chapter, or ``none``."""
    on_page = F.col("path").startswith("#")
    out = found.where(links.is_external(F.col("path"))).select(
        "book_id", "path", F.when(F.col("path") == "", "none").when(on_page, "scroll").otherwise("open").alias("action"), F.lit(None).cast("bigint").alias("chapter_index"),
        F.when(on_page, F.nullif(F.substring("path", 2, 1 << 30), F.lit(""))).alias("fragment"),
    )
    inner = link_targets(found, toc)
    return out.unionByName(inner.select("book_id", "path", F.when(F.col("chapter_index").isNull(), "none").otherwise("go").alias("action"), "chapter_index", F.when(F.col("chapter_index").isNotNull(), F.col("fragment")).alias("fragment")))


def flattened(chapters: DataFrame) -> DataFrame:
    """Nodes of the JSON trees of chapters, one row each, in document order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for book, index, tree in ((x.as_py() for x in row) for batch in batches for row in zip(*batch.columns)):
            stack, count = [] if tree is None else [(json.loads(tree), None, 0, 0)], 0
            while stack:
                node, parent, place, depth = stack.pop()
                yield book, index, count, parent, place, depth, node["type"], node.get("tag"), node.get("attrs"), node.get("styles"), node.get("content")
                below = node.get("children", ())
                stack.extend((c, count, i, depth + 1) for i, c in reversed(list(enumerate(below))))
                count += 1

    return chapters.select("book_id", "chapter_index", "ast").mapInArrow(lambda batches: in_pieces(rows(batches), _NODES), NODES)


def styled_alike(nodes: DataFrame, rules: DataFrame, *more: str) -> DataFrame:
    """(book_id, tag, styles, elements): the cascade as a join, for trees and rules that are tables; ``styles`` is empty where nothing matches.

    ``nodes`` is as of ``flattened``, ``rules`` as of ``Library.css_rules``. Elements of one book with the same tag, class, id and style attribute have the same styles: they are one
    row, of up to ``LINKS`` chapters, whose ``elements`` are (chapter_index, node_id) and ``more`` columns. Selectors are taken apart into tag, classes and ids; the rules of a book, which
    one archive holds, become one row that finds them by tag, so no element is compared with the rules of another tag or book.
    """

    @F.pandas_udf("array<struct<tag string, classes array<string>, ids array<string>>>")
    def parts(groups: pd.Series) -> pd.Series:
        return pd.Series([[{"tag": t, "classes": c, "ids": i} for t, c, i in css.simple_selectors(g or "")] for g in groups])

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]  # evaluated once, also inside functions of arrays

    # selectors are parsed behind the exchange, not in one more Python worker of the tasks that read archives
    top = rules.where("kind = 'style' AND parent_rule_id IS NULL").select("book_id", "sheet_pos", "rule_id", "selectors", "declarations").repartition("book_id")
    selectors = top.select("book_id", "sheet_pos", "rule_id", F.map_entries("declarations").alias("declared"), F.explode(parts("selectors")).alias("s"))
    by_tag = selectors.groupBy("book_id", F.coalesce("s.tag", F.lit("")).alias("key")).agg(F.collect_list(F.struct("sheet_pos", "rule_id", "declared", "s.classes", "s.ids")).alias("rules"))
    sheets = by_tag.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "rules"))).alias("__sheet"))

    attributes = [F.try_element_at("attrs", F.lit(c)).alias(f"__{c}") for c in ("class", "id", "style")]
    elements = nodes.where("kind = 'Element'").select("book_id", F.expr(f"chapter_index div {LINKS}").alias("__part"), "tag", *attributes, F.struct("chapter_index", "node_id", *more).alias("__element"))
    alike = elements.groupBy("book_id", "__part", "tag", "__class", "__id", "__style").agg(F.collect_list("__element").alias("elements"))
    both = F.flatten(F.filter(F.array(*(F.try_element_at("__sheet", tag) for tag in (F.col("tag"), F.lit("")))), lambda x: x.isNotNull()))

    def fits(own: Column) -> Column:
        return F.filter(both, lambda r: F.forall(r["classes"], lambda c: F.array_contains(own, c)) & F.forall(r["ids"], lambda i: F.col("__id").eqNullSafe(i)))

    found = F.sort_array(let(F.split(F.coalesce("__class", F.lit("")), r"(?U)[\s\x1c-\x1f]+"), fits))
    declared = F.concat(F.flatten(F.transform(found, lambda r: r["declared"])), text.declarations(F.col("__style")))
    last = let(declared, lambda d: F.map_from_entries(F.transform(F.sort_array(F.array_distinct(d["key"])), lambda k: F.struct(k, F.element_at(F.filter(d, lambda e: e["key"] == k), -1)["value"]))))
    return alike.join(sheets, "book_id", "left").select("book_id", "tag", last.alias("styles"), "elements")


def styled_elements(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(book_id, chapter_index, node_id, styles) of the elements to which ``styled_alike`` gives a style."""
    each = styled_alike(nodes, rules).select("book_id", "styles", F.explode("elements").alias("e"))
    return each.where(F.size("styles") > 0).select("book_id", "e.chapter_index", "e.node_id", "styles")
