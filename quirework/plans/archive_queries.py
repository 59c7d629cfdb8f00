"""Driver queries that read real archives: the harvested tables are written as e-books in memory and read back by ``Library``, with the same in SQL on the tables.

A book is written in volumes of ``VOLUME`` spine positions, so that one with most of the chapters is many archives. Every volume has a container
with two rootfiles, a package document of the book's latest harvest, a style sheet, a cover where the manifest has one, and a chapter file for every chapter; chapters
with an error are written as what causes it: a missing file, invalid bytes, or an item that the manifest lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import html
from quirework.operators import library
from quirework.operators.library import Library
from quirework.plans.book_queries import _WS
from quirework.runtime import ship, table
from quirework.sources.epub import BOOKS, write_archive

QUERIES: dict = {}
SQL: dict[str, str] = {}
VOLUME = 64

CONTAINER = '<container><rootfiles><rootfile full-path="old.opf"/><rootfile full-path="{}"/></rootfiles></container>'
SHEET = (
    "@import url('ab.css'); /* p { color: pink } */ p { margin: 0; quotes: 'a;b' } p.line, .main { color: gray; margin: 1px } @media print { p { color: black } } "
    "#top.x { width: 9px; width: 8px } div > p { color: red } h1, { : none; top: ; padding: 2px } @font-face { font-family: F } @page :first { margin: 3cm }"
)


def _markup(title: str, content: str, pos: int) -> str:
    """A chapter file with nested, unclosed, void and upper-case elements (which are no blocks), a comment, entities, links and an own style; each line of the text is a paragraph."""
    from html import escape

    lines = "".join(f"<p class='line'>{escape(x)}</p>" for x in content.split("\n"))
    return (
        f"<!DOCTYPE html><html><head><title>{escape(title)}</title><style>p{{margin:0}}</style></head><body class='x y' id='top'><!-- {pos} --><div class=main><h1>{escape(title)}</h1>"
        f"<a href='../css/main.css#s'>&lt;{pos}&gt;</a><img src=\"fig.png\" alt='a &amp; b'><br>{lines}</i><ul><LI style='color: blue; x'>one<LI>two</ul></div></body></html>"
    )


def volumes(spark: SparkSession, folder: str) -> DataFrame:
    """Books (``book_id, path, length, content``) written from the tables, one for each volume that has a chapter."""
    ship(spark)
    lists = ["authors", "languages", "subjects", "identifiers", "contributors"]
    scalars = ["title", "version", "description", "publisher", "publication_date", "rights"]
    meta = table(spark, folder, "epub_metadata", "book_id", "harvest_id", "harvested_at", *scalars, *lists)
    latest = meta.groupBy("book_id").agg(F.max_by(F.struct(*scalars, *lists), F.struct("harvested_at", "harvest_id")).alias("m"))
    covers = table(spark, folder, "manifest_items", "book_id", "item_id", "href", "media_type", "properties").where("properties = 'cover-image'").groupBy("book_id").agg(F.max(F.struct("item_id", "href", "media_type")).alias("cover"))
    chapters = table(spark, folder, "chapters", "chapter_uid", "book_id", "spine_pos", "title", "content", "error_kind").withColumn("volume", F.expr(f"spine_pos div {VOLUME}"))
    rows = F.struct("spine_pos", "chapter_uid", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"), "error_kind")
    # at most VOLUME spine positions are gathered; exact copies are told in their volume, and metadata comes to volumes, so that contents are shuffled once
    parts = chapters.groupBy("book_id", "volume").agg(F.array_sort(F.array_distinct(F.collect_list(rows))).alias("chapters"))
    packages = chapters.select("book_id", "volume").distinct().join(latest, "book_id").join(covers, "book_id", "left")
    books = parts.join(packages, ["book_id", "volume"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return library.in_pieces((row for batch in batches for row in map(archive, *(batch.column(c) for c in ("book_id", "volume", "chapters", "m", "cover")))), library.BOOKS, 64)

    def archive(*row: pa.Scalar) -> tuple:
        from xml.sax.saxutils import escape, quoteattr

        names = {"title": "title", "description": "description", "publisher": "publisher", "publication_date": "date", "rights": "rights"}
        multiple = {"authors": "creator", "languages": "language", "subjects": "subject", "identifiers": "identifier", "contributors": "contributor"}
        book, volume, chapters_, m, cover = (x.as_py() for x in row)
        fields = "".join(f"<dc:{tag}>{escape(m[k])}</dc:{tag}>" for k, tag in names.items() if m[k] is not None)
        fields += "".join(f"<DC:{tag}>{escape(x)}</DC:{tag}>" for k, tag in multiple.items() for x in (m[k] if m[k] is not None else ()) if x is not None)
        items, refs, files = ['<item id="css1" href="css/main.css" media-type="text/css"/>'], [], []
        if cover is not None:
            items.append(f'<item id={quoteattr(cover["item_id"])} href={quoteattr(cover["href"])} media-type={quoteattr(cover["media_type"])} properties="cover-image"/>')
            files.append((f"OEBPS/{cover['href']}", b"\xff\xd8" + str(book).encode()))
        for c in chapters_:
            item, kind = f"u{c['chapter_uid']}", c["error_kind"]
            refs.append(f'<itemref idref="{item}"/>')
            if kind in (None, "MissingFile", "Utf8"):
                items.append(f'<item id="{item}" href="text/{item}.xhtml" media-type="application/xhtml+xml"/>')
            if kind is None:
                files.append((f"OEBPS/text/{item}.xhtml", _markup(c["title"], c["content"], c["spine_pos"]).encode()))
            elif kind == "Utf8":
                files.append((f"OEBPS/text/{item}.xhtml", b"<p>caf\xe9</p>"))
        version = "" if m["version"] is None else f" version={quoteattr(m['version'])}"
        package = f'<package{version}><metadata xmlns:dc="d" xmlns:DC="d">{fields}</metadata><manifest>{"".join(items)}</manifest><spine>{"".join(refs)}</spine></package>'
        head = [("META-INF/container.xml", CONTAINER.format("OEBPS/content.opf").encode()), ("OEBPS/content.opf", package.encode()), ("OEBPS/css/main.css", SHEET.encode())]
        data = write_archive([*head, *files], level=1)
        name = f"{book}-{volume}"
        return name, f"shelf/{name}.epub", len(data), data

    return books.select("book_id", "volume", "chapters", "m", "cover").mapInArrow(write, BOOKS)


_BLANK = "regexp_replace({}, 'WS+', '', 'g') = ''"
_TRIM = "nullif(regexp_replace(regexp_replace({}, '^WS+', ''), 'WS+$', ''), '')"
_KEPT = "list_filter(list_transform({}, lambda x: regexp_replace(regexp_replace(x, '^WS+', ''), 'WS+$', '')), lambda x: x <> '')"
_BASE = f"""
WITH ch AS (SELECT DISTINCT chapter_uid, book_id, spine_pos, coalesce(title, '') AS title, coalesce(content, '') AS content, error_kind FROM chapters),
vol AS (SELECT *, book_id || '-' || (spine_pos // {VOLUME}) AS vol, row_number() OVER (PARTITION BY book_id, spine_pos // {VOLUME} ORDER BY spine_pos, chapter_uid) - 1 AS pos FROM ch),
latest AS (SELECT * FROM epub_metadata QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY harvested_at DESC, harvest_id DESC) = 1),
cov AS (SELECT book_id, max({{'item_id': item_id, 'href': href, 'media_type': media_type}}) AS c FROM manifest_items WHERE properties = 'cover-image' GROUP BY book_id),
vols AS (SELECT DISTINCT v.vol, v.book_id FROM vol v JOIN latest USING (book_id)),
body AS (SELECT vol, book_id, pos, chapter_uid, spine_pos, title, content, title || 'p{{margin:0}}' || title || chr(10) || '<' || spine_pos || '>' || chr(10) || content || chr(10) || 'onetwo' AS raw FROM vol WHERE error_kind IS NULL AND vol IN (SELECT vol FROM vols)),
txt AS (SELECT *, array_to_string({_KEPT.format("string_split(raw, chr(10))")}, chr(10)) AS text FROM body)
""".replace("WS", _WS)  # noqa: E501
_WORDS = "CAST(len(list_filter(regexp_split_to_array(text, 'WS+'), lambda x: x <> '')) AS BIGINT)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _BASE + sql.replace("WS", _WS)
        return f

    return add


def _library(spark: SparkSession, folder: str) -> Library:
    return Library(volumes(spark, folder))


def _list(column: str) -> F.Column:
    return F.array_join(column, "\u0001")


_META = ", ".join(f"{_TRIM.format(c)} AS {c}" for c in ("title", "description", "publisher", "publication_date", "rights"))
_LISTS = ", ".join(f"array_to_string({_KEPT.format(c)}, chr(1)) AS {c}" for c in ("authors", "languages", "subjects", "identifiers", "contributors"))


@query(
    f"SELECT vol AS book_id, 'OEBPS/content.opf' AS opf_path, version, {_META}, {_LISTS}, c IS NOT NULL AS has_cover, c.media_type AS cover_image_format, (SELECT count(*) FROM vol x WHERE x.vol = vols.vol) AS chapter_count "
    "FROM vols JOIN latest USING (book_id) LEFT JOIN cov USING (book_id)"
)
def archive_metadata(spark, folder):
    """The metadata of every archive, from its package document."""
    rows = _library(spark, folder).metadata()
    return rows.select("book_id", "opf_path", "version", "title", "description", "publisher", "publication_date", "rights", *(_list(c).alias(c) for c in ("authors", "languages", "subjects", "identifiers", "contributors")), "has_cover", "cover_image_format", "chapter_count")


@query(
    f"SELECT vol AS book_id, len(e) = 0 AS is_valid, array_to_string(e, '; ') AS errors FROM (SELECT vol, list_filter([CASE WHEN {_TRIM.format('title')} IS NULL THEN 'missing title' END, "
    f"CASE WHEN len({_KEPT.format('languages')}) = 0 THEN 'missing language' END, CASE WHEN len({_KEPT.format('identifiers')}) = 0 THEN 'missing identifier' END], lambda x: x IS NOT NULL) AS e FROM vols JOIN latest USING (book_id))"
)
def archive_validation(spark, folder):
    """What each archive's metadata lacks."""
    return _library(spark, folder).validation().select("book_id", "is_valid", F.array_join("errors", "; ").alias("errors"))


@query(
    "SELECT vol AS book_id, 0 AS pos, 'css1' AS item_id, 'css/main.css' AS href, 'text/css' AS media_type, CAST(NULL AS VARCHAR) AS properties FROM vols UNION ALL SELECT vol, 1, c.item_id, c.href, c.media_type, 'cover-image' FROM vols JOIN cov USING (book_id) UNION ALL "
    "SELECT v.vol, CAST(row_number() OVER (PARTITION BY v.vol ORDER BY v.pos) + (c IS NOT NULL)::INT AS INT), 'u' || chapter_uid, 'text/u' || chapter_uid || '.xhtml', 'application/xhtml+xml', NULL FROM vol v JOIN vols USING (vol) LEFT JOIN cov ON cov.book_id = v.book_id WHERE coalesce(error_kind, '') <> 'Html'"
)
def archive_manifest(spark, folder):
    """The manifest of every archive."""
    return _library(spark, folder).manifest().select("book_id", "pos", "item_id", "href", "media_type", "properties")


@query("SELECT vol AS book_id, CAST(pos AS INT) AS pos, 'u' || chapter_uid AS idref FROM vol WHERE vol IN (SELECT vol FROM vols)")
def archive_spine(spark, folder):
    """The spine of every archive."""
    return _library(spark, folder).spine()


_CHAPTER = "'OEBPS/text/u' || chapter_uid || '.xhtml' AS href, 'application/xhtml+xml' AS media_type"
_TEXT = f"md5(text) AS text_hash, {_WORDS} AS word_count, CAST(length(text) AS BIGINT) AS char_count"


def _narrow(chapters: DataFrame) -> DataFrame:
    return chapters.select("book_id", "spine_pos", "chapter_index", "id", "href", "media_type", "title", F.md5("content").alias("text_hash"), "word_count", "char_count", "error_kind")


@query(f"SELECT vol AS book_id, CAST(pos AS INT) AS spine_pos, row_number() OVER (PARTITION BY vol ORDER BY pos) - 1 AS chapter_index, 'u' || chapter_uid AS id, {_CHAPTER}, split_part(text, chr(10), 1) AS title, {_TEXT}, CAST(NULL AS VARCHAR) AS error_kind FROM txt")
def archive_chapters_skip(spark, folder):
    """Chapters of every archive under the policy that leaves out what can't be read."""
    return _narrow(_library(spark, folder).chapters("skip"))


_LOSSY = f"{_TEXT.replace('text', 't')}".replace("t_hash", "text_hash")
_BOTH = "(SELECT vol, pos, chapter_uid, text AS t FROM txt UNION ALL SELECT vol, pos, chapter_uid, 'caf�' FROM vol WHERE error_kind = 'Utf8' AND vol IN (SELECT vol FROM vols))"


@query(f"SELECT vol AS book_id, CAST(pos AS INT) AS spine_pos, row_number() OVER (PARTITION BY vol ORDER BY pos) - 1 AS chapter_index, 'u' || chapter_uid AS id, {_CHAPTER}, split_part(t, chr(10), 1) AS title, {_LOSSY}, CAST(NULL AS VARCHAR) AS error_kind FROM {_BOTH}")
def archive_chapters_lossy(spark, folder):
    """Chapters of every archive under the policy that replaces invalid bytes."""
    return _narrow(_library(spark, folder).chapters("lossy"))


@query(
    f"SELECT vol AS book_id, CAST(pos AS INT) AS spine_pos, row_number() OVER (PARTITION BY vol ORDER BY pos) - 1 AS chapter_index, '' AS id, {_CHAPTER}, CAST(NULL AS VARCHAR) AS title, {_LOSSY}, CAST(NULL AS VARCHAR) AS error_kind FROM {_BOTH} UNION ALL "
    f"SELECT vol, CAST(pos AS INT), NULL, '', {_CHAPTER.replace(' AS href', '').replace(' AS media_type', '')}, NULL, NULL, NULL, NULL, 'MissingFile' FROM vol WHERE error_kind = 'MissingFile' AND vol IN (SELECT vol FROM vols)"
)
def archive_chapters_report(spark, folder):
    """Chapters of every archive under the policy that keeps errors as rows."""
    return _narrow(_library(spark, folder).chapters("report"))


@query(
    "SELECT vol AS book_id, 'u' || chapter_uid AS id, md5(array_to_string(list_filter(list_transform(list_concat([title || 'p{margin:0}', title, '&lt;' || spine_pos || '&gt;'], string_split(replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;'), chr(10)), ['one', 'two']), "
    "lambda x: regexp_replace(regexp_replace(regexp_replace(x, 'WS+', ' ', 'g'), '^ ', ''), ' $', '')), lambda x: x <> ''), chr(10))) AS text_hash FROM body"
)
def archive_chapters_scanner(spark, folder):
    """Text of every readable chapter by the low-memory scanner, which leaves entities."""
    return _library(spark, folder).chapters("skip", scanner=True).select("book_id", "id", F.md5("content").alias("text_hash"))


@query(f"SELECT vol AS book_id, row_number() OVER (PARTITION BY vol ORDER BY pos) - 1 AS chapter_index, 'u' || chapter_uid AS chapter_id, 'OEBPS/text/u' || chapter_uid || '.xhtml' AS chapter_href, split_part(text, chr(10), 1) AS title FROM txt")
def archive_toc(spark, folder):
    """The table of contents of every archive."""
    return _library(spark, folder).toc()


@query(f"SELECT vol AS book_id, count(*) AS n_chapters, CAST(sum({_WORDS}) AS BIGINT) AS total_words, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM txt GROUP BY vol")
def archive_totals(spark, folder):
    """Readable chapters and sums of every archive."""
    return _library(spark, folder).totals()


@query(
    f"SELECT vol AS book_id, {_TRIM.format('title')} AS title, (SELECT count(*) FROM vol x WHERE x.vol = vols.vol) AS chapter_count, coalesce(n, 0) AS n_chapters, CAST(coalesce(w, 0) AS BIGINT) AS total_words, CAST(coalesce(k, 0) AS BIGINT) AS total_chars, preview AS first_chapter_preview "
    f"FROM vols JOIN latest USING (book_id) LEFT JOIN (SELECT vol, count(*) AS n, sum({_WORDS.replace('text', 't')}) AS w, sum(length(t)) AS k, arg_min(left(t, 300), pos) AS preview FROM {_BOTH} GROUP BY vol) USING (vol)"
)
def archive_analysis(spark, folder):
    """The analysis report of every archive, each opened once."""
    return _library(spark, folder).analysis().select("book_id", "title", "chapter_count", "n_chapters", "total_words", "total_chars", "first_chapter_preview")


@query(
    f"SELECT vol AS book_id, coalesce({_TRIM.format('title')}, vol) AS title, c IS NOT NULL AS has_cover, c.media_type AS media_type, CAST(2 + length(book_id::VARCHAR) AS BIGINT) * CASE WHEN c IS NOT NULL THEN 1 END AS size, c IS NULL AS placeholder FROM vols JOIN latest USING (book_id) LEFT JOIN cov USING (book_id)"
)
def archive_showcase(spark, folder):
    """Every archive's title and cover, or the need of a placeholder."""
    return _library(spark, folder).showcase().select("book_id", "title", "has_cover", "media_type", F.octet_length("data").cast("bigint").alias("size"), F.col("data").isNull().alias("placeholder"))


@query(
    "SELECT vol AS book_id, c.media_type AS media_type, CASE WHEN c IS NOT NULL THEN CAST(2 + length(book_id::VARCHAR) AS BIGINT) END AS size, CASE WHEN c IS NOT NULL THEN 'ffd8' || lower(hex(book_id::VARCHAR)) END AS data, CASE WHEN c IS NULL THEN 'MissingFile' END AS error_kind FROM vols LEFT JOIN cov USING (book_id)"
)
def archive_covers(spark, folder):
    """The cover of every archive by its bytes, or why it has none."""
    return _library(spark, folder).covers().select("book_id", "media_type", "size", F.lower(F.hex("data")).alias("data"), "error_kind")


@query(
    "SELECT vol AS book_id, name AS entry_path, CAST(i AS INT) AS entry_idx FROM vols, (VALUES (0, 'META-INF/container.xml'), (1, 'OEBPS/content.opf'), (2, 'OEBPS/css/main.css')) t(i, name) UNION ALL SELECT vol, 'OEBPS/' || c.href, 3 FROM vols JOIN cov USING (book_id) UNION ALL "
    "SELECT v.vol, 'OEBPS/text/u' || chapter_uid || '.xhtml', CAST(row_number() OVER (PARTITION BY v.vol ORDER BY v.pos) + 2 + (c IS NOT NULL)::INT AS INT) FROM vol v JOIN vols USING (vol) LEFT JOIN cov ON cov.book_id = v.book_id WHERE error_kind IS NULL OR error_kind = 'Utf8'"
)
def archive_entries(spark, folder):
    """The directory of every archive; nothing is inflated."""
    return _library(spark, folder).entries(wanted=()).where("data IS NULL AND error_kind IS NULL").select("book_id", "entry_path", "entry_idx")


@query(f"SELECT vol AS book_id, md5('{SHEET.replace(chr(39), chr(39) * 2)}') AS hash, CAST(NULL AS VARCHAR) AS error_kind FROM vols")
def archive_resource(spark, folder):
    """One entry of every archive by its exact name."""
    return _library(spark, folder).read_resource("OEBPS/css/main.css").select("book_id", F.md5("data").alias("hash"), "error_kind")


_RULES = """(0, NULL, 'import', NULL, NULL, '', 'url(''ab.css'')'), (1, NULL, 'style', 'p', NULL, 'margin: 0; quotes: ''a;b''', NULL), (2, NULL, 'style', 'p.line, .main', NULL, 'color: gray; margin: 1px', NULL),
(3, NULL, 'media', NULL, 'print', '', NULL), (4, 3, 'style', 'p', NULL, 'color: black', NULL), (5, NULL, 'style', '#top.x', NULL, 'width: 8px', NULL), (6, NULL, 'style', 'div > p', NULL, 'color: red', NULL),
(7, NULL, 'style', 'h1,', NULL, 'padding: 2px', NULL), (8, NULL, 'font-face', NULL, NULL, 'font-family: F', NULL), (9, NULL, 'page', NULL, ':first', 'margin: 3cm', NULL)"""


def _block(column: str) -> F.Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


@query(f"SELECT vol AS book_id, r.* FROM vols, (VALUES {_RULES}) r(rule_id, parent_rule_id, kind, selectors, query, declarations, content)")
def archive_rules(spark, folder):
    """The rules of every archive's style sheets."""
    return _library(spark, folder).css_rules().select("book_id", "rule_id", "parent_rule_id", "kind", "selectors", "query", _block("declarations").alias("declarations"), "content")


# styles by the cascade: h1 and "any" have those of the empty selector of "h1,", which matches every element
_STYLED = """SELECT vol AS book_id, chapter_uid, t.tag, t.styles, CAST(CASE WHEN t.tag = 'p' THEN len(string_split(content, chr(10))) ELSE t.n END AS BIGINT) AS n FROM body, (VALUES ('root', 'padding: 2px', 1), ('html', 'padding: 2px', 1), ('head', 'padding: 2px', 1),
('title', 'padding: 2px', 1), ('style', 'padding: 2px', 1), ('body', 'padding: 2px; width: 8px', 1), ('div', 'color: gray; margin: 1px; padding: 2px', 1), ('h1', 'padding: 2px', 1), ('a', 'padding: 2px', 1), ('img', 'padding: 2px', 1), ('br', 'padding: 2px', 1),
('p', 'color: gray; margin: 1px; padding: 2px; quotes: ''a;b''', 1), ('ul', 'padding: 2px', 1), ('LI', 'color: blue; padding: 2px', 1), ('LI', 'padding: 2px', 1)) t(tag, styles, n)"""


def _styles(nodes: DataFrame, toc: DataFrame) -> DataFrame:
    each = nodes.groupBy("book_id", "chapter_index", "tag", _block("styles").alias("styles")).agg(F.count("*").alias("n"))
    return each.join(toc.select("book_id", "chapter_index", F.substring("chapter_id", 2, 30).cast("bigint").alias("chapter_uid")), ["book_id", "chapter_index"]).select("book_id", "chapter_uid", "tag", "styles", "n")


@query(_STYLED)
def archive_styles(spark, folder):
    """How many elements of every chapter's tree have which tag and styles, by the cascade inside the pass that reads the archive."""
    books = _library(spark, folder)
    return _styles(books.ast_nodes().where("kind = 'Element'"), books.toc())


@query(_STYLED)
def archive_styled_elements(spark, folder):
    """The same by the cascade as a join of the tables of nodes and rules."""
    books = _library(spark, folder)
    alike = library.styled_alike(books.ast_nodes(styled=False, only="Element"), books.css_rules(), "chapter_id").select("book_id", "tag", _block("styles").alias("styles"), F.explode("elements.chapter_id").alias("id"))
    return alike.groupBy("book_id", F.substring("id", 2, 30).cast("bigint").alias("chapter_uid"), "tag", "styles").agg(F.count("*").alias("n"))


@query(
    "SELECT vol AS book_id, chapter_uid, t.kind, t.depth, CAST(CASE t.n WHEN -1 THEN k WHEN -2 THEN f WHEN -3 THEN CASE WHEN title <> '' THEN 1 ELSE 0 END ELSE t.n END AS BIGINT) AS n FROM (SELECT *, len(string_split(content, chr(10))) AS k, len(list_filter(string_split(content, chr(10)), lambda x: x <> '')) AS f FROM body), "
    "(VALUES ('Element', 0, 1), ('Element', 1, 1), ('Element', 2, 2), ('Comment', 3, 1), ('Element', 3, 3)) t(kind, depth, n)"
)
def archive_tree_top(spark, folder):
    """Nodes of every chapter's tree by kind and depth, down to the page's parts."""
    books = _library(spark, folder)
    each = books.ast_nodes().where("depth <= 3").groupBy("book_id", "chapter_index", "kind", "depth").agg(F.count("*").alias("n"))
    toc = books.toc().select("book_id", "chapter_index", F.substring("chapter_id", 2, 30).cast("bigint").alias("chapter_uid"))
    return each.join(toc, ["book_id", "chapter_index"]).select("book_id", "chapter_uid", "kind", "depth", "n")


@query(f"SELECT vol AS book_id, chapter_uid, coalesce({_TRIM.format('title')}, 'p{{margin:0}}') AS title FROM body")
def archive_titles(spark, folder):
    """Titles of chapters by their trees: the first heading, else the title element, else the first text."""
    rows = _library(spark, folder).chapters(with_ast=True)
    return rows.select("book_id", F.substring("id", 2, 30).cast("bigint").alias("chapter_uid"), "title")


@query("SELECT vol AS book_id, chapter_uid, t.* FROM body, (VALUES ('a', 'OEBPS/css/main.css#s'), ('img', 'OEBPS/text/fig.png')) t(tag, target)")
def archive_links(spark, folder):
    """Links of every chapter's tree, resolved against its file."""
    books = _library(spark, folder)
    target = F.coalesce(F.try_element_at("attrs", F.lit("href")), F.try_element_at("attrs", F.lit("src")))
    toc = books.toc().select("book_id", "chapter_index", F.substring("chapter_id", 2, 30).cast("bigint").alias("chapter_uid"))
    return books.ast_nodes().where("tag IN ('a', 'img')").select("book_id", "chapter_index", "tag", target.alias("target")).join(toc, ["book_id", "chapter_index"]).select("book_id", "chapter_uid", "tag", "target")


_LINES = "array_to_string(list_transform(string_split(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)), lambda x: '<p class=\"line\">' || x || '</p>'), '')"
_SAFE = "replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    f"SELECT vol AS book_id, chapter_uid, md5('<div class=\"main\"><h1>' || {_SAFE} || '</h1><a href=\"../css/main.css#s\">&lt;' || spine_pos || '&gt;</a><img src=\"fig.png\" alt=\"a &amp; b\"><br>' || {_LINES} || '<ul><li>one<li>two</li></li></ul></div>') AS hash FROM body"
)
def archive_rendered(spark, folder):
    """Safe markup of every readable chapter file: page and head unwrapped, comments and styles left out, names and attributes cleaned."""

    @F.pandas_udf("string")
    def safe(data: pd.Series) -> pd.Series:
        return pd.Series([html.rendered(html.parse(bytes(d).decode("utf-8"))) for d in data])

    files = _library(spark, folder).entries().where("entry_path LIKE 'OEBPS/text/%' AND is_valid_utf8(CAST(data AS STRING))")
    return files.select("book_id", F.regexp_extract("entry_path", r"u(\d+)", 1).cast("bigint").alias("chapter_uid"), F.md5(safe("data")).alias("hash"))


def _wanted(books: Library) -> DataFrame:
    toc = books.toc()
    forms = F.array(F.lit("../css/main.css"), F.lit("OEBPS/css/main.css#a#b"), F.lit(" OEBPS/./text/../css/main.css "), F.lit("#here"), F.lit("https://x/y"), F.lit("fig.png"))
    inner = toc.select("book_id", "chapter_index", F.explode(forms).alias("href"))
    return inner.unionByName(toc.groupBy("book_id").agg((F.max("chapter_index") + 1).alias("chapter_index")).select("book_id", "chapter_index", F.lit("../css/main.css").alias("href")))


_ASKED = """FROM (SELECT vol AS book_id, row_number() OVER (PARTITION BY vol ORDER BY pos) - 1 AS chapter_index FROM body) b, (VALUES ('../css/main.css', 'OEBPS/css/main.css', true, NULL), ('OEBPS/css/main.css#a#b', 'OEBPS/css/main.css#a#b', true, NULL),
(' OEBPS/./text/../css/main.css ', 'OEBPS/css/main.css', true, NULL), ('#here', '#here', false, 'MissingFile'), ('https://x/y', 'https://x/y', false, 'MissingFile'), ('fig.png', 'OEBPS/text/fig.png', false, 'MissingFile')) t(href, path, hit, problem)"""


@query(f"SELECT book_id, chapter_index, href, path, CAST(NULL AS VARCHAR) AS error_kind {_ASKED} UNION ALL SELECT vol, count(*), '../css/main.css', NULL, 'ChapterError' FROM body GROUP BY vol")
def archive_resolved(spark, folder):
    """Links of all forms from every chapter, resolved by what the archive holds; one more from a chapter that isn't there."""
    books = _library(spark, folder)
    return books.resolve(_wanted(books)).select("book_id", "chapter_index", "href", "path", "error_kind")


@query(f"SELECT book_id, chapter_index, href, CASE WHEN hit THEN md5('{SHEET.replace(chr(39), chr(39) * 2)}') END AS hash, problem AS error_kind {_ASKED} UNION ALL SELECT vol, count(*), '../css/main.css', NULL, 'ChapterError' FROM body GROUP BY vol")
def archive_linked_resources(spark, folder):
    """The bytes that the same links lead to."""
    books = _library(spark, folder)
    return books.read_chapter_resource(_wanted(books)).select("book_id", "chapter_index", "href", F.md5("data").alias("hash"), "error_kind")


@query(
    "SELECT vol AS book_id, 'OEBPS/text/u' || chapter_uid || '.xhtml#p' AS path, 'go' AS action, row_number() OVER (PARTITION BY vol ORDER BY pos) - 1 AS chapter_index, 'p' AS fragment FROM body UNION ALL "
    "SELECT vol, t.* FROM vols, (VALUES ('#top', 'scroll', NULL, 'top'), ('', 'none', NULL, NULL), ('mailto:x', 'open', NULL, NULL), ('OEBPS/nowhere#q', 'none', NULL, NULL)) t"
)
def archive_navigation(spark, folder):
    """What following a link does: to every chapter with a fragment, to a place on the page, outside, and nowhere."""
    books = _library(spark, folder)
    toc = books.toc()
    paths = toc.select("book_id", F.concat("chapter_href", F.lit("#p")).alias("path"))
    other = books.packages().select("book_id", F.explode(F.array(*map(F.lit, ("#top", "", "mailto:x", "OEBPS/nowhere#q")))).alias("path"))
    return library.navigation(paths.unionByName(other), toc)


@query("SELECT vol AS book_id, 'u' || chapter_uid AS id FROM body QUALIFY row_number() OVER (PARTITION BY vol ORDER BY pos) = 2")
def archive_second_chapter(spark, folder):
    """The second readable chapter of every archive."""
    return _library(spark, folder).chapter(1).select("book_id", "id")
