"""Driver queries of the e-book operators over tables of harvested books, with the same in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import html, links, text
from quirework.operators import library
from quirework.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Unicode white space for an engine whose regular expressions only know that of ASCII
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("WS", _WS)
        return f

    return add


_CHAPTERS = "(SELECT DISTINCT chapter_uid, book_id, spine_pos, chapter_index, id, href, media_type, title, content, word_count, char_count, error_kind FROM chapters)"
_CLEAN = r"array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^WS+', ''), 'WS+$', '')), lambda x: x <> ''), chr(10))"


# the scanner form collapses white space within a line, leaves entities, and knows style elements as text
_ESCAPED = "replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_SCANNED = rf"array_to_string(list_filter(list_transform(list_prepend('p{{margin:0}}', string_split(content, chr(10))), lambda x: regexp_replace(regexp_replace(regexp_replace({_ESCAPED}, 'WS+', ' ', 'g'), '^WS+', ''), 'WS+$', '')), lambda x: x <> ''), chr(10))"


def _chapters(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Chapters, copies of a row being one record; a chapter is told by its uid, so only its hash moves where no text is needed."""
    return table(spark, folder, "chapters", "chapter_uid", *columns).dropDuplicates(["chapter_uid"])


def _readable(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return _chapters(spark, folder, "error_kind", *columns).where("error_kind IS NULL")


@query(rf"SELECT chapter_uid, md5({_CLEAN}) AS text_hash, CAST(length({_CLEAN}) AS BIGINT) AS n_chars FROM {_CHAPTERS} WHERE content IS NOT NULL")
def chapter_text(spark, folder):
    """Cleaned text of every chapter, by its hash: lines trimmed of Unicode white space, blank ones dropped."""
    clean = _narrow(table(spark, folder, "chapters", "chapter_uid", "content").where("content IS NOT NULL").select("chapter_uid", text.clean_lines(F.col("content")).alias("t")).select("chapter_uid", F.md5("t").alias("text_hash"), text.char_count(F.col("t")).alias("n_chars")))
    return clean


def _narrow(rows: DataFrame) -> DataFrame:
    """Distinct after the texts have become small columns, so that copies are dropped without shuffling texts."""
    return rows.dropDuplicates(["chapter_uid"])


@query(rf"SELECT chapter_uid, CAST(len(list_filter(regexp_split_to_array(content, 'WS+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(length(content) AS BIGINT) AS chars FROM {_CHAPTERS} WHERE content IS NOT NULL")
def chapter_counts(spark, folder):
    """Words by Unicode white space and code points of every chapter."""
    return _narrow(table(spark, folder, "chapters", "chapter_uid", "content").where("content IS NOT NULL").select("chapter_uid", text.word_count(F.col("content")).alias("words"), text.char_count(F.col("content")).alias("chars")))


@query(f"SELECT book_id, count(*) AS n_chapters, CAST(sum(word_count) AS BIGINT) AS total_words, CAST(sum(char_count) AS BIGINT) AS total_chars FROM {_CHAPTERS} WHERE error_kind IS NULL GROUP BY book_id")
def book_totals(spark, folder):
    """Readable chapters and sums of every book in one aggregate."""
    return library.book_totals(_readable(spark, folder, "book_id", "word_count", "char_count"))


@query(f"SELECT book_id, count(*) AS n_chapters, CAST(sum(word_count) AS BIGINT) AS total_words, CAST(sum(char_count) AS BIGINT) AS total_chars, arg_min(left(content, 300), spine_pos) AS first_chapter_preview FROM {_CHAPTERS} WHERE content IS NOT NULL GROUP BY book_id")
def analysis(spark, folder):
    """The analysis report of every book: counts, sums and the beginning of its first chapter."""
    rows = table(spark, folder, "chapters", "chapter_uid", "book_id", "spine_pos", "word_count", "char_count", "content").where("content IS NOT NULL")
    return library.analysis_of(rows.withColumn("content", text.preview(F.col("content"))).dropDuplicates(["chapter_uid"]))


@query(f"SELECT chapter_uid, book_id, row_number() OVER (PARTITION BY book_id ORDER BY spine_pos) - 1 AS dense FROM {_CHAPTERS} WHERE error_kind IS NULL")
def dense_chapter_index(spark, folder):
    """Position of every readable chapter in its book without gaps. The hot book is numbered in blocks of positions with offsets."""
    return library.dense_index(_readable(spark, folder, "book_id", "spine_pos"), "dense").select("chapter_uid", "book_id", "dense")


_STEM = r"regexp_replace(regexp_extract(chapter_href, '[^/]*$'), '(.)\.[^.]*$', '\1')"


@query(rf"SELECT book_id, chapter_index, chapter_id, chapter_href, coalesce(CASE WHEN regexp_replace(title, 'WS+', '', 'g') <> '' THEN title END, nullif({_STEM}, ''), 'Untitled Chapter') AS title FROM (SELECT DISTINCT * FROM toc_entries)")
def toc(spark, folder):
    """The table of contents with a title for every entry."""
    return library.table_of_contents(table(spark, folder, "toc_entries").distinct())


@query(f"SELECT book_id, chapter_uid, title FROM {_CHAPTERS} WHERE chapter_index = 2")
def nth_chapter(spark, folder):
    """The third readable chapter of every book."""
    return _chapters(spark, folder, "book_id", "chapter_index", "title").where("chapter_index = 2").select("book_id", "chapter_uid", "title")


@query(
    "SELECT s.book_id, s.pos, s.idref, m.href, m.media_type FROM (SELECT DISTINCT * FROM spine_items) s JOIN (SELECT book_id, item_id, arg_max(href, pos) AS href, arg_max(media_type, pos) AS media_type FROM manifest_items GROUP BY ALL) m "
    "ON s.book_id = m.book_id AND s.idref = m.item_id"
)
def spine_manifest(spark, folder):
    """Spine items with their manifest items."""
    manifest = table(spark, folder, "manifest_items", "book_id", "pos", "item_id", "href", "media_type").distinct()
    return library.spine_manifest(table(spark, folder, "spine_items").distinct(), manifest)


@query(
    "SELECT s.book_id, count(*) AS n_spine, count(m.item_id) AS n_found, count(*) - count(m.item_id) AS n_missing FROM (SELECT DISTINCT * FROM spine_items) s "
    "LEFT JOIN (SELECT DISTINCT book_id, item_id FROM manifest_items) m ON s.book_id = m.book_id AND s.idref = m.item_id GROUP BY s.book_id"
)
def spine_gaps(spark, folder):
    """How many spine items of every book the manifest has and lacks."""
    items = table(spark, folder, "manifest_items", "book_id", F.col("item_id").alias("idref")).distinct().withColumn("hit", F.lit(1))
    joined = table(spark, folder, "spine_items").distinct().join(items, ["book_id", "idref"], "left")
    return joined.groupBy("book_id").agg(F.count("*").alias("n_spine"), F.count("hit").alias("n_found"), (F.count("*") - F.count("hit")).alias("n_missing"))


@query("SELECT book_id, pos, item_id, href FROM (SELECT DISTINCT * FROM manifest_items) WHERE media_type = 'text/css'")
def style_sheet_items(spark, folder):
    """Manifest items that are style sheets; the filter reaches the scan."""
    return table(spark, folder, "manifest_items").where("media_type = 'text/css'").distinct().select("book_id", "pos", "item_id", "href")


@query("SELECT book_id, item_id, href, media_type FROM (SELECT DISTINCT * FROM manifest_items) WHERE contains(properties, 'cover-image') QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY pos DESC, href DESC) = 1")
def cover_items(spark, folder):
    """The cover image of every book by its manifest: the last item with the property."""
    items = table(spark, folder, "manifest_items", "book_id", "pos", "item_id", "href", "media_type", "properties").where(F.col("properties").contains("cover-image"))
    return items.groupBy("book_id").agg(F.max_by(F.struct("item_id", "href", "media_type"), F.struct("pos", "href")).alias("m")).select("book_id", "m.*")


_ERRORS = r"list_filter([CASE WHEN title IS NULL OR regexp_replace(title, 'WS+', '', 'g') = '' THEN 'missing title' END, CASE WHEN len(languages) = 0 THEN 'missing language' END, CASE WHEN len(identifiers) = 0 THEN 'missing identifier' END], lambda x: x IS NOT NULL)"
_HARVESTS = "(SELECT * FROM epub_metadata QUALIFY row_number() OVER (PARTITION BY harvest_id) = 1)"


@query(f"SELECT harvest_id, len({_ERRORS}) = 0 AS is_valid, array_to_string({_ERRORS}, '; ') AS errors FROM {_HARVESTS}")
def validation(spark, folder):
    """What each harvest's metadata lacks."""
    rows = table(spark, folder, "epub_metadata", "harvest_id", "title", "languages", "identifiers").dropDuplicates(["harvest_id"])
    errors = text.validation_errors(F.col("title"), F.col("languages"), F.col("identifiers"))
    return rows.select("harvest_id", errors.alias("e")).select("harvest_id", (F.size("e") == 0).alias("is_valid"), F.array_join("e", "; ").alias("errors"))


@query(
    "SELECT harvest_id, coalesce(title, '') AS title, coalesce(chapter_count, 0) AS chapter_count, coalesce(cover_image_format, '') AS cover_image_format, has_cover, CAST(len(authors) AS BIGINT) AS n_authors, "
    f"CAST(len(spine) AS BIGINT) AS n_spine FROM {_HARVESTS}"
)
def metadata_scalars(spark, folder):
    """Single metadata values with their defaults."""
    rows = table(spark, folder, "epub_metadata", "harvest_id", "title", "chapter_count", "cover_image_format", "has_cover", "authors", "spine").dropDuplicates(["harvest_id"])
    return rows.select(
        "harvest_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("chapter_count", F.lit(0)).cast("bigint").alias("chapter_count"), F.coalesce("cover_image_format", F.lit("")).alias("cover_image_format"),
        "has_cover", F.size("authors").cast("bigint").alias("n_authors"), F.size("spine").cast("bigint").alias("n_spine"),
    )


@query(
    "SELECT book_id, coalesce(arg_max_null(title, (harvested_at, harvest_id)), regexp_replace(arg_max_null(path, (harvested_at, harvest_id)), '^.*/|\\.epub$', '', 'g')) AS title, arg_max_null(has_cover, (harvested_at, harvest_id)) AS has_cover FROM epub_metadata GROUP BY book_id"
)
def library_grid(spark, folder):
    """Every book's latest title, or its file's name, and whether it has a cover."""
    rows = table(spark, folder, "epub_metadata", "book_id", "harvest_id", "harvested_at", "title", "path", "has_cover")
    last = rows.groupBy("book_id").agg(F.max_by(F.struct("title", "path", "has_cover"), F.struct("harvested_at", "harvest_id")).alias("m"))
    return last.select("book_id", F.coalesce("m.title", F.regexp_replace("m.path", r"^.*/|\.epub$", "")).alias("title"), "m.has_cover")


_LATEST = "(SELECT book_id, arg_max(opf_path, (harvested_at, harvest_id)) AS opf_path FROM epub_metadata GROUP BY book_id)"
_JOINED = "CASE WHEN starts_with(href, '/') THEN href WHEN folder = '' THEN href ELSE folder || '/' || href END"


@query(
    f"SELECT DISTINCT book_id, href, {_JOINED} AS entry_path, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(string_split(replace({_JOINED}, '\\', '/'), '/'), lambda s: s <> '' AND s <> '.'), "
    "lambda s: [s])), lambda done, s: CASE WHEN s[1] = '..' THEN done[1:greatest(len(done) - 1, 0)] ELSE list_concat(done, s) END), '/') AS normal "
    f"FROM (SELECT m.book_id, m.href, regexp_replace(b.opf_path, '/?[^/]*$', '') AS folder FROM manifest_items m JOIN {_LATEST} b ON m.book_id = b.book_id)"
)
def manifest_paths(spark, folder):
    """Paths of manifest links beside their package document, as they are and normal."""
    books = table(spark, folder, "epub_metadata", "book_id", "harvest_id", "harvested_at", "opf_path").groupBy("book_id").agg(F.max_by("opf_path", F.struct("harvested_at", "harvest_id")).alias("opf_path"))
    rows = table(spark, folder, "manifest_items", "book_id", "href").distinct().join(books, "book_id")
    path = links.joined(F.col("opf_path"), F.col("href"))
    return rows.select("book_id", "href", path.alias("entry_path"), links.normal_path(path).alias("normal"))


@query(
    "SELECT m.book_id, m.item_id, max(t.chapter_index) AS chapter_index FROM (SELECT DISTINCT book_id, item_id, href FROM manifest_items) m JOIN (SELECT DISTINCT book_id, chapter_href, chapter_index FROM toc_entries) t "
    "ON m.book_id = t.book_id AND regexp_replace(replace(split_part(m.href, '#', 1), '\\', '/'), '^/', '') = regexp_replace(replace(split_part(t.chapter_href, '#', 1), '\\', '/'), '^/', '') GROUP BY ALL"
)
def link_chapters(spark, folder):
    """Which chapter each manifest item's link leads to."""
    items = table(spark, folder, "manifest_items", "book_id", "item_id", F.col("href").alias("path")).distinct()
    # links inside the book lead to chapters through the operator; items take theirs back by path
    led = library.link_targets(items.select("book_id", "path").distinct(), table(spark, folder, "toc_entries", "book_id", "chapter_href", "chapter_index")).where("chapter_index IS NOT NULL")
    return items.join(led, ["book_id", "path"]).groupBy("book_id", "item_id").agg(F.max("chapter_index").alias("chapter_index"))


@query(rf"SELECT chapter_uid, CAST(len(p) AS BIGINT) AS n_paragraphs, md5(array_to_string(p, chr(1))) AS text_hash FROM (SELECT chapter_uid, list_filter(list_transform(regexp_split_to_array(content, '\n\s*\n'), lambda x: regexp_replace(regexp_replace(x, '^WS+', ''), 'WS+$', '')), lambda x: x <> '') AS p FROM {_CHAPTERS} WHERE content IS NOT NULL)")
def chapter_paragraphs(spark, folder):
    """Paragraphs of every chapter."""
    rows = table(spark, folder, "chapters", "chapter_uid", "content").where("content IS NOT NULL").select("chapter_uid", text.paragraphs(F.col("content")).alias("p"))
    return _narrow(rows.select("chapter_uid", F.size("p").cast("bigint").alias("n_paragraphs"), F.md5(F.array_join("p", "\u0001")).alias("text_hash")))


@query(rf"SELECT chapter_uid, nullif(split_part({_CLEAN}, chr(10), 1), '') AS first_line FROM {_CHAPTERS} WHERE content IS NOT NULL")
def inferred_titles(spark, folder):
    """First line of every chapter that isn't blank: its title where no heading is known."""
    return _narrow(table(spark, folder, "chapters", "chapter_uid", "content").where("content IS NOT NULL").select("chapter_uid", text.first_line(F.col("content")).alias("first_line")))


@query(f"SELECT error_kind, count(*) AS n FROM {_CHAPTERS} WHERE error_kind IS NOT NULL GROUP BY error_kind")
def chapter_errors(spark, folder):
    """Chapters that couldn't be read, by kind of error."""
    return _chapters(spark, folder, "error_kind").where("error_kind IS NOT NULL").groupBy("error_kind").agg(F.count("*").alias("n"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters as markup: what an archive would hold, made of title and text by JVM expressions."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform(F.split("content", "\n"), lambda x: F.concat(F.lit("<p class=\"line\">"), escape(x), F.lit("</p>"))), "\n")
    return table(spark, folder, "chapters", "chapter_uid", "content").where("content IS NOT NULL").select("chapter_uid", F.concat(F.lit("<html><head><style>p{margin:0}</style></head><body>"), body, F.lit("</body></html>")).alias("html"))


@query(rf"SELECT chapter_uid, md5('p{{margin:0}}' || {_CLEAN}) AS text_hash FROM {_CHAPTERS} WHERE content IS NOT NULL")
def markup_text(spark, folder):
    """Plain text of chapters from markup by the tolerant parser, with the style element's text, which is kept, in front."""
    @F.pandas_udf("string")
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([html.text_of(html.parse(x)) for x in batch])

    return _narrow(_pages(spark, folder).select("chapter_uid", F.md5(plain("html")).alias("text_hash")))


@query(rf"SELECT chapter_uid, md5({_SCANNED}) AS text_hash FROM {_CHAPTERS} WHERE content IS NOT NULL")
def markup_text_scanner(spark, folder):
    """Plain text of chapters from markup by the scanner form, which runs in the JVM and leaves entities."""
    return _narrow(_pages(spark, folder).select("chapter_uid", F.md5(text.markup_text(F.col("html"))).alias("text_hash")))


@query(
    f"SELECT chapter_uid, t.tag, CAST(CASE WHEN t.tag = 'p' THEN len(string_split(content, chr(10))) ELSE 1 END AS BIGINT) AS n FROM {_CHAPTERS}, (VALUES ('html'), ('head'), ('style'), ('body'), ('p'), ('root')) t(tag) WHERE content IS NOT NULL"
)
def nodes_by_tag(spark, folder):
    """Element nodes of every chapter's tree by tag."""

    @F.pandas_udf("array<string>")
    def tags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[n[2] for n in html.parse(x) if n[1] == "Element"] for x in batch])

    each = _pages(spark, folder).select("chapter_uid", tags("html").alias("tags"), F.spark_partition_id().alias("part"))
    # copies of a chapter can lie anywhere; each is counted whole and the distinct counts remain
    counted = each.select("chapter_uid", F.explode(F.array_distinct("tags")).alias("tag"), "tags")
    return counted.select("chapter_uid", "tag", F.size(F.filter("tags", lambda t: t == F.col("tag"))).cast("bigint").alias("n")).distinct()


@query(
    "WITH m AS (SELECT DISTINCT book_id, href FROM manifest_items), t AS (SELECT book_id, chapter_index, min(chapter_href) AS chapter_href FROM toc_entries GROUP BY ALL), "
    "w AS (SELECT book_id, 0 AS chapter_index, href || '#x' AS href, href || '#x' AS path FROM m UNION SELECT book_id, 0, './a/../' || href || '#x#y', href || '#x' FROM m UNION SELECT book_id, 0, ' mailto:' || href || ' ', 'mailto:' || href FROM m) "
    "SELECT w.book_id, CAST(w.chapter_index AS BIGINT) AS chapter_index, w.href, w.path, CAST(NULL AS VARCHAR) AS error_kind FROM w"
)
def resolved_links(spark, folder):
    """Links of three kinds to every manifest item, resolved by what the book holds: written as it is, roundabout, and external."""
    names = table(spark, folder, "manifest_items", "book_id", F.col("href").alias("entry_path")).distinct()
    chapters = table(spark, folder, "toc_entries", "book_id", "chapter_index", "chapter_href").groupBy("book_id", "chapter_index").agg(F.min("chapter_href").alias("chapter_href"))
    forms = F.array(F.concat("entry_path", F.lit("#x")), F.concat(F.lit("./a/../"), "entry_path", F.lit("#x#y")), F.concat(F.lit(" mailto:"), "entry_path", F.lit(" ")))
    wanted = names.select("book_id", F.lit(0).cast("bigint").alias("chapter_index"), F.explode(forms).alias("href"))
    return library.resolve_links(wanted, names, chapters)


@query(f"SELECT chapter_uid, CASE WHEN error_kind IS NULL THEN 'read' WHEN error_kind = 'MissingFile' THEN 'missing' ELSE 'damaged' END AS state, error_kind IS NULL AS in_skip, error_kind IS NULL OR error_kind = 'MissingFile' AS in_report FROM {_CHAPTERS}")
def chapter_policies(spark, folder):
    """Which chapters the error policies keep: skip only readable ones, report also missing ones."""
    rows = _chapters(spark, folder, "error_kind")
    read, missing = F.col("error_kind").isNull(), F.coalesce(F.col("error_kind") == "MissingFile", F.lit(False))
    return rows.select("chapter_uid", F.when(read, "read").when(missing, "missing").otherwise("damaged").alias("state"), read.alias("in_skip"), (read | missing).alias("in_report"))


@query("SELECT book_id, item_id, coalesce(CASE lower(regexp_extract(href, '\\.([A-Za-z]+)$', 1)) WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp' WHEN 'svg' THEN 'image/svg+xml' END, 'image/jpeg') AS mime, "
       "regexp_replace(regexp_extract(href, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem, starts_with(href, 'http') AS external FROM (SELECT DISTINCT book_id, item_id, href FROM manifest_items)")  # fmt: skip
def resource_names(spark, folder):
    """Image type and file stem that a manifest item's link tells, and whether it leads out of the book."""
    items = table(spark, folder, "manifest_items", "book_id", "item_id", "href").distinct()
    return items.select("book_id", "item_id", text.image_type(F.col("href")).alias("mime"), text.file_stem(F.col("href")).alias("stem"), links.is_external(F.col("href")).alias("external"))
