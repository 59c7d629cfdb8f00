"""Driver queries of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import document_quality, language, mojibake, names
from quirework.llm import text_quality as quality
from quirework.llm.mixing import mix
from quirework.llm.packing import MOST_TARGETS, pack_all
from quirework.llm.spans import SharedSpans
from quirework.llm.tokens import VOCABULARY, count_tokens
from quirework.runtime import checkpointed, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _fields(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, record_id, field, text) of every text field that garbling can touch, ASCII-only texts left out in the JVM."""
    chapters = table(spark, folder, "chapters", "chapter_uid", "content")
    books = table(spark, folder, "epub_metadata", "harvest_id", "title", "description")
    parts = [
        spread(chapters).select(F.lit("chapters").alias("table_name"), F.col("chapter_uid").alias("record_id"), F.lit("content").alias("field"), F.col("content").alias("text")),
        *(books.select(F.lit("epub_metadata").alias("table_name"), F.col("harvest_id").alias("record_id"), F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "description")),
    ]
    # ASCII text without an entity can't hold a garbled sequence: its UTF-8 form has one byte a character
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("octet_length(text) > char_length(text) OR text RLIKE '&[A-Za-z]{2,8};'")


def _restored(spark: SparkSession, folder: str) -> DataFrame:
    fields = _fields(spark, folder)
    model = mojibake.train(fields)
    return fields.withColumn("r", mojibake.restored(F.col("text"), model)).where("r.n_spans > 0")


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that hold at least one garbled sequence."""
    return _restored(spark, folder).select("table_name", "record_id", "field").distinct()


@query
def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled fields with their restored text, the number of spans, and those that are lost."""
    return _restored(spark, folder).select(
        "table_name", "record_id", "field", F.col("r.restored").alias("restored"), F.col("r.n_spans").alias("n_spans"), F.col("r.n_lost").alias("n_lost"), F.array_join("r.states", ",").alias("states")
    ).dropDuplicates(["table_name", "record_id", "field"])


def _common_words(spark: SparkSession, folder: str) -> frozenset[str]:
    words = table(spark, folder, "common_words", F.lower("word").alias("word")).where("word IS NOT NULL").distinct().limit(COMMON_WORDS_BOUND + 1).collect()
    if len(words) > COMMON_WORDS_BOUND:
        raise ValueError("common_words is larger than its bound")
    return frozenset(r.word for r in words)


def _chapter_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and counts of every chapter with content."""
    chapters = table(spark, folder, "chapters", "chapter_uid", "content", "word_count", "char_count").where("content IS NOT NULL")
    common = _common_words(spark, folder)
    trees = quality.train(quality.sample_texts(chapters, "chapter_uid", "content"), common)
    return spread(chapters).select(
        "chapter_uid", "word_count", "char_count", quality.count_words(F.col("content")).cast("bigint").alias("n_words"), F.char_length("content").cast("bigint").alias("n_chars"),
        quality.statistics(F.col("content"), trees, common).alias("s"),
    )


#: common words are shipped to the workers; the table is small by nature, and this many are accepted
COMMON_WORDS_BOUND = 200_000


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of which more than half of the lines are list entries, table rows or junk, and chapters with wrong counts."""
    findings = F.array(
        F.when(F.col("s.share_list") > 0.5, "list"), F.when(F.col("s.share_table") > 0.5, "table"), F.when(F.col("s.share_junk") > 0.5, "junk"),
        F.when(~(F.col("word_count").eqNullSafe(F.col("n_words")) & F.col("char_count").eqNullSafe(F.col("n_chars"))), "count"),
    )
    each = _chapter_statistics(spark, folder).select("chapter_uid", F.explode(F.array_compact(findings)).alias("finding"))
    return each.distinct()


@query
def p6_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every chapter, one row per chapter."""
    return _chapter_statistics(spark, folder).select("chapter_uid", "n_words", "n_chars", "s.*").dropDuplicates(["chapter_uid"])


def _declared(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, declared ARRAY<STRING>): the languages that the labels of a book's latest harvest name."""
    books = table(spark, folder, "epub_metadata", "book_id", "harvested_at", "harvest_id", "languages")
    latest = books.groupBy("book_id").agg(F.max_by("languages", F.struct("harvested_at", "harvest_id")).alias("languages"))
    return latest.select("book_id", F.array_distinct(F.array_compact(F.transform("languages", language.declared))).alias("declared"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """(chapter_uid, book_id, segments) of every chapter with content; the detector is trained on the labelled ones."""
    chapters = table(spark, folder, "chapters", "chapter_uid", "book_id", "content").where("content IS NOT NULL")
    labels = _declared(spark, folder).where("size(declared) = 1").select("book_id", F.col("declared")[0].alias("label"))
    frequent = [(r.lang, r.word) for r in table(spark, folder, "common_words", "lang", "word").where("lang IS NOT NULL AND word IS NOT NULL").limit(COMMON_WORDS_BOUND + 1).collect()]
    if len(frequent) > COMMON_WORDS_BOUND:
        raise ValueError("common_words is larger than its bound")
    texts = language.sample(chapters.join(labels, "book_id"), chapters, "chapter_uid", "content", "label")
    detector = language.Detector(texts, frequent)
    return spread(chapters).select("chapter_uid", "book_id", language.segments(F.col("content"), detector).alias("segments"))


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters and languages in which they have a stretch of twelve words or more that their book doesn't declare."""
    each = _segments(spark, folder).select("chapter_uid", "book_id", F.explode("segments").alias("s")).where("s.n_words >= 12").select("chapter_uid", "book_id", F.col("s.lang").alias("lang")).distinct()
    return each.join(_declared(spark, folder), "book_id", "left").where("declared IS NULL OR NOT array_contains(declared, lang)").select("chapter_uid", "lang")


@query
def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of every chapter with its language and confidence; a chapter of one language is one segment."""
    each = _segments(spark, folder).dropDuplicates(["chapter_uid"]).select("chapter_uid", F.posexplode("segments").alias("segment", "s"))
    return each.select("chapter_uid", F.col("segment").cast("bigint").alias("segment"), "s.start_word", "s.end_word", "s.n_words", "s.lang", F.round("s.confidence", 4).alias("confidence"))


def _shared_spans(spark: SparkSession, folder: str) -> SharedSpans:
    return SharedSpans(spread(table(spark, folder, "documents", "doc_id", "text")), "doc_id", "text")


@query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents whose texts have a common span of at least 200 code points."""
    return _shared_spans(spark, folder).pairs().select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))


@query
def p9_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """For each document its class of copies, its links to other classes, and how much of its text also stands elsewhere."""
    spans = _shared_spans(spark, folder)
    short = table(spark, folder, "documents", "doc_id", F.char_length("text").cast("bigint").alias("n")).dropDuplicates(["doc_id"])
    each = spans.coverage().withColumnRenamed("id", "doc_id")
    return short.join(each, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_chars"), F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"),
    )


def _sizes(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY, weights: bool = False) -> DataFrame:
    """(doc_id, source, n[, weight]): documents with their size in tokens; texts are tokenised once and the sizes checkpointed."""
    documents = spread(table(spark, folder, "documents", "doc_id", "source", "text"))
    extra = []
    if weights:
        trees = document_quality.train(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", _common_words(spark, folder))
        extra.append(document_quality.quality_weight(F.col("text"), trees).alias("weight"))
    return checkpointed(documents.select("doc_id", "source", F.coalesce(count_tokens(F.col("text"), vocabulary), F.lit(0)).alias("n"), *extra))


@query
def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers of every capacity: one row per document, or per piece of one that is larger than the capacity."""
    packs = table(spark, folder, "pack_targets", "pack_name", "capacity_tokens").where("pack_name IS NOT NULL AND capacity_tokens IS NOT NULL").distinct().orderBy("pack_name").limit(MOST_TARGETS + 1).collect()
    return pack_all(_sizes(spark, folder), "doc_id", "n", [(r.pack_name, r.capacity_tokens) for r in packs]).withColumnRenamed("n", "n_tokens")


@query
def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of every capacity are."""
    packs = table(spark, folder, "pack_targets", "pack_name", "capacity_tokens").distinct()
    containers = p7_packed(spark, folder).groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    each = containers.groupBy("pack_name").agg(F.count("*").alias("n_containers"), F.sum("k").alias("n_items"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    return each.join(F.broadcast(packs), "pack_name").select("pack_name", "capacity_tokens", "n_containers", "n_items", "n_tokens", "fullest", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("filled"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = _sizes(spark, folder, weights=True).withColumnRenamed("doc_id", "id")
    return mix(records, table(spark, folder, "mix_targets"))


@query
def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix with the number of times that each is used."""
    return _mix(spark, folder)[0].select(F.col("id").alias("doc_id"), "source", F.col("n").alias("n_tokens"), "repeats")


@query
def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mix(spark, folder)[1]


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    books = spread(table(spark, folder, "epub_metadata", "authors", "contributors", "publisher"))
    return names.linked(books, ["authors", "contributors"], ["publisher"], table(spark, folder, "given_name_forms"))


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different spellings of one person or organisation."""
    return names.pairs(_entities(spark, folder))


@query
def p3_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with its entity and how often it is used."""
    return _entities(spark, folder).select("spelling", "n", "kind", "entity")


# Shared spans by every window of 200 characters, for small tables: windows are 200 times their texts.
_WINDOWS = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200), t AS (SELECT text, min(doc_id) AS class_id, count(*) AS n FROM d GROUP BY text), m AS (SELECT doc_id, class_id FROM d JOIN t USING (text)),
w AS (SELECT class_id, i, substr(text, i, 200) AS s FROM (SELECT class_id, text, unnest(range(1, length(text) - 198)) AS i FROM t)), shared AS (SELECT s FROM w GROUP BY s HAVING min(class_id) <> max(class_id)),
hit AS (SELECT w.class_id, w.i, w.s FROM w SEMI JOIN shared USING (s)), links AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM hit a JOIN hit b ON a.s = b.s AND a.class_id <> b.class_id)
"""
SQL["p9_found"] = _WINDOWS + """SELECT x.doc_id AS doc_a, y.doc_id AS doc_b FROM m x JOIN m y ON x.class_id = y.class_id AND x.doc_id < y.doc_id
UNION ALL SELECT x.doc_id, y.doc_id FROM links JOIN m x ON x.class_id = a JOIN m y ON y.class_id = b WHERE x.doc_id < y.doc_id"""
SQL["p9_coverage"] = _WINDOWS + """, cov AS (SELECT class_id, sum(least(200, coalesce(following - i, 200))) AS k FROM (SELECT class_id, i, lead(i) OVER (PARTITION BY class_id ORDER BY i) AS following FROM hit) GROUP BY class_id),
k AS (SELECT a AS class_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(m.class_id, doc_id) AS class_id, coalesce(t.n, 1) AS n_copies, coalesce(n_links, 0) AS n_links, CAST(coalesce(length(o.text), 0) AS BIGINT) AS n_chars,
CAST(CASE WHEN t.n > 1 THEN length(o.text) ELSE coalesce(k, 0) END AS BIGINT) AS shared_chars
FROM (SELECT DISTINCT doc_id, text FROM documents) o LEFT JOIN m USING (doc_id) LEFT JOIN t ON t.class_id = m.class_id LEFT JOIN k ON k.class_id = m.class_id LEFT JOIN cov ON cov.class_id = m.class_id"""
