"""Text expressions of chapters; all run in the JVM inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK_ENDS = r"(?U)^\s+|\s+$"


def clean_lines(text: Column) -> Column:
    """Lines without Unicode white space at their ends, blank ones dropped, joined by a line feed."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, _BLANK_ENDS, "")), lambda x: x != ""), "\n")


def word_count(text: Column) -> Column:
    """Tokens separated by Unicode white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def char_count(text: Column) -> Column:
    """Unicode code points."""
    return F.char_length(text).cast("bigint")


def first_line(text: Column) -> Column:
    """First line that isn't blank, without white space at its ends; null if there is none."""
    return F.nullif(F.element_at(F.split(clean_lines(text), "\n"), 1), F.lit(""))


def preview(text: Column, size: int = 300) -> Column:
    return F.left(text, F.lit(size))


def paragraphs(text: Column) -> Column:
    """Paragraphs: text divided at blank lines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.regexp_replace(x, _BLANK_ENDS, "")), lambda x: x != "")


def lossy_text(data: Column) -> Column:
    """Bytes as UTF-8 text, invalid sequences replaced."""
    return F.make_valid_utf8(data.cast("string"))


def strict_text(data: Column) -> Column:
    """Bytes as UTF-8 text, null where they are invalid."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading full stop begins a name, not an extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def toc_title(title: Column, href: Column) -> Column:
    """The title where it isn't blank, else the file's stem, else a placeholder."""
    return F.coalesce(F.when(F.regexp_replace(title, r"(?U)\s+", "") != "", title), F.nullif(file_stem(href), F.lit("")), F.lit("Untitled Chapter"))


def image_type(path: Column) -> Column:
    """MIME type of an image by its extension; JPEG where it isn't known."""
    low = F.lower(path)
    return (
        F.when(low.endswith(".png"), "image/png").when(low.endswith(".gif"), "image/gif").when(low.endswith(".webp"), "image/webp")
        .when(low.endswith(".svg"), "image/svg+xml").otherwise("image/jpeg")
    )


def markup_text(html: Column) -> Column:
    """Plain text of markup by a scanner without a parser: tags removed, block tags (open or close) end a line, white space collapsed.

    Tags whose name begins with p, div, br, h or li are blocks. Entities are left as they are. The low-memory form of
    ``html.text``: no Python, one pass of regular expressions.
    """
    marked = F.regexp_replace(html, r"(?i)<(?U:\s*)/*(?:p|div|br|h|li)[^>]*>", "\u0001")
    bare = F.regexp_replace(F.regexp_replace(marked, r"<[^>]*(>|$)", ""), r"(?U)\s+", " ")
    lines = F.transform(F.split(bare, "\u0001"), lambda x: F.regexp_replace(x, _BLANK_ENDS, ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def validation_errors(title: Column, languages: Column, identifiers: Column) -> Column:
    """What a package's metadata lacks, in the order title, language, identifier."""
    blank = title.isNull() | (F.regexp_replace(title, r"(?U)\s+", "") == "")
    return F.array_compact(F.array(
        F.when(blank, "missing title"), F.when(F.coalesce(F.size(languages), F.lit(0)) <= 0, "missing language"), F.when(F.coalesce(F.size(identifiers), F.lit(0)) <= 0, "missing identifier"),
    ))


def declarations(block: Column) -> Column:
    """(key, value) of a style block in source order; the twin of ``css.declarations``, of which the last of equal names wins. Empty for null."""
    # tokens are quoted pieces, runs without quotes and semicolons, and the semicolons that divide
    tokens = F.regexp_extract_all(block, F.lit(r"""\"[^"]*+\"?|'[^']*+'?|[^;"']++|;"""), F.lit(0))
    parts = F.split(F.array_join(F.transform(tokens, lambda t: F.when(t == ";", "\ufdd0").otherwise(t)), ""), "\ufdd0")

    def trimmed(x: Column) -> Column:
        return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")

    pairs = F.transform(parts, lambda p: F.struct(trimmed(F.substring_index(p, ":", 1)).alias("key"), trimmed(F.when(F.contains(p, F.lit(":")), F.substr(p, F.locate(":", p) + 1)).otherwise("")).alias("value")))
    return F.coalesce(F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != "")), F.array().cast("array<struct<key:string,value:string>>"))
