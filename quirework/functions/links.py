"""Paths and links inside a book, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXTERNAL = r"^(#|https?://|mailto:|data:|blob:)"


def is_external(href: Column) -> Column:
    """Whether a link leads out of the book or stays on its page: empty, a fragment, or one of the known schemes (case-sensitive)."""
    return (href == "") | href.rlike(_EXTERNAL)


def normal_path(path: Column) -> Column:
    """A path with forward slashes, without empty and ``.`` segments, ``..`` resolved; it can't climb above the root."""
    steps = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(walked, "/")


def parent(path: Column) -> Column:
    """The directory of a path, empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def joined(base_file: Column, href: Column) -> Column:
    """A manifest link beside its package file: joined to the directory as it is (``..`` stays), absolute ones replace it."""
    folder = parent(base_file)
    return F.when(href.startswith("/"), href).when(folder == "", href).otherwise(F.concat(folder, F.lit("/"), href))


def resolved(base_file: Column, href: Column) -> Column:
    """A link resolved against the file it stands in: external ones unchanged, blank ones the file itself, the fragment kept."""
    target = F.regexp_replace(href, r"(?s)#.*$", "")
    fragment = F.regexp_extract(href, r"(?s)(#.*)$", 1)
    slashes = F.regexp_replace(target, r"\\", "/")
    folder = parent(F.regexp_replace(base_file, r"\\", "/"))
    path = F.when(slashes.startswith("/"), slashes).when(folder == "", slashes).otherwise(F.concat(folder, F.lit("/"), slashes))
    blank = F.regexp_replace(href, r"(?U)\s+", "") == ""
    return F.when(blank, base_file).when(is_external(href), href).otherwise(F.concat(normal_path(path), fragment))


def chapter_key(path: Column) -> Column:
    """The key that a link and a table of contents entry have in common: without fragment and leading slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"(?s)#.*$", ""), r"\\", "/"), r"^/", "")
