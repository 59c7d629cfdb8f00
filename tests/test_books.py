import io
import json
import zipfile

import pyarrow as pa
import pytest
from books import META, X, basic, container, package, page
from pyspark.sql import functions as F

from quirework.api import Book
from quirework.functions import css, opf, text
from quirework.operators.library import PIECE, Library, flattened, in_pieces, joined, link_targets, resolved, styled_elements
from quirework.sources.epub import accepted, write_archive
from quirework.streaming.folder import follow, write_chapters


def rows(frame, *order):
    return [r.asDict(recursive=True) for r in frame.orderBy(*order).collect()]


def test_container():
    assert opf.parse_container(container("OEBPS/content.opf")) == "OEBPS/content.opf"
    assert opf.parse_container(container("a.opf", "b.opf")) == "b.opf"
    with pytest.raises(opf.BookError) as error:
        opf.parse_container(b"<container><!-- none --></container>")
    assert error.value.kind == "InvalidFormat"
    with pytest.raises(opf.BookError) as error:
        opf.parse_container(b"<container>")
    assert error.value.kind == "Xml"


def test_package_rules():
    got = opf.parse_package(package("<dc:title>One</dc:title><dc:title>A &amp; B</dc:title><dc:subject>x</dc:subject><dc:subject>x</dc:subject><dc:rights> </dc:rights>",
                                    [("a", "a%20b.xhtml", X, ""), ("a", "c.xhtml", X, ""), ("", "d", X, ""), ("p", "c.png", "image/png", ' properties="svg cover-image"')], ["a", "zz", "a"]))
    assert got["title"] == "A & B" and got["subjects"] == ["x", "x"] and got["rights"] is None
    assert got["spine"] == ["a", "zz", "a"] and [m[1] for m in got["manifest"]] == ["a%20b.xhtml", "c.xhtml", "c.png"]
    assert got["cover_image_id"] == "p" and got["version"] == "3.0"
    with pytest.raises(opf.BookError):
        opf.parse_package(b"<package><metadata></package>")


def test_paths():
    assert joined("OEBPS/content.opf", "a.xhtml") == "OEBPS/a.xhtml" and joined("content.opf", "a.xhtml") == "a.xhtml" and joined("x/c.opf", "/a") == "/a"
    assert resolved("OEBPS/text/a.xhtml", "../b.xhtml#f") == "OEBPS/b.xhtml#f" and resolved("a/b.x", "mailto:x") == "mailto:x" and resolved("a/b.x", " ") == "a/b.x" and resolved("a/b", "..\\..\\c") == "c"


def test_metadata_and_grid(spark):
    library = Library.from_bytes(spark, [("b/one.epub", basic()), ("two.epub", basic("meta", base="")), ("bad.epub", b"no archive"), ("empty.epub", b"")])
    meta = rows(library.metadata(), "book_id")
    assert [m["book_id"] for m in meta] == ["b/one.epub", "two.epub"]
    assert meta[0]["title"] == "A Book" and meta[0]["authors"] == ["Ann", "Bo"] and meta[0]["publication_date"] == "2001" and meta[0]["chapter_count"] == 3
    assert all(m["has_cover"] and m["cover_image_format"] == "image/png" for m in meta)
    assert {(r["book_id"], r["title"]) for r in rows(library.grid(), "book_id")} == {("b/one.epub", "A Book"), ("two.epub", "A Book"), ("bad.epub", "bad"), ("empty.epub", "empty")}
    assert {r["error_kind"] for r in rows(library.packages().where("error_kind is not null"), "book_id")} == {"Zip"}
    assert all(r["is_valid"] for r in rows(library.validation(), "book_id"))
    none = rows(Library.from_bytes(spark, [("n", basic(meta=""))]).validation(), "book_id")[0]
    assert none["errors"] == ["missing title", "missing language", "missing identifier"]


def test_chapters_policies(spark):
    book = basic(spine=("c1", "nowhere", "gone", "bad", "c2", "c1"), manifest=[("gone", "gone.xhtml", X, ""), ("bad", "bad.xhtml", X, "")], files={"OEBPS/bad.xhtml": b"<p>caf\xe9 x</p>"})
    library = Library.from_bytes(spark, [("x", book)])
    skip = rows(library.chapters(), "spine_pos")
    assert [(c["spine_pos"], c["chapter_index"], c["id"], c["title"]) for c in skip] == [(0, 0, "c1", "TOne"), (4, 1, "c2", "second   page"), (5, 2, "c1", "TOne")]
    assert skip[0]["content"] == "TOne\nHello world"  # title text stays, and only block elements end a line
    report = rows(library.chapters("report"), "spine_pos")
    assert [(c["spine_pos"], c["error_kind"]) for c in report] == [(0, None), (2, "MissingFile"), (3, None), (4, None), (5, None)]
    assert report[2]["content"] == "caf� x" and report[0]["title"] is None and report[0]["id"] == ""
    lossy = rows(library.chapters("lossy"), "spine_pos")
    assert [c["spine_pos"] for c in lossy] == [0, 3, 4, 5]
    analysis = rows(library.analysis(), "book_id")[0]
    assert analysis["n_chapters"] == 4 and analysis["chapter_count"] == 6 and analysis["total_words"] == sum(c["word_count"] for c in lossy)
    totals = rows(library.totals(), "book_id")[0]
    assert totals["total_chars"] == sum(c["char_count"] for c in skip) and all(c["char_count"] >= c["word_count"] for c in skip)


def test_toc_and_duplicates(spark):
    book = basic(files={"OEBPS/c2.xhtml": b"<p> </p>"}, extra=[("OEBPS/c1.xhtml", page("<p>second copy</p>"))])
    toc = rows(Library.from_bytes(spark, [("x", book)]).toc(), "chapter_index")
    assert [(t["chapter_index"], t["title"], t["chapter_href"]) for t in toc] == [(0, "TOne", "OEBPS/c1.xhtml"), (1, "c2", "OEBPS/c2.xhtml"), (2, "Tthird link", "OEBPS/text/c3.xhtml")]
    entries = Library.from_bytes(spark, [("x", book)]).entries()
    assert entries.where("entry_path = 'OEBPS/c1.xhtml'").count() == 2
    data = Library.from_bytes(spark, [("x", book)]).read_resource("OEBPS/c1.xhtml").first()
    assert b"Hello" in data.data and Library.from_bytes(spark, [("x", book)]).read_resource("nope").first().error_kind == "MissingFile"


def test_covers(spark):
    dangling = basic(cover="none", meta=META + '<meta name="cover" content="zz"/>')
    missing = basic(cover="meta", files={"OEBPS/images/c.png": b"1"})
    without = basic(cover="none")
    got = {r["book_id"]: r for r in rows(Library.from_bytes(spark, [("a", basic()), ("b", dangling), ("c", without), ("d", missing)]).covers(), "book_id")}
    assert bytes(got["a"]["data"]) == b"\x89PNG" and got["a"]["size"] == 4
    assert got["b"]["error_kind"] == got["c"]["error_kind"] == "MissingFile" and got["b"]["error_msg"] != got["c"]["error_msg"]
    meta = rows(Library.from_bytes(spark, [("b", dangling)]).metadata(), "book_id")[0]
    assert meta["has_cover"] and meta["cover_image_format"] is None


def test_trees_and_styles(spark):
    library = Library.from_bytes(spark, [("x", basic(files={"OEBPS/css/b.css": b"@media print { p { color: pink } } h1, { margin: 1px } #m.hi { x: y }"}, manifest=[("s2", "css/b.css", "text/css", "")]))])
    chapters = rows(library.chapters(with_ast=True), "spine_pos")
    tree = json.loads(chapters[2]["ast"])
    assert '"OEBPS/c1.xhtml#f"' in chapters[2]["ast"] and tree["tag"] == "root" and chapters[0]["title"] == "One"
    nodes = library.ast_nodes()
    hi = rows(nodes.where("attrs['class'] = 'hi'"), "node_id")[0]
    assert hi["styles"] == {"color": "blue", "font-weight": "bold", "margin": "1px", "x": "y"}
    assert rows(nodes.where("tag = 'h1'"), "node_id")[0]["styles"] == {"margin": "1px"}
    styled = {(r["chapter_index"], r["node_id"]): r["styles"] for r in rows(styled_elements(nodes, library.css_rules()), "node_id")}
    for n in rows(nodes.where("kind = 'Element'"), "node_id"):
        assert styled.get((n["chapter_index"], n["node_id"]), {}) == n["styles"]
    rules = rows(library.css_rules(), "sheet_pos", "rule_id")
    assert [r["kind"] for r in rules] == ["style", "style", "media", "style", "style", "style"] and rules[3]["parent_rule_id"] == 0


def test_passes_hold_pieces_only(spark):
    made = []
    pieces = in_pieces((made.append(i) or (i, {"k": "v"}) for i in range(100)), pa.schema([("i", pa.int64()), ("m", pa.map_(pa.string(), pa.string()))]), 8)
    assert next(pieces).num_rows == 8 and len(made) == 8
    assert [p.num_rows for p in pieces] == [8] * 11 + [4]
    library = Library.from_bytes(spark, [("x", basic(files={"OEBPS/c1.xhtml": page("<p class='hi'>one<br>two</p>" * PIECE)})), ("y", basic(spine=())), ("z", b"no archive")])
    keys = ("book_id", "chapter_index", "node_id")
    nodes = rows(library.ast_nodes().drop("chapter_id"), *keys)
    assert nodes == rows(flattened(library.chapters(with_ast=True)), *keys) and sum(n["tag"] == "br" and n["depth"] == 4 for n in nodes) == PIECE
    bare = library.ast_nodes(styled=False, only="Element")
    assert rows(bare.drop("chapter_id"), *keys) == [n | {"styles": None} for n in nodes if n["kind"] == "Element"]
    styled = rows(styled_elements(bare, library.css_rules()), *keys)
    assert styled == [{k: n[k] for k in (*keys, "styles")} for n in nodes if n["styles"]] and len(styled) > PIECE


def test_inline_declarations(spark):
    blocks = ["", ";", "a", "a:", ":b", "a: b", " a : b:c ; a: d;;x:y", "q: 'a;b'; r: \"c;'d\"; s: 'it", "u: url(a;b)", "\u00a0a\u2003:\u00a0b\n", "a: 'x' ; b: \"\"", "k: \x1cv\x1c", "a: b\nc; d: e\n", None]
    got = spark.createDataFrame(list(enumerate(blocks)), "i int, b string").select("i", text.declarations(F.col("b")).alias("d")).collect()
    assert {r["i"]: {e["key"]: e["value"] for e in r["d"]} for r in got} == {i: css.declarations(b or "") for i, b in enumerate(blocks)}


def test_links_and_resources(spark):
    library = Library.from_bytes(spark, [("x", basic())])
    wanted = spark.createDataFrame([("x", 2, h) for h in ("../c1.xhtml#f", "OEBPS/c1.xhtml#a", "OEBPS/./c1.xhtml#a#b", "http://a/b", "#q", " OEBPS/c2.xhtml ", "img.png")] + [("x", 9, "../c1.xhtml"), ("x", 9, "OEBPS/c1.xhtml")], "book_id string, chapter_index bigint, href string")
    got = {(r["chapter_index"], r["href"]): (r["path"], r["error_kind"]) for r in rows(library.resolve(wanted), "href")}
    assert got[2, "../c1.xhtml#f"] == ("OEBPS/c1.xhtml#f", None) and got[2, "OEBPS/c1.xhtml#a"] == ("OEBPS/c1.xhtml#a", None) and got[2, "OEBPS/./c1.xhtml#a#b"] == ("OEBPS/c1.xhtml#a", None)
    assert got[2, "http://a/b"][0] == "http://a/b" and got[2, "#q"][0] == "#q" and got[2, " OEBPS/c2.xhtml "][0] == "OEBPS/c2.xhtml" and got[2, "img.png"][0] == "OEBPS/text/img.png"
    assert got[9, "../c1.xhtml"] == (None, "ChapterError") and got[9, "OEBPS/c1.xhtml"] == ("OEBPS/c1.xhtml", None)
    data = {r["href"]: (r["data"], r["error_kind"]) for r in rows(library.read_chapter_resource(wanted.where("chapter_index = 2")), "href")}
    assert b"Hello" in data["../c1.xhtml#f"][0] and data["#q"][1] == "MissingFile" and data["img.png"][1] == "MissingFile"


def test_link_targets_and_sinks(spark, tmp_path):
    library = Library.from_bytes(spark, [("x.epub", basic(spine=("c1", "c2", "c1", "c3")))]).kept()
    wanted = spark.createDataFrame([("x.epub", 3, h) for h in ("../c1.xhtml#f", "http://a", "../css/a.css", "#q")], "book_id string, chapter_index bigint, href string")
    got = {r.path: r.chapter_index for r in link_targets(library.resolve(wanted), library.toc()).collect()}
    assert got == {"OEBPS/c1.xhtml#f": 2, "OEBPS/css/a.css": None}  # of two entries of a file the later
    library.write_resources(str(tmp_path / "out"), ["OEBPS/images/c.png"])
    saved = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.entry_path, r.size, bytes(r.data)) for r in saved] == [("OEBPS/images/c.png", 4, b"\x89PNG")]
    assert accepted(library.books).count() == 1 and library.chapter(1).first().id == "c2"
    with io.BytesIO(basic()) as reader:
        assert Book(spark, reader).get_title() == "A Book"
    library.books.unpersist()


def test_scanner_text_and_entities_in_attributes(spark):
    book = basic(files={"OEBPS/a&b.xhtml": page("<p>x &amp; y</p>", "")}, manifest=[("amp", "a&amp;b.xhtml", X, "")], spine=("amp",))
    library = Library.from_bytes(spark, [("x", book)])
    assert library.chapters().first().content == "x & y" and library.chapters(scanner=True).first().content == "x &amp; y"


def test_facade(spark, tmp_path):
    path = tmp_path / "a.epub"
    path.write_bytes(basic(compress=False))
    book = Book(spark, str(path))
    assert book.get_title() == "A Book" and book.get_chapter_count() == 3 and book.get_metadata_is_valid() and book.has_cover()
    assert book.get_cover_image() == b"\x89PNG" and book.get_cover_image_len() == 4 and book.get_cover_image_format() == "image/png"
    assert book.extract_text_only() == [c.content for c in book.stream_chapters()]
    assert book.total_word_count() > 0 and len(book.get_toc()) == 3 and book.get_chapter(1)["ast"]["tag"] == "root"
    assert json.loads(book.get_cover_image_json()) == [137, 80, 78, 71] and "A Book" in book.report()
    assert book.resolve_chapter_resource_path(2, "../c1.xhtml") == "OEBPS/c1.xhtml"
    assert "color: blue" in book.rendered(1) and book.page_number("x", 1) == 1 and book.page_number(99) == 2 and book.page_number(-4) == 0
    assert book.get_total_word_count() == book.total_word_count() and book.get_resource("mimetype") == b"application/epub+zip"
    with pytest.raises(opf.BookError):
        book.get_chapter(7)
    late = Book(spark, b"nothing")  # opening never fails, reading does
    with pytest.raises(opf.BookError):
        late.get_metadata()


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.epub").write_bytes(basic())
    (folder / "x.txt").write_text("no book")
    query = write_chapters(follow(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state"), "skip")
    query.awaitTermination(60)
    batch = Library.read(spark, str(folder))
    key = lambda f: sorted((r.spine_pos, r.content, r.word_count) for r in f.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch.chapters()) and batch.books.count() == 3


def test_unknown_compression_is_an_error_row(spark):
    data = bytearray(basic())
    name = b"OEBPS/c1.xhtml"
    at = data.rfind(name) - 46  # the directory entry
    data[at + 10 : at + 12] = (9).to_bytes(2, "little")
    got = {r["entry_path"]: r for r in rows(Library.from_bytes(spark, [("x", bytes(data))]).entries(), "entry_idx")}
    assert got["OEBPS/c1.xhtml"]["error_kind"] == "Zip" and got["OEBPS/c2.xhtml"]["error_kind"] is None
    assert zipfile.ZIP_DEFLATED == 8
    empty = Library.from_bytes(spark, [])
    assert empty.chapters().count() == 0 and empty.metadata().count() == 0
    assert rows(Library.from_bytes(spark, [("x", write_archive([("a", b"1")]))]).packages(), "book_id")[0]["error_kind"] == "MissingFile"


def test_one_shot_analysis(spark, tmp_path):
    import io as streams

    from quirework import api

    (tmp_path / "a.epub").write_bytes(basic())
    got = api.analyze_path(spark, f"{tmp_path}/a.epub")
    assert got["metadata"]["title"] == "A Book" and got["chapter_count"] == 3 and got["first_chapter_preview"].startswith("TOne") and got["total_words"] == Book(spark, basic()).total_word_count()
    assert api.analyze_reader(spark, streams.BytesIO(basic())) == api.analyze_sync_reader(spark, streams.BytesIO(basic())) == got
    with pytest.raises(opf.BookError):
        api.analyze_reader(spark, streams.BytesIO(b"no archive"))
    empty = Library.from_bytes(spark, [("e", basic(spine=()))]).analysis().first()
    assert empty.n_chapters == 0 and empty.first_chapter_preview is None and Library.from_bytes(spark, [("x", b"")]).analysis().count() == 0


def test_single_chapter_text_reads_no_trees(spark):
    book = Book(spark, basic())
    assert book.get_chapter_text(1).startswith("second") and not [k for k in book._kept if k.startswith("chapters")]
    with pytest.raises(opf.BookError):
        book.get_chapter_text(7)


def test_showcase_navigation_and_acceptance(spark):
    from quirework.operators.library import navigation

    library = Library.from_bytes(spark, [("b/one.epub", basic()), ("two.epub", basic(cover="none", meta="")), ("bad.EPUB", b"x")])
    got = {r.book_id: (r.title, r.has_cover, r.media_type, r.data is None) for r in library.showcase().collect()}
    assert got == {"b/one.epub": ("A Book", True, "image/png", False), "two.epub": ("two", False, None, True), "bad.EPUB": ("bad", False, None, True)}
    found = spark.createDataFrame([("x", p) for p in ("#top", "#", "", "http://a/b#c", "OEBPS/c1.xhtml#q", "/OEBPS/c2.xhtml", "nowhere#z")], "book_id string, path string")
    went = {r.path: (r.action, r.chapter_index, r.fragment) for r in navigation(found, Library.from_bytes(spark, [("x", basic())]).toc()).collect()}
    assert went == {"#top": ("scroll", None, "top"), "#": ("scroll", None, None), "": ("none", None, None), "http://a/b#c": ("open", None, None), "OEBPS/c1.xhtml#q": ("go", 0, "q"), "/OEBPS/c2.xhtml": ("go", 1, None), "nowhere#z": ("none", None, None)}
    files = spark.createDataFrame([("a.epub", None), ("b.zip", "application/epub+zip"), ("c.txt", "text/plain")], "path string, media_type string")
    assert {r.path for r in accepted(files, "media_type").collect()} == {"a.epub", "b.zip"} and {r.path for r in accepted(files).collect()} == {"a.epub"}


def test_links_of_many_chapters_and_books(spark):
    library = Library.from_bytes(spark, [("x", basic()), ("y", basic(base="")), ("bad", b"")])
    wanted = spark.createDataFrame([("x", 0, "css/a.css"), ("x", 0, "css/a.css"), ("y", 5000, "css/a.css"), ("y", 5000, "../zz"), ("y", None, "images/c.png"), ("bad", 0, "c1.xhtml"), ("none", 0, "c1.xhtml"), ("x", 1, None)], "book_id string, chapter_index bigint, href string")
    got = {(r.book_id, r.chapter_index, r.href): (r.data is not None, r.error_kind) for r in library.read_chapter_resource(wanted).collect()}
    assert got[("x", 0, "css/a.css")] == (True, None) and got[("y", 5000, "css/a.css")] == (True, None) and got[("y", 5000, "../zz")] == (False, "ChapterError") and got[("y", None, "images/c.png")] == (True, None)
    assert got[("bad", 0, "c1.xhtml")] == (False, "Zip") and ("none", 0, "c1.xhtml") not in got
