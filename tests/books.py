"""Archives for the tests, built in memory."""

from quirework.sources.epub import write_archive

CONTAINER = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles>{}</rootfiles></container>'


def container(*paths):
    return CONTAINER.format("".join(f'<rootfile full-path="{p}" media-type="application/oebps-package+xml"/>' for p in paths)).encode()


def package(metadata="", manifest=(), spine=(), version="3.0"):
    items = "".join(f'<item id="{i}" href="{h}" media-type="{t}"{e}/>' for i, h, t, e in manifest)
    refs = "".join(f'<itemref idref="{i}"/>' for i in spine)
    return f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="{version}"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{metadata}</metadata><manifest>{items}</manifest><spine>{refs}</spine></package>'.encode()


META = "<dc:title>A Book</dc:title><dc:creator>Ann</dc:creator><dc:creator>Bo</dc:creator><dc:language>en</dc:language><dc:identifier>x1</dc:identifier><dc:date>2001</dc:date>"
X = "application/xhtml+xml"


def page(body, head="<title>T</title>"):
    return f"<html><head>{head}</head><body>{body}</body></html>".encode()


def basic(cover="property", base="OEBPS/", extra=(), meta=META, spine=("c1", "c2", "c3"), files=(), manifest=(), compress=True):
    cover_item = ("cov", "images/c.png", "image/png", ' properties="cover-image"' if cover == "property" else "")
    if cover == "meta":
        meta += '<meta name="cover" content="cov"/>'
    items = [("c1", "c1.xhtml", X, ""), ("c2", "c2.xhtml", X, ""), ("c3", "text/c3.xhtml", X, ""), cover_item, ("s1", "css/a.css", "text/css", ""), *manifest]
    content = {
        f"{base}c1.xhtml": page("<h1>One</h1><p>Hello world</p>"), f"{base}c2.xhtml": page("<p>second   page</p><p class='hi' id='m' style='color: blue'>x</p>", ""),
        f"{base}text/c3.xhtml": page("<p>third <a href='../c1.xhtml#f'>link</a></p>"), f"{base}images/c.png": b"\x89PNG", f"{base}css/a.css": b"p { color: red } .hi { font-weight: bold }",
    }
    content.update(files)
    return write_archive([("mimetype", b"application/epub+zip"), ("META-INF/container.xml", container(f"{base}content.opf")), (f"{base}content.opf", package(meta, items, spine)), *content.items(), *extra], compress)
