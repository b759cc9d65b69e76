"""Readers of EPUB, FB2 and CBZ files from their bytes: metadata records and text for matching."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

from bindery.functions.formats import text_of_html
from bindery.schema import NAMES

XML_BYTES, MEMBER_BYTES = 8 << 20, 16 << 20
#: Names of meta elements and the fields they hold.
EPUB_META = {
    f"calibre:{name}": name
    for name in ("series", "series_index", "subtitle", "original_title", "edition", "collection", "rating", "identifiers", "catalog_url")
}
#: Elements of a comic's record and the fields they hold.
COMIC_TEXT = {
    "Title": "title", "Series": "series", "Number": "series_index", "Summary": "comments", "Publisher": "publisher", "Web": "catalog_url",
    "LanguageISO": "languages", "Format": "edition", "SeriesGroup": "collection", "CommunityRating": "rating",
}
COMIC_LISTS = {"Writer": "authors", "Translator": "translators", "Genre": "tags"}
ROLES = {"aut": "authors", "author": "authors", "trl": "translators", "translator": "translators"}
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".tif", ".tiff", ".bmp")
_ISBN = re.compile(r"(?i)(?:ISBN(?:-1[03])?[\s]*[:#]?\s*)?((?:97[89][\s-]?)?[0-9][0-9Xx\s-]{8,19}[0-9Xx])")


def find_isbns(text: str) -> list[str]:
    out: dict[str, None] = {}
    for run in _ISBN.findall(text):
        code = re.sub("[^0-9Xx]", "", run).upper()
        if re.fullmatch("[0-9]{9}[0-9X]", code) and sum((10 - k) * (10 if c == "X" else int(c)) for k, c in enumerate(code)) % 11 == 0:
            out[code] = None
        elif re.fullmatch("97[89][0-9]{10}", code) and sum((1 + 2 * (k % 2)) * int(c) for k, c in enumerate(code)) % 10 == 0:
            out[code] = None
    return list(out)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def text_at(node, *path: str) -> str:
    for name in path:
        node = next((c for c in node if local(c.tag) == name), None) if node is not None else None
    return (node.text or "").strip() if node is not None else ""


def child(node, name: str):
    return next((c for c in node if local(c.tag) == name), None) if node is not None else None


def read_xml(archive: zipfile.ZipFile, name: str):
    info = archive.getinfo(name)
    if info.file_size > XML_BYTES:
        raise ValueError(f"{name} is too large")
    return ElementTree.fromstring(archive.read(info))


def member(archive: zipfile.ZipFile, name: str) -> bytes:
    """A member's bytes, nothing if it is absent or too large."""
    try:
        info = archive.getinfo(name)
    except KeyError:
        return b""
    return archive.read(info) if info.file_size <= MEMBER_BYTES else b""


def epub_package(archive: zipfile.ZipFile) -> tuple[str, ElementTree.Element]:
    container = read_xml(archive, "META-INF/container.xml")
    path = next((n.get("full-path") for n in container.iter() if local(n.tag) == "rootfile" and n.get("full-path")), None)
    if not path:
        raise ValueError("no package in the container")
    return path, read_xml(archive, path)


def contributors(meta) -> dict[str, list[str]]:
    """Authors and translators by inline role, else by refinement, else a creator is an author."""
    refined = {(n.get("refines") or "").removeprefix("#"): (n.text or "").strip() for n in meta if local(n.tag) == "meta" and n.get("property") == "role"}
    out: dict[str, list[str]] = {"authors": [], "translators": []}
    for n in meta:
        if local(n.tag) not in ("creator", "contributor") or not (n.text or "").strip():
            continue
        role = n.get("role") or n.get("{http://www.idpf.org/2007/opf}role") or refined.get(n.get("id", ""), "") or ("aut" if local(n.tag) == "creator" else "")
        if found := ROLES.get(role.strip().lower()):
            out[found].append(n.text.strip())
    return out


def read_epub(raw: bytes, path: str = "") -> dict:
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        _, root = epub_package(archive)
    meta = child(root, "metadata")
    if meta is None:
        raise ValueError("the package has no metadata")
    every = lambda name: [n.text.strip() for n in meta if local(n.tag) == name and (n.text or "").strip()]
    first = lambda name: next(iter(every(name)), "")
    out = contributors(meta) | {"title": first("title"), "publisher": first("publisher"), "pubdate": first("date"), "languages": every("language"), "tags": every("subject"), "comments": first("description"), "rights": first("rights")}
    if isbn := next((i[0] for i in map(find_isbns, every("identifier")) if i), None):
        out["isbn"] = isbn
    for n in meta:
        if local(n.tag) == "meta" and (name := EPUB_META.get(n.get("name", ""))):
            out[name] = n.get("content", "")
    return out


def custom_field(kind: str) -> str:
    """A field's name, with or without a program's prefix before a hyphen."""
    return next((n for n in (kind, kind.partition("-")[2]) if n in NAMES), "")


def person(node) -> str:
    return " ".join(" ".join(text_at(node, f"{k}-name") for k in ("first", "middle", "last")).split())


def read_fb2(raw: bytes, path: str = "") -> dict:
    root = ElementTree.fromstring(raw)
    about = next((n for n in root.iter() if local(n.tag) == "description"), None)
    info = child(about, "title-info")
    if info is None:
        return {"title": posixpath.basename(path).rpartition(".")[0]}
    of = lambda name: [n for n in info if local(n.tag) == name]
    note = child(info, "annotation")
    out = {
        "comments": " ".join(" ".join(note.itertext()).split()) if note is not None else "", "title": text_at(info, "book-title"),
        "authors": [p for p in map(person, of("author")) if p], "translators": [p for p in map(person, of("translator")) if p],
        "tags": [t for n in of("genre") if (t := (n.text or "").strip())], "languages": [x for x in [text_at(info, "lang")] if x],
    }
    if original := text_at(child(about, "src-title-info"), "book-title") if child(about, "src-title-info") is not None else "":
        out["original_title"] = original
    published = child(about, "publish-info")
    for tag, name in (("publisher-name", "publisher"), ("year", "pubdate"), ("isbn", "isbn")):
        if published is not None and (v := text_at(published, tag)):
            out[name] = v
    if (seq := child(info, "sequence")) is not None:
        out["series"], out["series_index"] = seq.get("name", ""), seq.get("number", "")
    for n in about:
        if local(n.tag) == "custom-info" and (name := custom_field(n.get("info-type", ""))):
            out[name] = n.text or ""
    return out


def comic_date(root) -> str:
    """Year, year and month or the full date: as much of it as is valid."""
    import datetime

    year, month, day = (text_at(root, k) for k in ("Year", "Month", "Day"))
    if not re.fullmatch("[0-9]{1,4}", year) or not int(year):
        return ""
    if not re.fullmatch("[0-9]{1,2}", month) or not 1 <= int(month) <= 12:
        return str(int(year))
    try:
        return datetime.date(int(year), int(month), int(day)).isoformat()
    except ValueError:
        return f"{int(year)}-{int(month):02d}"


def read_cbz(raw: bytes, path: str = "") -> dict:
    stem = posixpath.basename(path).rpartition(".")[0]
    out: dict = {"title": stem, "authors": []}
    if m := re.match(r"(?i)^Tome\s+(\d+)\s*[-–—]\s*(.*)$", stem):
        out["title"], out["series_index"] = m[2].strip(), m[1]
        if parent := re.sub(r"(?i)\s*\[(?:integral|intégrale)\]\s*$", "", posixpath.basename(posixpath.dirname(path))):
            out["series"] = parent
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        name = next((n for n in archive.namelist() if n.lower() == "comicinfo.xml"), None)
        root = read_xml(archive, name) if name else None
    if root is None:
        return out
    for tag, field in COMIC_TEXT.items():
        if v := text_at(root, tag):
            out[field] = [v] if field == "languages" else v
    for tag, field in COMIC_LISTS.items():
        if v := text_at(root, tag):
            out[field] = [x.strip() for x in v.split(",")]
    if date := comic_date(root):
        out["pubdate"] = date
    return out


READERS = {"epub": read_epub, "fb2": read_fb2, "cbz": read_cbz}


def read_record(raw: bytes, path: str) -> tuple[dict, str]:
    """A file's record and the error met; a file that can't be read has its name for a title."""
    name = posixpath.basename(path)
    extension = name.rpartition(".")[2].lower()
    if extension not in READERS:
        return {"title": name.rpartition(".")[0] or name}, ""
    try:
        return READERS[extension](raw, path), ""
    except Exception as error:  # any damage to a file is that file's own error
        return {"title": name.rpartition(".")[0] or name, "authors": []}, f"{type(error).__name__}: {error}"


def epub_documents(archive: zipfile.ZipFile) -> list[tuple[int, int, str, bytes]]:
    """(position, documents, name, bytes) of the HTML documents among the first 8 and last 4 of the reading order."""
    path, root = epub_package(archive)
    base = posixpath.dirname(path)
    items = {n.get("id"): n for n in child(root, "manifest") if n.get("href")} if child(root, "manifest") is not None else {}
    spine = child(root, "spine")
    order = [items[n.get("idref")] for n in spine if n.get("idref") in items] if spine is not None else []
    order = order or list(items.values())
    out = []
    for k, n in enumerate(order):
        if (k < 8 or k >= len(order) - 4) and "html" in (n.get("media-type") or ""):
            name = posixpath.normpath(posixpath.join(base, unquote(n.get("href").split("#")[0])))
            out.append((k, len(order), name, member(archive, name)))
    return out


class _Images(HTMLParser):
    """Sources of a document's images, in order: those of img, and of image in a drawing."""

    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        source = named.get("src") if tag == "img" else named.get("href") or named.get("xlink:href") if tag == "image" else None
        if source:
            self.found.append(source)


def epub_images(raw: bytes) -> list[str]:
    """Members that hold the images referred to in an EPUB's outer documents, each once, in reading order.

    Of an opening document's images the first 12 count, of a closing one's those from 5 before its bound on.
    """
    out: dict[str, None] = {}
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        names = set(archive.namelist())
        for k, n, document, html in epub_documents(archive):
            parser = _Images()
            parser.feed(html.decode("utf-8", "replace"))
            bound = min(len(parser.found), 12) if k < 8 else len(parser.found)
            few = parser.found[bound - 5 :] if k >= n - 4 and bound > 5 else parser.found[:bound]
            for source in few:
                name = posixpath.normpath(posixpath.join(posixpath.dirname(document), unquote(re.split("[?#]", source)[0])))
                if name in names:
                    out.setdefault(name)
    return list(out)


def read_text(raw: bytes, path: str, front: int = 200_000, back: int = 50_000) -> str:
    """Text to match by: ISBNs and text of an EPUB's outer documents, an FB2's bodies, plain and HTML files; cut by bytes."""
    extension = path.rpartition(".")[2].lower()
    if extension == "epub":
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            text = "\n".join(text_of_html(d.decode("utf-8", "replace")) for *_, d in epub_documents(archive))
        text = "\n".join([*(f"ISBN {i}" for i in find_isbns(text)), text])
    elif extension == "fb2":
        text = "\n".join(" ".join(" ".join(n.itertext()).split()) for n in ElementTree.fromstring(raw) if local(n.tag) == "body")
    elif extension in ("htm", "html"):
        text = text_of_html(raw.decode("utf-8", "replace"))
    elif extension == "txt":
        text = raw.decode("utf-8", "replace")
    else:
        return ""
    data = text.encode()
    if len(data) <= front + back:
        return text
    ends = [front, len(data) - back]
    for k in (0, 1):
        while ends[k] < len(data) and data[ends[k]] & 0xC0 == 0x80:
            ends[k] += 1
    return f"{data[: ends[0]].decode()}\n{data[ends[1] :].decode()}"


def natural(name: str) -> list:
    return [(0, int(r), "") if r.isdigit() else (1, 0, r) for r in re.findall(r"[0-9]+|[^0-9]+", name.lower())]


def page_images(names: list[str], front: int = 20, back: int = 10) -> list[str]:
    """The image members of a comic in natural order: the first and last pages."""
    pages = sorted((n for n in names if n.lower().endswith(IMAGES)), key=natural)
    return [n for k, n in enumerate(pages) if k < front or k >= len(pages) - back]


def read_cover(raw: bytes, path: str) -> bytes:
    """An EPUB's cover by its manifest, a comic's first page; empty if there is none."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        if path.lower().endswith(".cbz"):
            pages = page_images(archive.namelist(), 1, 0)
            return member(archive, pages[0]) if pages else b""
        package, root = epub_package(archive)
        named = next((n.get("content") for n in root.iter() if local(n.tag) == "meta" and n.get("name") == "cover"), None)
        manifest = child(root, "manifest")
        for n in manifest if manifest is not None else ():
            if "cover-image" in (n.get("properties") or "").split() or named and n.get("id") == named:
                return member(archive, posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(n.get("href", "")))))
    return b""
