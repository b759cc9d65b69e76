"""Writing patches back into EPUB, FB2 and CBZ files: given fields change, an empty value clears, all else stays.

A patched file is made whole beside the old one and moved over it; patches of many books are a data source writer, whose commit does
the moving. Patches are checked against what the format keeps before a file is opened.
"""

from __future__ import annotations

import copy
import io
import json
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from bindery.operators.held import folder
from bindery.schema import CBZ_FIELDS, LISTS, NAMES
from bindery.sources.formats import COMIC_LISTS, COMIC_TEXT, EPUB_META, child, contributors, epub_package, local, read_record, read_xml
from bindery.sources.listing import local_path

OPF, DC, FB2 = "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/", "http://www.gribuser.ru/xml/fictionbook/2.0"
for prefix, uri in (("opf", OPF), ("dc", DC), ("xlink", "http://www.w3.org/1999/xlink")):
    ElementTree.register_namespace(prefix, uri)
#: Order of a comic record's elements.
COMIC_ORDER = ["Title", "Series", "Number", "Summary", "Year", "Month", "Day", "Writer", "Translator", "Publisher", "Genre", "Web", "LanguageISO", "Format", "SeriesGroup", "CommunityRating"]
DC_FIELDS = {"title": "title", "publisher": "publisher", "pubdate": "date", "languages": "language", "tags": "subject", "comments": "description", "rights": "rights"}


def check(path: str, patch: dict) -> None:
    """Raise ValueError for a field that the registry or the format doesn't know, or a value of the wrong shape."""
    extension = path.rpartition(".")[2].lower()
    for name, value in patch.items():
        if name not in NAMES:
            raise ValueError(f"unknown field {name}")
        shaped = isinstance(value, list) and all(isinstance(v, str) for v in value) if name in LISTS else isinstance(value, str)
        if value is not None and not shaped:
            raise ValueError(f"{name} has the wrong shape")
        if name == "cover_url" and extension != "epub" or name == "pubdate" and extension == "pdf" or extension == "cbz" and name not in CBZ_FIELDS:
            raise ValueError(f"{name} is not kept by {extension}")
        if extension == "cbz" and value:
            if name == "pubdate" and not re.fullmatch(r"[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?", value):
                raise ValueError("a date is YYYY, YYYY-MM or YYYY-MM-DD")
            if name == "rating" and not (re.fullmatch(r"[0-9]+(\.[0-9]{1,2})?", value) and float(value) <= 5):
                raise ValueError("a rating is a decimal from 0 to 5")
            if name == "languages" and (len(value) > 1 or not re.fullmatch(r"[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*", value[0])):
                raise ValueError("at most one language tag")


def _listed(value) -> list[str]:
    return [v for v in (value if isinstance(value, list) else [value or ""]) if v.strip()]


def _copied(raw: bytes, replace: dict[str, bytes]) -> bytes:
    """The archive with some members' bytes replaced (or added), all others as they are and in their order."""
    out, left = io.BytesIO(), dict(replace)
    with zipfile.ZipFile(io.BytesIO(raw)) as old, zipfile.ZipFile(out, "w") as new:
        for info in old.infolist():
            new.writestr(copy.copy(info), left.pop(info.filename, None) or old.read(info), compress_type=info.compress_type)
        for name, data in left.items():
            new.writestr(name, data, compress_type=zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _xml(root) -> bytes:
    return ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)


def patch_epub(raw: bytes, patch: dict) -> bytes:
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        path, root = epub_package(archive)
    meta = child(root, "metadata")
    namespace = meta.tag.rpartition("}")[0] + "}" if "}" in meta.tag else ""
    for name, value in patch.items():
        values = _listed(value)
        if name in DC_FIELDS:
            tag = f"{{{DC}}}{DC_FIELDS[name]}"
            found = meta.findall(tag)
            if name not in LISTS and found:
                values, found = values[:1], found[:1]  # the first is the field's; others, such as other titles, stay
            for n in found:
                meta.remove(n)
            for v in values:
                ElementTree.SubElement(meta, tag).text = v
        elif name in ("authors", "translators"):
            for n in [n for n in meta if local(n.tag) in ("creator", "contributor")]:
                alone = ElementTree.Element("metadata")
                alone.extend([n, *(m for m in meta if local(m.tag) == "meta")])
                if contributors(alone)[name]:
                    meta.remove(n)
            for v in values:
                n = ElementTree.SubElement(meta, f"{{{DC}}}{'creator' if name == 'authors' else 'contributor'}")
                n.text = v
                n.set(f"{{{OPF}}}role", "aut" if name == "authors" else "trl")
        elif name == "isbn":
            for n in [n for n in meta if n.tag == f"{{{DC}}}identifier" and n.get(f"{{{OPF}}}scheme", "").lower() == "isbn" and n.get("id") != root.get("unique-identifier")]:
                meta.remove(n)
            for v in values:
                n = ElementTree.SubElement(meta, f"{{{DC}}}identifier")
                n.text = v
                n.set(f"{{{OPF}}}scheme", "ISBN")
        else:
            key = next((k for k, f in EPUB_META.items() if f == name), None)
            for n in [n for n in meta if local(n.tag) == "meta" and n.get("name") == key]:
                meta.remove(n)
            for v in values if key else ():
                ElementTree.SubElement(meta, f"{namespace}meta", {"name": key, "content": v})
    return _copied(raw, {path: _xml(root)})


def patch_fb2(raw: bytes, patch: dict) -> bytes:
    root = ElementTree.fromstring(raw)
    space = root.tag.rpartition("}")[0] + "}" if "}" in root.tag else ""
    if space:
        ElementTree.register_namespace("", space[1:-1])

    def part(parent, name: str):
        found = child(parent, name)
        return found if found is not None else ElementTree.SubElement(parent, space + name)

    about = part(root, "description")
    info = part(about, "title-info")

    def replace(parent, tag: str, values: list[str], fill=None) -> None:
        for n in [n for n in parent if local(n.tag) == tag]:
            parent.remove(n)
        for v in values:
            n = ElementTree.SubElement(parent, space + tag)
            if fill:
                fill(n, v)
            else:
                n.text = v

    def person(n, name: str) -> None:
        first, _, last = name.partition(" ")
        for tag, v in (("first-name", first), ("last-name", last)):
            ElementTree.SubElement(n, space + tag).text = v

    def paragraph(n, text: str) -> None:
        ElementTree.SubElement(n, space + "p").text = text

    simple = {"title": (info, "book-title"), "tags": (info, "genre"), "languages": (info, "lang"), "publisher": ("publish-info", "publisher-name"), "pubdate": ("publish-info", "year"), "isbn": ("publish-info", "isbn"), "original_title": ("src-title-info", "book-title")}
    for name, value in patch.items():
        values = _listed(value)
        if name in simple:
            parent, tag = simple[name]
            replace(part(about, parent) if isinstance(parent, str) else parent, tag, values)
        elif name in ("authors", "translators"):
            replace(info, name[:-1], values, person)
        elif name == "comments":
            replace(info, "annotation", values, paragraph)
        elif name in ("series", "series_index"):
            seq = part(info, "sequence")
            seq.set("name" if name == "series" else "number", values[0] if values else "")
        else:
            for n in [n for n in about if local(n.tag) == "custom-info" and n.get("info-type", "").rpartition("-")[2] == name]:
                about.remove(n)
            for v in values:
                ElementTree.SubElement(about, space + "custom-info", {"info-type": name}).text = v
    return _xml(root)


def patch_cbz(raw: bytes, patch: dict) -> bytes:
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        name = next((n for n in archive.namelist() if n.lower() == "comicinfo.xml"), "ComicInfo.xml")
        root = read_xml(archive, name) if name in archive.namelist() else ElementTree.Element("ComicInfo")
    tags = {f: t for t, f in (COMIC_TEXT | COMIC_LISTS).items()}
    values: dict[str, str] = {}
    for field, value in patch.items():
        if field == "pubdate":
            date = [*(value or "").split("-"), "", ""] if value else ["", "", ""]
            values |= {t: v.lstrip("0") for t, v in zip(("Year", "Month", "Day"), date, strict=False)}
        else:
            values[tags[field]] = ", ".join(_listed(value))
    for tag, v in values.items():
        for n in [n for n in root if local(n.tag) == tag]:
            root.remove(n)
        if v:
            n = ElementTree.Element(tag)
            n.text = v
            later = COMIC_ORDER[COMIC_ORDER.index(tag) + 1 :]
            at = next((k for k, x in enumerate(root) if local(x.tag) in later), len(root))
            root.insert(at, n)
    return _copied(raw, {name: _xml(root)})


WRITERS = {"epub": patch_epub, "fb2": patch_fb2, "cbz": patch_cbz}


def beside(path: str, data: bytes, mark: str = "") -> str:
    """Write a file's new bytes beside it, with its mode, and sync; returns where."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=f".patch-{mark}")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.chmod(temporary, os.stat(path).st_mode)
    except BaseException:
        os.unlink(temporary)
        raise
    return temporary


def replace_file(path: str, data: bytes) -> None:
    """Write beside the file and move over it."""
    temporary = beside(path, data)
    try:
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def patched(path: str, patch: dict) -> bytes:
    """The bytes of a file with a patch applied; the file stays."""
    check(path, patch)
    extension = path.rpartition(".")[2].lower()
    if extension not in WRITERS:
        raise ValueError(f"{extension} files are not written")
    with open(path, "rb") as f:
        return WRITERS[extension](f.read(), patch)


def write(path: str, patch: dict) -> dict:
    """Patch a file and return the record that it then holds."""
    replace_file(path, patched(path, patch))
    with open(path, "rb") as f:
        return read_record(f.read(), path)[0]


@dataclass
class Prepared(WriterCommitMessage):
    """What a task has made ready: path, the new file beside it, and the error where there is none."""

    files: list[tuple[str, str, str]]


class PatchWriter(DataSourceWriter):
    """Tasks write new files beside the old ones; only the commit, once all tasks have ended, moves them over.

    A task that is run again, or twice at the same time, makes files of its own, and only the attempt that Spark accepts is moved: every book is
    patched once. What other attempts have left goes with the commit or the abort.
    """

    def __init__(self, outcome: str):
        self.outcome, self.mark = outcome, f"{uuid.uuid4().hex}-"

    def write(self, iterator: Iterator[Row]) -> Prepared:
        files = []
        try:
            for row in iterator:
                path = row["path"].removeprefix("file:")
                patch = {f["field"]: f["values"] if f["field"] in LISTS else "".join(f["values"] or []) for f in row["fields"]}
                try:
                    files.append((row["path"], beside(path, patched(path, patch), self.mark), ""))
                except (OSError, ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    files.append((row["path"], "", f"{type(error).__name__}: {error}"))
        except BaseException:
            for _, new, _ in files:
                if new:
                    os.unlink(new)
            raise
        return Prepared(files)

    def _forget(self, messages: list[Prepared | None]) -> None:
        for folder in {os.path.dirname(p.removeprefix("file:")) or "." for m in messages if m for p, _, _ in m.files}:
            for name in os.listdir(folder):
                if name.startswith(f".patch-{self.mark}"):
                    os.unlink(os.path.join(folder, name))

    def commit(self, messages: list[Prepared | None]) -> None:
        done = []
        for path, new, error in (f for m in messages if m for f in m.files):
            if new:
                try:
                    os.replace(new, path.removeprefix("file:"))
                except OSError as failed:
                    error = f"{type(failed).__name__}: {failed}"
            done.append({"path": path, "saved": not error, "error": error})
        self._forget(messages)
        os.makedirs(self.outcome, exist_ok=True)
        with open(os.path.join(self.outcome, "outcome.json"), "w") as out:
            out.writelines(f"{json.dumps(d)}\n" for d in done)

    def abort(self, messages: list[Prepared | None]) -> None:
        self._forget(messages)


class PatchSink(DataSource):
    """Rows of path and fields, written into the files that the paths name; option ``outcome``: a folder for what became of each."""

    @classmethod
    def name(cls) -> str:
        return "book_patches"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PatchWriter(self.options["outcome"])


def write_patches(patches: DataFrame, outcome: str | None = None) -> DataFrame:
    """Write each book of a long patch (path, field, values) into its file, now; path, saved, error of what became of them.

    The files are written by this call, once: reading the rows it returns writes nothing. Files, and the folder for the outcome, must be on a file
    system that the driver and all executors share. A book has at most as many rows as there are fields; two patches of one field
    are joined by the order of their values. A commit is what a user selected.
    """
    spark = patches.sparkSession
    spark.dataSource.register(PatchSink)
    at = local_path(outcome or folder(spark, "patched"))
    books = patches.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("field", "values"))).alias("fields"))
    books.write.format("book_patches").option("outcome", at).mode("append").save()
    return spark.read.schema("path string, saved boolean, error string").json(f"file://{at}")
