"""The library as a data source, and patches as a sink."""

import os

import pytest

from bindery.sinks import books as sink
from bindery.sources import books, formats
from bindery.sources.listing import LibraryReader
from test_sources import FB2, cbz, epub


@pytest.fixture
def tree(tmp_path):
    for name in ("a.epub", "_under.fb2", ".dot.epub", "in/b.FB2", "in/deep/c.cbz", ".hidden/d.epub", "in/.e/f.pdf", "in/notes.txt", "_all/g.epub"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(epub())
    os.symlink(tmp_path / "a.epub", tmp_path / "link.epub")
    os.symlink(tmp_path / "in", tmp_path / "folder")
    (tmp_path / "folder.epub").mkdir()
    return tmp_path


def names(spark, root, **options):
    return sorted(os.path.relpath(r.path, root) for r in books.list_books(spark, f"file://{root}", **options).collect())


def test_listing_by_its_options(spark, tree):
    assert names(spark, tree) == ["_all/g.epub", "_under.fb2", "a.epub", "in/b.FB2", "in/deep/c.cbz"]
    assert names(spark, tree, recursive=False) == ["_under.fb2", "a.epub"]
    assert names(spark, tree, hidden=True) == [".dot.epub", ".hidden/d.epub", "_all/g.epub", "_under.fb2", "a.epub", "in/.e/f.pdf", "in/b.FB2", "in/deep/c.cbz"]
    assert names(spark, tree, recursive=False, hidden=True) == [".dot.epub", "_under.fb2", "a.epub"]
    row = books.list_books(spark, str(tree)).where("name = 'a.epub'").first()
    assert row.modified_ns == os.stat(tree / "a.epub").st_mtime_ns and row.size == os.stat(tree / "a.epub").st_size
    with pytest.raises(Exception, match="not a folder"):
        books.list_books(spark, str(tree / "none")).collect()


def test_folders_are_dealt_to_tasks_once(tree, monkeypatch):
    for limit in (1, 2, 3, 256):
        monkeypatch.setattr("bindery.sources.listing.FOLDERS", limit)
        reader = LibraryReader({"path": str(tree), "tasks": "3"})
        parts = reader.partitions()
        found = [r[0] for p in parts for r in reader.read(p)]
        assert len(found) == len(set(found)) == 5 and len(parts) <= 3


def test_what_cannot_be_looked_at_is_a_warning(tree, monkeypatch):
    real = os.scandir

    def refused(folder):
        if str(folder).endswith("/in"):
            raise PermissionError(13, "Permission denied", folder)
        return real(folder)

    monkeypatch.setattr(os, "scandir", refused)
    reader = LibraryReader({"path": str(tree)})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[4] for r in rows if r[4]] == [f"{tree}/in: Permission denied"]
    assert sorted(r[1] for r in rows if not r[4]) == ["_under.fb2", "a.epub", "g.epub"]


def test_scan_says_what_it_could_not_read(spark, tree):
    (tree / "bad.cbz").write_bytes(b"no zip")
    found = books.scan(spark, str(tree))
    rows = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert rows["bad.cbz"].metadata.title == "bad" and rows["bad.cbz"].warning.startswith(f"{tree}/bad.cbz: BadZipFile")
    assert rows["a.epub"].warning is None and rows["a.epub"].metadata.title == "Title"
    outcome = books.scan_outcome(found).first()
    assert (outcome.books, outcome.warnings) == (6, sum(r.warning is not None for r in rows.values()))
    before = rows["a.epub"].fingerprint
    info = os.stat(tree / "a.epub")
    os.utime(tree / "a.epub", ns=(info.st_atime_ns, info.st_mtime_ns + 1))
    assert books.scan(spark, str(tree)).where("path like '%/a.epub'").first().fingerprint != before


def test_files_are_patched_once_however_often_rows_are_read(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "b.fb2").write_bytes(FB2)
    (tmp_path / "c.cbz").write_bytes(cbz())
    (tmp_path / "d.cbz").write_bytes(b"no zip")
    rows = [(f"{tmp_path}/{n}", "title", ["Patched"]) for n in ("a.epub", "b.fb2", "c.cbz", "d.cbz", "gone.epub")] + [(f"{tmp_path}/c.cbz", "authors", ["X", "Y"]), (f"{tmp_path}/b.fb2", "nonsense", ["x"])]
    got = sink.write_patches(spark.createDataFrame(rows, "path string, field string, values array<string>"))
    inode = os.stat(tmp_path / "a.epub").st_ino
    for _ in range(2):
        assert {os.path.basename(r.path): r.saved for r in got.collect()} == {"a.epub": True, "b.fb2": False, "c.cbz": True, "d.cbz": False, "gone.epub": False}
    assert got.count() == 5 and os.stat(tmp_path / "a.epub").st_ino == inode
    assert formats.read_epub((tmp_path / "a.epub").read_bytes())["title"] == "Patched"
    assert formats.read_cbz((tmp_path / "c.cbz").read_bytes())["authors"] == ["X", "Y"]
    assert formats.read_fb2((tmp_path / "b.fb2").read_bytes())["title"] == "T"
    assert sorted(os.listdir(tmp_path)) == ["a.epub", "b.fb2", "c.cbz", "d.cbz"]


def test_attempts_of_one_task_patch_a_file_once(tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    row = {"path": f"file:{tmp_path}/a.epub", "fields": [{"field": "tags", "values": ["One", "Two", "Three"]}]}
    writer = sink.PatchWriter(str(tmp_path / "outcome"))
    writer.write(iter([row]))  # an attempt that was lost after it had written, and a copy that ran beside the one accepted
    accepted = writer.write(iter([row]))

    def killed():
        yield row
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    before = os.stat(tmp_path / "a.epub").st_mtime_ns
    assert os.stat(tmp_path / "a.epub").st_mtime_ns == before and formats.read_epub((tmp_path / "a.epub").read_bytes())["tags"] == ["One", "Two"]
    writer.commit([accepted, None])
    assert formats.read_epub((tmp_path / "a.epub").read_bytes())["tags"] == ["One", "Two", "Three"]
    assert sorted(os.listdir(tmp_path)) == ["a.epub", "outcome"]
    failed = sink.PatchWriter(str(tmp_path / "outcome"))
    failed.abort([failed.write(iter([row])), None])
    assert sorted(os.listdir(tmp_path)) == ["a.epub", "outcome"]


def test_a_failed_job_patches_nothing(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    before = (tmp_path / "a.epub").read_bytes()
    rows = spark.createDataFrame([(f"{tmp_path}/a.epub", "title", ["x"]), ("broken", "title", ["x"])], "path string, field string, values array<string>").repartition(2)
    from pyspark.sql import functions as F

    broken = rows.withColumn("field", F.when(F.col("path") == "broken", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("field")))
    with pytest.raises(Exception, match="lost"):
        sink.write_patches(broken)
    assert (tmp_path / "a.epub").read_bytes() == before
