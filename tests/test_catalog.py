import os
import time

import pytest

from outlinelake.operators.headings import parse_headings
from outlinelake.operators.links import parse_links
from outlinelake.plans import catalog
from outlinelake.sources.scan import scan
from outlinelake.streaming.watch import watch


@pytest.fixture
def dirs(tmp_path):
    for d, name, text in (("x", "a.org", "* a\n** a2\n[[#q]]\n"), ("x", "b.org", "* b :t:\n"), ("y/z", "a.org", "* other\n"), ("y", "no.txt", "* no\n")):
        (tmp_path / d).mkdir(parents=True, exist_ok=True)
        (tmp_path / d / name).write_text(text)
    return tmp_path


def rows(df):
    return sorted(map(str, df.drop("bucket").collect()))


def same_as_rebuild(spark, where, tables):
    files = scan(spark, where)
    assert rows(tables["headings"]) == rows(parse_headings(files))
    assert rows(tables["links"]) == rows(parse_links(files))


def test_scan_reads_whole_files(spark, dirs):
    found = scan(spark, [str(dirs / "x"), str(dirs / "y")])
    assert found.count() == 3
    assert parse_headings(found).where("line_number > 1").count() == 1


def test_refresh_equals_rebuild(spark, dirs):
    where, path = [str(dirs / "x"), str(dirs / "y")], str(dirs / "db")
    same_as_rebuild(spark, where, catalog.refresh(spark, where, path))
    time.sleep(1.1)
    (dirs / "x/a.org").write_text("* a changed\n")
    (dirs / "x/c.org").write_text("* c\n** c2\n")
    os.remove(dirs / "x/b.org")
    tables = catalog.refresh(spark, where, path)
    same_as_rebuild(spark, where, tables)
    assert tables["files"].count() == 3
    same_as_rebuild(spark, where, catalog.refresh(spark, where, path))
    for f in (dirs / "x").glob("*.org"):
        os.remove(f)
    tables = catalog.refresh(spark, where, path)
    assert [r["title"] for r in tables["headings"].collect()] == ["other"]


def test_digest_sees_an_edit_that_keeps_time_and_size(spark, dirs):
    where, path, file = [str(dirs / "x")], str(dirs / "db"), dirs / "x/b.org"
    catalog.refresh(spark, where, path, digest=True)
    was = file.stat()
    file.write_text("* c :t:\n")
    os.utime(file, ns=(was.st_atime_ns, was.st_mtime_ns))
    same_as_rebuild(spark, where, catalog.refresh(spark, where, path, digest=True))


def test_views(spark, dirs):
    catalog.register(catalog.refresh(spark, [str(dirs / "x")], str(dirs / "db")))
    assert spark.sql("SELECT count(*) AS n FROM headings h JOIN links l USING (file) WHERE h.level = 2").first()["n"] == 1


def test_watch(spark, dirs):
    path = str(dirs / "db")
    for _ in range(2):
        query = watch(spark, str(dirs / "x"), path, str(dirs / "state"))
        query.awaitTermination(60)
        (dirs / "x/new.org").write_text("* new\n")
    assert sorted(r["title"] for r in catalog.load(spark, path)["headings"].collect()) == ["a", "a2", "b", "new"]


def test_refresh_of_odd_names(spark, dirs):
    where, path = [str(dirs / "x")], str(dirs / "db")
    catalog.refresh(spark, where, path)
    names = ["my notes.org", "x[1].org", "100%.org", "a+b.org", "é{ü}.org", "q?*.org", "c,d.org", "%41.org"]
    for name in names:
        (dirs / "x" / name).write_text(f"* {name}\n")
    tables = catalog.refresh(spark, where, path)
    assert {r["title"] for r in tables["headings"].collect()} == {"a", "a2", "b", *names}
    same_as_rebuild(spark, where, tables)
    assert {r["file"] for r in tables["files"].collect()} == {f"file:{dirs}/x/{n}" for n in ["a.org", "b.org", *names]} or {r["file"] for r in tables["files"].collect()} == {f"file://{dirs}/x/{n}" for n in ["a.org", "b.org", *names]}
    os.remove(dirs / "x" / names[1])
    (dirs / "x" / names[0]).write_text("* changed\n** more\n")
    same_as_rebuild(spark, where, catalog.refresh(spark, where, path))


@pytest.mark.parametrize("written", range(4))
def test_a_refresh_that_breaks_off_is_repeated(spark, dirs, monkeypatch, written):
    """Stopped after any number of tables, even if the files change again before the next refresh."""
    where, path = [str(dirs / "x")], str(dirs / "db")
    catalog.refresh(spark, where, path)
    (dirs / "x/a.org").write_text("* A changed\n[[#w]]\n")
    (dirs / "x/new.org").write_text("* new\n[[#n]]\n")
    os.remove(dirs / "x/b.org")
    real, done = catalog._replace_buckets, []

    def replace(*args):
        if len(done) == written:
            raise OSError("lost")
        done.append(real(*args))

    monkeypatch.setattr(catalog, "_replace_buckets", replace)
    if written < 3:
        with pytest.raises(OSError, match="lost"):
            catalog.refresh(spark, where, path)
    monkeypatch.setattr(catalog, "_replace_buckets", real)
    os.remove(dirs / "x/new.org")
    (dirs / "x/b.org").write_text("* b again\n")
    tables = catalog.refresh(spark, where, path)
    same_as_rebuild(spark, where, tables)
    assert not catalog.exists(spark, f"{path}/_pending")


def test_sqlite_export(spark, dirs):
    import sqlite3

    catalog.export_sqlite(catalog.refresh(spark, [str(dirs / "x")], str(dirs / "db")), str(dirs / "out.db"))
    db = sqlite3.connect(dirs / "out.db")
    assert db.execute("SELECT title, level, tags FROM headings ORDER BY title").fetchall() == [("a", 1, "[]"), ("a2", 2, "[]"), ("b", 1, '["t"]')]
    assert db.execute("SELECT link FROM links").fetchall() == [("#q",)] and db.execute("SELECT count(*) FROM files").fetchone() == (2,)
