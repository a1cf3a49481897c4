"""EPUB archives and chapters over their spines, against plain versions."""

import random
from collections import Counter, defaultdict

import pytest

from folioflow.operators import chapters
from folioflow.operators import providers
from folioflow.plans import catalogue
from folioflow.sources import books, epub, html

META = {"title": "A & B", "author": "Some One", "language": "en", "identifier": "id:1"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("epubs")
    docs = [("nav.xhtml", "<p>x</p>"), ("a.xhtml", "<h1>One</h1><p>First.</p><img src='pic.png'/>"), ("sub/b.xhtml", "<p>Second <b>bold</b>.</p><img src='../c.png'/>"), ("cover.xhtml", "<img src='c.png'/>")]
    (d / "whole.epub").write_bytes(epub.write_archive(docs[1:], META, {"c.png": b"x"}, "c.png"))
    (d / "untitled.epub").write_bytes(epub.write_archive(docs[1:2], {"language": "en"}))
    (d / "unsigned.epub").write_bytes(epub.write_archive(docs[1:2], {"title": "T", "language": "de"}))
    (d / "broken.epub").write_bytes(b"not a zip")
    (d / "bare.epub").write_bytes(epub.write_archive([], META))
    (d / "other.txt").write_bytes(b"text")
    return d


def test_archives_by_binary_files_and_by_data_source(spark, folder):
    spark.dataSource.register(epub.EpubSource)
    key = lambda r: (r["path"].rsplit("/", 1)[-1], r["spine"] or 0)
    one = sorted(epub.read_epubs(spark, f"file://{folder}").collect(), key=key)
    frame = spark.read.format("epub").load(str(folder))
    assert frame.rdd.getNumPartitions() == 5  # a partition a file
    two = sorted(frame.collect(), key=key)
    assert [tuple(r)[1:] for r in one] == [tuple(r)[1:] for r in two]
    by = defaultdict(list)
    for r in one:
        by[key(r)[0]].append(r)
    assert [r["document"] for r in by["whole.epub"]] == ["book/a.xhtml", "book/sub/b.xhtml", "book/cover.xhtml"] and by["whole.epub"][0]["title"] == "A & B"
    assert by["untitled.epub"][0]["error"] == "the archive names no title" and by["untitled.epub"][0]["title"] is None
    assert by["unsigned.epub"][0]["author"] == "Unknown" and by["unsigned.epub"][0]["warnings"] == ["author_missing"]
    assert by["broken.epub"][0]["error"] and by["bare.epub"][0]["spine"] is None and by["bare.epub"][0]["error"] is None
    narrow = spark.read.format("epub").schema("path string, title string").load(str(folder)).collect()
    assert len(narrow) == 5 and narrow[0].__fields__ == ["path", "title"]
    assert epub.read_epubs(spark, f"file://{folder}", ["path", "error"]).count() == 5
    with pytest.raises(Exception, match="names no title"):
        epub.read_epubs(spark, f"file://{folder}/untitled.epub", strict=True).collect()
    assert [r["document"] for r in spark.read.format("epub").load(str(folder / "whole.epub")).collect()] == [r["document"] for r in by["whole.epub"]]


def test_only_wanted_documents_are_unpacked(folder, monkeypatch):
    data = (folder / "whole.epub").read_bytes()
    monkeypatch.setattr(epub.Archive, "text", lambda *_: pytest.fail("unpacked"))
    assert len(list(epub.rows_of("p", data, ["path", "title"]))) == 1 and len(list(epub.rows_of("p", data, ["document"]))) == 3


def test_covers_and_image_places(spark, folder):
    rows = epub.archive_blocks(epub.read_epubs(spark, f"file://{folder}/whole.epub")).collect()
    assert {(r["document"], r["src"], r["cover"]) for r in rows if r["kind"] == "image"} == {("book/a.xhtml", "book/pic.png", False), ("book/sub/b.xhtml", "book/c.png", False), ("book/cover.xhtml", "book/c.png", True)}
    assert html.resolve_image("a/b/c.xhtml", ".././x/../y.png") == "a/y.png"


def test_archives_of_pages_hold_the_pages_blocks(spark, data):
    from pyspark.sql import functions as F

    pages = catalogue.QUERIES["html_block_rows"](spark, data)
    kept = pages.filter(F.floor(F.col("page_id") / 10) % 9 != 8).select("kind", "text")
    got = catalogue.QUERIES["epub_blocks"](spark, data)
    assert got.filter("kind <> 'image'").select("kind", "text").exceptAll(kept).isEmpty() and kept.exceptAll(got.select("kind", "text")).isEmpty()
    ids = got.groupBy("book").agg(F.count("block_id").alias("n"), F.countDistinct("block_id").alias("d"))
    assert ids.filter("n <> d").isEmpty()


@pytest.mark.parametrize("line,page", [("[pg 5]", True), ("[xii]", True), ("page 7", True), ("[5]", True), ("[ p. 12 ]", True), ("pg. 3", True), ("PAGE 9", True), ("[pg5]", True), ("5", False), ("xii", False), ("page", False), ("[]", False), ("[page]", False), ("p. 5", False), ("[note 5]", False), ("page v", False), ("", False)])
def test_page_lines(line, page):
    assert html.is_page_line(line) == page


def test_rules_version_goes_by_the_rules():
    import types

    def module(code):
        m = types.ModuleType("rules")
        exec(code, m.__dict__)
        return providers.rules_version(m)

    base = 'LIMIT = 5\ndef f(x):\n    "doc"\n    return x + 1\n'
    assert module(base) == module('LIMIT = 5  # a remark\ndef f(x):\n    "other words"\n\n    return x + 1\n')
    assert len({module(base), module(base.replace("5", "6")), module(base.replace("x + 1", "x + 2")), module(base.replace("return x", "return len(x)"))}) == 4


# ---- chapters


def label(text):
    import re

    if len(text) > 120:
        return False
    roman = "m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
    words = "(?i:chapter|chapitre|cap[ií]tulo|capitolo|kapitel|teil|part|partie|parte|book|livre|libro|buch|tome|band)"
    number = rf"(\d{{1,3}}|{roman}|{roman.upper()})"
    return any((m := re.match(p, text)) and m[1] for p in (rf"[-–—(\[]*\s*(?:{words}\s+)?{number}\s*[-–—.)\]:]*$", rf"{words}\s+{number}\s*[-–—.:]\s*\S.*$"))


def plain_chapters(rows):
    """(book, spine, seq) -> chapter, by walking through each book."""
    out, documents = {}, defaultdict(list)
    for book, spine, seq, kind, level, text in rows:
        documents[book, spine].append((seq, kind, level, text or ""))
    state = {}
    for (book, spine), blocks in sorted(documents.items()):
        blocks.sort()
        mark = lambda b: b[1] == "paragraph" and label(b[3])
        candidates = [b for b in blocks if b[3] and (b[1] == "heading" and (b[2] or 1) <= 5 or mark(b))]
        times = Counter(b[3].lower() for b in candidates)
        openers = {b[0]: 7 if mark(b) else b[2] or 1 for b in candidates if times[b[3].lower()] < 3}
        said = [b for b in blocks if b[3] and b[1] not in ("image", "separator")]
        starts, fresh, preamble = [], False, False
        for n, b in enumerate(said):
            if b[0] in openers:
                if fresh or not any(x[0] in openers for x in said[:n]):
                    starts.append(b[0])
                    fresh = False
            else:
                fresh = True
                preamble = preamble or not any(x[0] in openers for x in said[:n])
        preamble = preamble and bool(openers)
        if starts and not fresh:
            starts.pop()
        if starts:
            tally = Counter(openers[s] for s in starts)
            common = min(tally, key=lambda k: (-tally[k], k))
            starts = [s for s in starts if openers[s] <= common]
        length = sum(len(b[3]) for b in blocks)
        if length < 3000 or len(starts) + preamble < 2 or length <= 25000 and len(starts) < 2:
            starts, preamble = [], False
        segments, now = [[]], 0
        for b in blocks:
            if b[0] in starts and (preamble or b[0] != starts[0]):
                segments.append([])
            segments[-1].append(b)
        parts = []
        for s in segments:
            parts.append([])
            if sum(len(b[3]) for b in s) <= 60000:
                parts[-1] = s
                continue
            held = 0
            for b in s:
                if held and held + len(b[3]) > 20000:
                    parts.append([])
                    held = 0
                parts[-1].append(b)
                held += len(b[3])
        chapter, long = state.get(book, (0, False))
        opens = bool(said) and said[0][1] != "heading" and not mark(said[0])
        for n, p in enumerate(parts):
            if n or not (long and opens and chapter):
                chapter += 1
            out |= {(book, spine, b[0]): chapter for b in p}
        state[book] = chapter, length > 25000
    return out


def test_chapters_against_plain_version(spark):
    rng = random.Random(9)
    rows = []
    for book in range(40):
        for spine in range(rng.randint(1, 6)):
            size = rng.choice([200, 1500, 4000, 9000])
            for seq in range(rng.randint(0, 14)):
                r = rng.random()
                if r < 0.3:
                    rows.append((book, spine, seq, "heading", rng.randint(1, 6), rng.choice(["Anna", f"Title {rng.random()}", ""])))
                elif r < 0.4:
                    rows.append((book, spine, seq, "paragraph", None, rng.choice(["Chapter IV", "xii.", "Kapitel 3: Der Weg", "Mix.", "Teil", "- 5 -", "mild"])))
                elif r < 0.5:
                    rows.append((book, spine, seq, rng.choice(["image", "separator"]), None, rng.choice(["", "alt", None])))
                else:
                    rows.append((book, spine, seq, "paragraph", None, "x" * rng.randint(1, size)))
    rows.append((99, 0, 0, "paragraph", None, "y" * 30000))
    rows += [(99, 1, s, "paragraph", None, "z" * 15000) for s in range(7)] + [(99, 2, 0, "heading", 1, "End")]
    frame = spark.createDataFrame(rows, "book int, spine int, seq int, kind string, level int, text string").repartition(5)
    got = {(r["book"], r["spine"], r["seq"]): r["chapter"] for r in chapters.cut_chapters(frame).collect()}
    want = plain_chapters(rows)
    assert got == want
    assert want[99, 0, 0] == want[99, 1, 0] == 1 and want[99, 2, 0] == max(want[99, s, q] for b, s, q in want if b == 99) and len({c for (b, s, _), c in want.items() if b == 99}) == 8
    assert chapters.cut_chapters(frame.limit(0)).count() == 0


def test_books_read_as_before():
    data = epub.write_archive([("a.xhtml", "<p>One.</p>"), ("b.xhtml", "<p>Two.</p>")], META)
    assert [r[4:] for r in books.read_book("x.epub", data)] == [(1, 1, "paragraph", "c1.p1", "One."), (2, 1, "paragraph", "c2.p1", "Two.")]
