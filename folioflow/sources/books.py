"""Book files: EPUB archives and TEI documents, read as binary files by Spark and opened where they are read."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .epub import Archive
from .epub import local_name as _name
from .html import PREFIXES, read_blocks, squeeze

SUFFIXES = {".epub": "epub", ".xml": "tei", ".tei": "tei"}
# TEI elements and the kinds of block they are.
TEI_KINDS = {"head": "heading", "p": "paragraph", "quote": "blockquote", "lg": "verse_stanza", "l": "verse_line", "note": "footnote", "sp": "dialogue", "opener": "letter", "closer": "letter", "trailer": "paragraph", "figure": "image", "milestone": "separator", "space": "separator", "epigraph": "epigraph"}


def source_kind(path: str) -> str:
    """epub or tei by the path's suffix; any other is an error."""
    suffix = posixpath.splitext(path)[1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"no reader for {suffix or 'a path without suffix'}")
    return SUFFIXES[suffix]


def parse_xml(data: bytes):
    """An XML tree; documents that define entities are refused."""
    if b"<!ENTITY" in data[:100_000]:
        raise ValueError("entity definitions are not read")
    return ElementTree.fromstring(data)


def epub_documents(data: bytes) -> Iterator[tuple[int, str, str, dict[str, str]]]:
    """(position, name, html, metadata) of the spine's documents, in order, each once, without navigation."""
    archive = Archive(data)
    for n, name in enumerate(archive.documents, 1):
        yield n, name, archive.text(name), archive.meta


def tei_sections(root) -> Iterator[object]:
    """Parts of a text that hold something themselves; nested divisions are sections of their own."""

    def walk(part):
        if any(_name(c) in TEI_KINDS for c in part):
            yield part
        for c in part:
            if _name(c) == "div":
                yield from walk(c)

    for part in (e for e in root.iter() if _name(e) in ("front", "body", "back")):
        yield from walk(part)


def tei_blocks(data: bytes) -> Iterator[tuple[int, int, str, str]]:
    """(chapter, sequence, kind, text) of a TEI document."""
    for chapter, section in enumerate(tei_sections(parse_xml(data)), 1):
        seq = 0
        for e in section:
            kind = TEI_KINDS.get(_name(e))
            if kind is None:
                continue
            lines = [squeeze("".join(line.itertext())) for line in e.iter() if _name(line) == "l"] if kind == "verse_stanza" else []
            text = "\n".join(lines) or squeeze("".join(e.itertext()))
            if text or kind in ("image", "separator"):
                seq += 1
                yield chapter, seq, kind, text


BOOK_BLOCKS = "path string, title string, author string, language string, chapter int, seq int, kind string, block_id string, text string"


def read_book(path: str, data: bytes) -> Iterator[tuple]:
    """A book's blocks as BOOK_BLOCKS."""
    if source_kind(path) == "tei":
        root = parse_xml(data)
        first = lambda tag: next((squeeze("".join(e.itertext())) for e in root.iter() if _name(e) == tag), None)
        for chapter, seq, kind, text in tei_blocks(data):
            yield path, first("title"), first("author") or "Unknown", first("language"), chapter, seq, kind, f"c{chapter}.{PREFIXES[kind]}{seq}", text
    else:
        for chapter, _, html, meta in epub_documents(data):
            for seq, kind, text, _ in read_blocks(html):
                yield path, meta["title"], meta["author"], meta["language"], chapter, seq, kind, f"c{chapter}.{PREFIXES[kind]}{seq}", text


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of every EPUB and TEI file under a path that Spark can read, a file a task's row."""
    import pandas as pd

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = files.filter(F.lower("path").rlike(r"\.(epub|xml|tei)$")).select("path", "content")
    names = [f.split()[0] for f in BOOK_BLOCKS.split(", ")]

    def run(frames):
        for frame in frames:
            for p, data in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame(list(read_book(p, bytes(data))), columns=names)

    return known.mapInPandas(run, BOOK_BLOCKS)


def trim_markers(text: str) -> bool:
    """Whether a line is one of a library's start or end marks."""
    return bool(re.match(r"\*{3} ?(start|end) of ", text, re.I))
