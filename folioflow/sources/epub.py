"""EPUB archives as a source: a row for each document of the spine, in reading order.

``read_epubs`` goes through Spark's binary files, so any store that Spark reads will do, and the archives are opened where they are read;
``EpubSource`` is the same as a data source of its own (``spark.read.format("epub").load(folder)``) for folders that every executor has
mounted, with a partition a file. Both decompress what is asked for only: without the columns of documents an archive is one row, and
without ``html`` no document is unpacked.

Defined results: an archive that can't be read, or that names no title or no language, is one row with ``error`` and nothing else (with
``strict`` it stops the job); a missing author is "Unknown" and a warning; navigation documents, repeated documents and references to what
the archive lacks are left out; an archive without documents has one row without a spine position.
"""

from __future__ import annotations

import io
import os
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import bound_batches
from .html import PREFIXES, read_blocks, resolve_image, squeeze

DOCUMENTS = (
    "path string, title string, author string, language string, identifier string, warnings array<string>, error string, "
    "covers array<string>, spine int, document string, html string"
)
OF_DOCUMENTS = {"spine", "document", "html"}
DUBLIN_CORE = {"title": "title", "creator": "author", "language": "language", "identifier": "identifier"}
FLUSH = 4 << 20


def local_name(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


class Archive:
    """An opened EPUB: its metadata, its declared covers and the documents of its spine."""

    def __init__(self, data: bytes):
        from .books import parse_xml

        self.zip = zipfile.ZipFile(io.BytesIO(data))
        container = parse_xml(self.zip.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in container.iter() if local_name(e) == "rootfile")
        tree = parse_xml(self.zip.read(package))
        self.meta: dict[str, str] = {}
        items, spine, cover_ids = {}, [], set()
        for e in tree.iter():
            name = local_name(e)
            if name in DUBLIN_CORE and (text := squeeze("".join(e.itertext()))):
                self.meta.setdefault(DUBLIN_CORE[name], text)
            elif name == "item":
                place = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(e.get("href", ""))))
                items[e.get("id")] = place, e.get("media-type", ""), (e.get("properties") or "").split()
            elif name == "itemref":
                spine.append(e.get("idref"))
            elif name == "meta" and e.get("name") == "cover":
                cover_ids.add(e.get("content"))
        inside = set(self.zip.namelist())
        self.covers = sorted({place for i, (place, _, words) in items.items() if "cover-image" in words or i in cover_ids})
        self.documents: list[str] = []
        for i in spine:
            place, _, words = items.get(i, ("", "", ()))
            if place in inside and "nav" not in words and place not in self.documents:
                self.documents.append(place)
        missing = [n for n in ("title", "language") if n not in self.meta]
        if missing:
            raise ValueError(f"the archive names no {' and no '.join(missing)}")
        self.warnings = [] if "author" in self.meta else ["author_missing"]
        self.meta.setdefault("author", "Unknown")

    def text(self, document: str) -> str:
        return self.zip.read(document).decode("utf-8", "replace")


def rows_of(path: str, data: bytes, names: list[str], strict: bool = False) -> Iterator[dict]:
    """The rows of one archive, with the columns asked for."""
    try:
        archive = Archive(data)
        common = {"path": path, **archive.meta, "warnings": archive.warnings, "covers": archive.covers}
        places = archive.documents if OF_DOCUMENTS & set(names) else []
        for spine, document in enumerate(places or [None]):
            row = common | {"spine": spine if document else None, "document": document}
            yield row | ({"html": archive.text(document)} if document and "html" in names else {})
    except (ValueError, KeyError, SyntaxError, StopIteration, zipfile.BadZipFile) as problem:
        if strict:
            raise ValueError(f"{path}: {problem}") from problem
        yield {"path": path, "error": str(problem) or type(problem).__name__}


def open_archives(files: DataFrame, columns: list[str] | None = None, strict: bool = False) -> DataFrame:
    """files(path, content) -> the columns asked for of DOCUMENTS."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bound_batches(files.sparkSession)
    whole = T._parse_datatype_string(DOCUMENTS)
    schema = T.StructType([whole[c] for c in columns]) if columns else whole
    arrow, names = to_arrow_schema(schema), schema.names

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for row in rows_of(path, data.as_py() or b"", names, strict):
                    rows.append({n: row.get(n) for n in names})
                    held += len(row.get("html") or "")
                    if held > FLUSH or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def read_epubs(spark: SparkSession, path: str, columns: list[str] | None = None, strict: bool = False) -> DataFrame:
    """The documents of every EPUB under a path that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path)
    return open_archives(files, columns, strict)


class EpubSource(DataSource):
    """format("epub"): option path (a folder or a file that every executor has mounted), option strict; a schema given to the reader projects."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return EpubReader(self.options["path"].removeprefix("file://"), schema.names, self.options.get("strict", "false").lower() == "true")


class EpubReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], strict: bool):
        self.path, self.names, self.strict = path, names, strict

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [InputPartition(self.path)]
        found = (os.path.join(folder, f) for folder, _, files in os.walk(self.path) for f in files)
        return [InputPartition(f) for f in sorted(found) if f.lower().endswith(".epub")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            data = f.read()
        for row in rows_of(partition.value, data, self.names, self.strict):
            yield tuple(row.get(n) for n in self.names)


BLOCKS = "path string, spine int, document string, seq int, kind string, level int, text string, src string, cover boolean"


def is_cover(blocks: list[tuple], document: str, covers: list[str]) -> bool:
    """A document with images and no text, all of whose images the archive declares as its cover."""
    images = {resolve_image(document, extra["src"]) for _, kind, _, extra in blocks if kind == "image"}
    return bool(images) and images <= set(covers) and not any(text for _, kind, text, _ in blocks if kind != "image")


def archive_blocks(documents: DataFrame) -> DataFrame:
    """documents(path, spine, document, html, covers) -> BLOCKS: typed blocks with image paths inside the archive, and whether the document is a cover."""
    bound_batches(documents.sparkSession)
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]

    def run(batches):
        for b in batches:
            rows = []
            for path, spine, document, html, covers in zip(*b.columns, strict=True):
                document = document.as_py()
                blocks = list(read_blocks(html.as_py()))
                cover = is_cover(blocks, document, covers.as_py() or [])
                for seq, kind, text, extra in blocks:
                    level = int(extra["level"]) if "level" in extra else None
                    src = resolve_image(document, extra["src"]) if kind == "image" else None
                    rows.append((path.as_py(), spine.as_py(), document, seq, kind, level, text, src, cover))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return documents.filter("html is not null").select("path", "spine", "document", "html", "covers").mapInArrow(run, BLOCKS)


def block_ids(blocks: DataFrame) -> DataFrame:
    """plus block_id, from columns chapter, kind and the place in the chapter (n)."""
    prefix = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    return blocks.withColumn("block_id", F.concat(F.lit("c"), "chapter", F.lit("."), F.element_at(prefix, F.col("kind")), F.col("n")))


CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{0}" media-type="application/oebps-package+xml"/></rootfiles></container>'


def write_archive(documents: list[tuple[str, str]], meta: dict[str, str], files: dict[str, bytes] | None = None, cover: str | None = None, folder: str = "book") -> bytes:
    """An EPUB of (name, html) documents in reading order, the same bytes whenever it is made; files: further members by name, cover: the one to declare."""
    from xml.sax.saxutils import escape, quoteattr

    out = io.BytesIO()
    items = [f'<item id="d{i}" href={quoteattr(n)} media-type="application/xhtml+xml"/>' for i, (n, _) in enumerate(documents)]
    items += [f'<item id="f{i}" href={quoteattr(n)} media-type="image/png"{" properties=" + chr(34) + "cover-image" + chr(34) if n == cover else ""}/>' for i, n in enumerate(files or {})]
    names = {v: k for k, v in DUBLIN_CORE.items()}
    package = (
        '<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        + "".join(f"<dc:{names[k]}>{escape(v)}</dc:{names[k]}>" for k, v in meta.items())
        + f"</metadata><manifest>{''.join(items)}</manifest><spine>{''.join(f'<itemref idref={chr(34)}d{i}{chr(34)}/>' for i in range(len(documents)))}</spine></package>"
    )
    with zipfile.ZipFile(out, "w") as z:
        members = [("mimetype", b"application/epub+zip", zipfile.ZIP_STORED), ("META-INF/container.xml", CONTAINER.format(f"{folder}/package.opf").encode(), zipfile.ZIP_DEFLATED)]
        members += [(f"{folder}/package.opf", package.encode(), zipfile.ZIP_DEFLATED)]
        members += [(f"{folder}/{n}", html.encode("utf-8", "replace"), zipfile.ZIP_DEFLATED) for n, html in documents]
        members += [(f"{folder}/{n}", data, zipfile.ZIP_STORED) for n, data in (files or {}).items()]
        for name, data, how in members:
            entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            entry.compress_type = how
            z.writestr(entry, data)
    return out.getvalue()
