"""Chapters over the spine of a book: cut at the headings of the level most chapters use, carried over documents, long ones cut by size.

Blocks come as (book, spine, seq, kind, level, text): documents of a book in the order of spine, blocks of a document in the order of seq. All
rules are windows over one document's blocks, then one over a book's documents and their segments; texts are not shuffled beyond the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import materialise, table
from ..sources import epub
from .blocks import BLOCKS, blocks

R = Registry()

# Lengths in characters that decide whether a document is cut, and the words that label a chapter.
SHORT, LONG, UNSPLIT, TARGET = 3_000, 25_000, 60_000, 20_000
LABEL_WORDS = "chapter|chapitre|cap[ií]tulo|capitolo|kapitel|teil|part|partie|parte|book|livre|libro|buch|tome|band"
LABEL_CHARS, REPEATED, DEEPEST_HEADING, LABEL_LEVEL = 120, 3, 5, 7

_ROMAN = "m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMERAL = f"([0-9]{{1,3}}|{_ROMAN}|{_ROMAN.upper().replace('{0,3}', '{0,3}')})"
# What a label looks like. A numeral alone, with a label word or marks around it; and a label word with a numeral, followed by a title. Group 1 is the
# numeral, which may come out empty.
ALONE = rf"^[-–—(\[]*\s*(?:(?i:{LABEL_WORDS})\s+)?{_NUMERAL}\s*[-–—.)\]:]*$"
TITLED = rf"^(?i:{LABEL_WORDS})\s+{_NUMERAL}\s*[-–—.:]\s*\S.*$"
TEXTLESS = ("image", "separator")


def is_label(text: Column) -> Column:
    """A paragraph that is only a chapter's label."""
    numeral = (F.regexp_extract(text, ALONE, 1) != "") | (F.regexp_extract(text, TITLED, 1) != "")
    return (F.length(text) <= LABEL_CHARS) & numeral


def cut_chapters(blocks: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """blocks(book, spine, seq, kind, level, text, ...) -> plus segment and part (inside a document), chapter (inside a book, from 1), size (of the text).

    A heading starts a chapter when it is its document's first or prose stands before it since the last heading; one with nothing after it
    stays with the chapter before. Texts that come three times in a document are no headings (they name speakers). Of the starts,
    those at the commonest level (ties: the smallest) and above count; labels are deeper than any heading. Documents under SHORT characters stay
    whole, those up to LONG need two starts. A document that opens in prose after one longer than LONG continues its last chapter.
    Segments over UNSPLIT are cut between blocks at about TARGET.

    Rows are dealt out by book once, and every window and join works on that. carry: the columns to keep, all by default; what is decided on
    texts is decided before, so without text none is shuffled.

    Defined results: null texts are empty; blocks without text start and open nothing; equal (book, spine, seq) are taken in any order; documents
    without a book or a place in it are cut at headings, but not by size.
    """
    keep = blocks.columns if carry is None else list(dict.fromkeys(["book", "spine", "seq", "kind", *carry]))
    text = F.coalesce("text", F.lit(""))
    label = (F.col("kind") == "paragraph") & is_label(text)
    heading = (F.col("kind") == "heading") & (F.coalesce("level", F.lit(1)) <= DEEPEST_HEADING) & (text != "")
    facts = blocks.select(
        *[c for c in keep if c != "size"], F.length(text).alias("size"), label.alias("label"), (label | heading).alias("candidate"), F.when(label | heading, F.lower(text)).alias("same"),
        F.when(label, LABEL_LEVEL).otherwise(F.coalesce("level", F.lit(1))).alias("depth"), ((text != "") & ~F.col("kind").isin(*TEXTLESS)).alias("said"),
    )
    b = facts.repartition("book")
    doc = W.partitionBy("book", "spine")
    order = doc.orderBy("seq")
    upto, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    times = F.sum(F.col("candidate").cast("int")).over(W.partitionBy("book", "spine", "same"))
    b = b.withColumn("opener", F.col("candidate") & (times < REPEATED))
    prose = F.col("said") & ~F.col("opener")
    last_said = F.last(F.when(F.col("said"), F.col("opener")), True).over(before)
    start = F.col("opener") & ~F.coalesce(last_said, F.lit(False)) & (F.max(F.when(prose, F.col("seq"))).over(doc) > F.col("seq"))
    b = b.withColumn("start", F.coalesce(start, F.lit(False)))
    # the commonest level: most starts, then the smallest
    tally = F.array(*[F.struct(F.sum((F.col("start") & (F.col("depth") == k)).cast("int")).over(doc).alias("n"), F.lit(-k).alias("k")) for k in (1, 2, 3, 4, 5, LABEL_LEVEL)])
    b = b.withColumn("start", F.col("start") & (F.col("depth") <= -F.array_max(tally)["k"]))
    first_opener, first_prose = F.min(F.when(F.col("opener"), F.col("seq"))).over(doc), F.min(F.when(prose, F.col("seq"))).over(doc)
    b = b.withColumn("preamble", F.coalesce(first_prose < first_opener, F.lit(False)).cast("int"))
    b = b.withColumn("starts", F.sum(F.col("start").cast("int")).over(doc)).withColumn("length", F.sum("size").over(doc))
    cut = (F.col("length") >= SHORT) & (F.col("starts") + F.col("preamble") >= 2) & ((F.col("length") > LONG) | (F.col("starts") >= 2))
    running = F.sum(F.col("start").cast("int")).over(upto) - 1 + F.col("preamble")
    opens = F.min_by(F.when(F.col("said"), (F.col("kind") != "heading") & ~F.col("label")), F.when(F.col("said"), F.col("seq"))).over(doc)
    b = b.withColumn("segment", F.when(cut, F.greatest(running, F.lit(0))).otherwise(0).cast("int")).withColumn("opens", F.coalesce(opens, F.lit(False)))
    b = _parts(b.select(*[c for c in keep if c != "size"], "size", "segment", "length", "opens"))
    # a new chapter at each part's first block, but for documents that go on with the one before
    shelf = W.partitionBy("book").orderBy("spine", "seq")
    was = F.lag(F.struct("spine", "segment", "part", "length")).over(shelf)
    b = b.withColumn("was", was)
    other = F.col("was").isNull() | ~F.col("was.spine").eqNullSafe(F.col("spine"))
    continues = other & F.col("opens") & (F.coalesce("was.length", F.lit(0)) > LONG)
    new = (other & ~continues) | (~other & ((F.col("was.segment") != F.col("segment")) | (F.col("was.part") != F.col("part"))))
    chapter = F.sum(new.cast("int")).over(shelf.rowsBetween(W.unboundedPreceding, 0))
    return b.select(*[F.col(f"`{c}`") for c in keep if c != "size"], "size", "segment", "part", chapter.alias("chapter"))


def _parts(b: DataFrame) -> DataFrame:
    """plus part: long segments cut between blocks, as soon as the next block would bring a part over TARGET. A fold over the lengths of one segment's blocks finds the cuts."""
    whole = b.withColumn("whole", F.sum("size").over(W.partitionBy("book", "spine", "segment")))
    lengths = F.array_sort(F.collect_list(F.struct("seq", "size")))
    start = F.struct(F.lit(0).alias("held"), F.array().cast("array<bigint>").alias("cuts"))

    def step(a, x):
        over = (a["held"] > 0) & (a["held"] + x["size"] > TARGET)
        return F.struct(F.when(over, x["size"]).otherwise(a["held"] + x["size"]).alias("held"), F.when(over, F.array_append(a["cuts"], x["seq"].cast("long"))).otherwise(a["cuts"]).alias("cuts"))

    cuts = whole.filter(F.col("whole") > UNSPLIT).groupBy("book", "spine", "segment").agg(F.aggregate(lengths, start, step)["cuts"].alias("cuts"))
    joined = whole.join(cuts, ["book", "spine", "segment"], "left")
    part = F.coalesce(F.size(F.filter("cuts", lambda x: x <= F.col("seq"))), F.lit(0))
    return joined.withColumn("part", F.greatest(part, F.lit(0))).drop("whole", "cuts")


def fold_bare(chapters: DataFrame) -> DataFrame:
    """chapters(book, chapter, bare) -> plus folded: chapters of headings and images alone join the next one, a last one the previous; numbers close up."""
    full = F.when(F.col("bare"), 0).otherwise(1)
    w = W.partitionBy("book")
    joined, whole = F.sum(full).over(w.orderBy("chapter")) - full + 1, F.sum(full).over(w)
    return chapters.withColumn("folded", F.greatest(F.lit(1), F.least(joined, whole)).cast("long"))


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as books: four to a spine document, eight of these to a book. Lines are blocks, short ones headings whose level goes by their length."""
    b = blocks(spark, sf_dir)
    heading = F.length("text") < 120
    return b.select(
        F.floor(F.col("doc_id") / 32).alias("book"), F.floor(F.col("doc_id") / 4).alias("spine"), (F.col("doc_id") % 4 * 1_000_000 + F.col("pos")).alias("seq"),
        F.when(heading, "heading").otherwise("paragraph").alias("kind"), F.when(heading, (1 + F.length("text") % 3).cast("int")).alias("level"), "text",
    )


_SQL = f"""WITH {BLOCKS},
b0 AS (SELECT doc_id // 32 AS book, doc_id // 4 AS spine, doc_id % 4 * 1000000 + pos AS seq, CASE WHEN length(text) < 120 THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN length(text) < 120 THEN 1 + length(text) % 3 END AS level, text FROM blocks),
b1 AS (SELECT *, kind = 'paragraph' AND length(text) <= {LABEL_CHARS} AND (regexp_extract(text, '{ALONE}', 1) <> '' OR regexp_extract(text, '{TITLED}', 1) <> '') AS label FROM b0),
b2 AS (SELECT *, kind = 'heading' OR label AS candidate, CASE WHEN label THEN {LABEL_LEVEL} ELSE coalesce(level, 1) END AS depth FROM b1),
b3 AS (SELECT *, candidate AND count(*) FILTER (candidate) OVER (PARTITION BY spine, lower(text)) < {REPEATED} AS opener FROM b2),
b4 AS (SELECT *, opener AND NOT coalesce(lag(opener) OVER (PARTITION BY spine ORDER BY seq), false) AND coalesce(max(seq) FILTER (NOT opener) OVER (PARTITION BY spine) > seq, false) AS start0 FROM b3),
lv AS (SELECT spine, arg_max(depth, n * 10 - depth) AS level FROM (SELECT spine, depth, count(*) AS n FROM b4 WHERE start0 GROUP BY ALL) GROUP BY spine),
b5 AS (SELECT b4.*, start0 AND depth <= lv.level AS start, coalesce(min(seq) FILTER (NOT opener) OVER (PARTITION BY b4.spine) < min(seq) FILTER (opener) OVER (PARTITION BY b4.spine), false)::INT AS preamble,
  sum(length(text)) OVER (PARTITION BY b4.spine) AS length FROM b4 LEFT JOIN lv ON b4.spine = lv.spine),
b6 AS (SELECT *, count(*) FILTER (start) OVER (PARTITION BY spine) AS starts, count(*) FILTER (start) OVER (PARTITION BY spine ORDER BY seq) AS running FROM b5),
b7 AS (SELECT *, CASE WHEN length >= {SHORT} AND starts + preamble >= 2 AND (length > {LONG} OR starts >= 2) THEN greatest(running - 1 + preamble, 0) ELSE 0 END AS segment FROM b6),
z AS (SELECT book, spine, segment, list_reduce(list_prepend({{seq: -1::BIGINT, n: 0::BIGINT, held: 0::BIGINT, cuts: []::BIGINT[]}}, list({{seq: seq::BIGINT, n: length(text)::BIGINT, held: 0::BIGINT, cuts: []::BIGINT[]}} ORDER BY seq)),
  lambda a, x: {{seq: x.seq, n: x.n, held: CASE WHEN a.held > 0 AND a.held + x.n > {TARGET} THEN x.n ELSE a.held + x.n END, cuts: CASE WHEN a.held > 0 AND a.held + x.n > {TARGET} THEN list_append(a.cuts, x.seq) ELSE a.cuts END}}).cuts AS cuts
  FROM b7 GROUP BY ALL HAVING sum(length(text)) > {UNSPLIT}),
b8 AS (SELECT b7.*, coalesce(len(list_filter(z.cuts, lambda y: y <= b7.seq)), 0) AS part FROM b7 LEFT JOIN z USING (book, spine, segment)),
s AS (SELECT book, spine, segment, part, max(length) AS length, arg_min(kind <> 'heading' AND NOT label, seq) AS opens FROM b8 GROUP BY ALL),
n AS (SELECT *, sum(CASE WHEN segment = 0 AND part = 0 AND opens AND coalesce(lag_length, 0) > {LONG} THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY spine, segment, part) AS chapter
  FROM (SELECT *, lag(length) OVER (PARTITION BY book ORDER BY spine, segment, part) AS lag_length FROM s)),
c AS (SELECT n.book, n.chapter, count(*) AS blocks, sum(length(text)) AS chars, min(n.spine) AS first_document, max(n.spine) AS last_document, bool_and(kind = 'heading') AS bare
  FROM b8 JOIN n USING (book, spine, segment, part) GROUP BY n.book, n.chapter),
f AS (SELECT *, sum(1 - bare::INT) OVER (PARTITION BY book ORDER BY chapter) - (1 - bare::INT) + 1 AS joined, sum(1 - bare::INT) OVER (PARTITION BY book) AS whole FROM c)
SELECT book, chapter::BIGINT AS chapter, blocks, chars::BIGINT AS chars, first_document, last_document, bare, greatest(1, least(joined, whole))::BIGINT AS folded FROM f"""


@R.query("ING-13 ING-14 ING-15 ING-16", _SQL)
def book_chapters(spark, sf_dir):
    """Chapters of books whose documents are the given ones: where they start and end, and what they are folded into."""
    cut = cut_chapters(shelf(spark, sf_dir), carry=[])
    c = cut.groupBy("book", "chapter").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("chars"), F.min("spine").alias("first_document"), F.max("spine").alias("last_document"),
        F.bool_and(F.col("kind").isin("heading", *TEXTLESS)).alias("bare"),
    )
    return fold_bare(c).select("book", "chapter", "blocks", "chars", "first_document", "last_document", "bare", "folded")


def page_archives(spark: SparkSession, sf_dir: str, pages_a_book: int = 10) -> DataFrame:
    """pages as EPUB files (path, content), ten to a book, each with an image beside its text, and a cover before them.

    Every seventh book names no author, every ninth no title. The files are written once, as a table of the columns that Spark's reader
    of binary files has.
    """
    import pandas as pd

    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / pages_a_book).alias("book"), "page_id", "html")

    def bind(frame: pd.DataFrame) -> pd.DataFrame:
        frame, book = frame.sort_values("page_id"), int(frame["book"].iloc[0])
        documents = [("cover.xhtml", '<html><body><img src="images/cover.png" alt=""/></body></html>')]
        documents += [(f"text/p{i}.xhtml", f'{html or ""}<img src="../images/./p{i}.png" alt="page {i}"/>') for i, html in zip(frame["page_id"], frame["html"], strict=True)]
        meta = {"title": f"Book {book}", "author": f"Author {book % 5}", "language": "en", "identifier": f"urn:book:{book}"}
        meta = {k: v for k, v in meta.items() if not (k == "author" and book % 7 == 0 or k == "title" and book % 9 == 8)}
        data = epub.write_archive(documents, meta, {"images/cover.png": b"\x89PNG"}, "images/cover.png")
        return pd.DataFrame({"path": [f"books/{book}.epub"], "content": [data]})

    return materialise(p.groupBy("book").applyInPandas(bind, "path string, content binary"), "archives")


_PAGES = "SELECT page_id // 10 AS book, count(*) AS pages FROM pages GROUP BY book"


@R.query("SRC-02 SRC-01", f"SELECT format('books/{{}}.epub', book) AS path, CASE WHEN book % 9 <> 8 THEN format('Book {{}}', book) END AS title, CASE WHEN book % 9 = 8 THEN NULL WHEN book % 7 = 0 THEN 'Unknown' ELSE format('Author {{}}', book % 5) END AS author, book % 9 <> 8 AND book % 7 = 0 AS warned, CASE WHEN book % 9 = 8 THEN 'the archive names no title' END AS error, CASE WHEN book % 9 = 8 THEN 0 ELSE pages + 1 END AS documents FROM ({_PAGES})")
def epub_catalogue(spark, sf_dir):
    """What the archives say of themselves: a missing title is an error, a missing author a warning."""
    d = epub.open_archives(page_archives(spark, sf_dir), ["path", "title", "author", "warnings", "error", "spine", "document"])
    warned = F.coalesce(F.bool_or(F.array_contains("warnings", "author_missing")), F.lit(False))
    return d.groupBy("path").agg(F.max("title").alias("title"), F.max("author").alias("author"), warned.alias("warned"), F.max("error").alias("error"), F.count("document").alias("documents"))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.archive_blocks(epub.open_archives(page_archives(spark, sf_dir), ["path", "covers", "spine", "document", "html"]))


@R.query("SRC-02 ING-01 ING-13 ING-15 UDF-04")
def epub_blocks(spark, sf_dir):
    """Blocks of the archives in reading order, with their chapters; covers left out."""
    b = page_blocks(spark, sf_dir).filter(~F.col("cover")).withColumnRenamed("path", "book")
    n = F.row_number().over(W.partitionBy("book", "chapter").orderBy("spine", "seq"))
    return epub.block_ids(cut_chapters(b).withColumn("n", n)).select("book", "spine", "seq", "chapter", "kind", "block_id", "text")


@R.query("ING-11 ING-20", f"""WITH p AS (SELECT page_id, page_id // 10 AS book FROM pages WHERE (page_id // 10) % 9 <> 8)
SELECT format('books/{{}}.epub', book) AS path, format('book/text/p{{}}.xhtml', page_id) AS document, format('book/images/p{{}}.png', page_id) AS src, false AS cover FROM p
UNION ALL SELECT DISTINCT format('books/{{}}.epub', book), 'book/cover.xhtml', 'book/images/cover.png', true FROM p""")
def epub_images(spark, sf_dir):
    """Images by their places in the archives, and whether they stand on a cover: a document without text, all of whose images are declared covers."""
    return page_blocks(spark, sf_dir).filter("kind = 'image'").select("path", "document", "src", "cover")
