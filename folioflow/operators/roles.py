"""What each chapter of a book is, read off its title: front matter, the story, back matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import Registry
from .blocks import BLOCKS, blocks

R = Registry()

# Words for a numbered chapter, for what stands around a story, and for its end; all as small letters.
LABELS = "chapter chapitre kapitel capitolo capítulo глава розділ letter lettre brief book livre buch part partie teil частина".split()
MATTER = (
    "preface,préface,prefazione,prefacio,pr[óo]logo,vorwort,vorrede,avant-propos,передмова,foreword,introdu*,einleitung,einführung,"
    "вступ,dedication,dédicace,dedica,dedicatoria,widmung,zueignung,присвята,contents,table des matières,sommaire,inhalt(sverzeichnis)?,"
    "[íi]ndice,зміст,illustrations?,afterword,nachwort,післямова,appendix,appendice,anhang,додаток,notes?,notas?,anmerkungen,przypisy,"
    "примітки,avvertenza,advertencia,glossary,glossaire,glossar,глосарій,bibliography,bibliographie,бібліографія,acknowledg*,"
    "transcriber,about the author,über den autor,про автора,colophon,advertisements?,errata,there are several editions of this ebook"
).split(",")
CLOSINGS = "fin,fine,the end,ende,finis,конец,кінець".split(",")

# How a title is read.
_W = r"[\p{L}\p{N}_]"
_N = r"[^\p{L}\p{N}_]"
_LABELLED = rf"^{_N}*({'|'.join(LABELS)}|[0-9]+({_N}|$))"
_FIRST_WORD = r"^[(\[\-–— ]*([^\s.:;,\-–—)\]]*)"
_ROMAN = "^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
_MATTER = rf"(^|{_N})({'|'.join(MATTER).replace('*', _W + '*')})($|{_N})"
_CLOSING = rf"^{_N}*({'|'.join(CLOSINGS)}){_N}*$"


def is_numbered(title: Column) -> Column:
    """A title that opens with a label word, digits, or a well-formed Roman numeral as its first word."""
    low = F.lower(F.trim(title))
    first = F.regexp_extract(low, _FIRST_WORD, 1)
    return low.rlike(_LABELLED) | ((first != "") & first.rlike(_ROMAN))


def is_closing(title: Column) -> Column:
    return F.lower(F.trim(title)).rlike(_CLOSING)


def is_matter(title: Column) -> Column:
    """A title of what stands around a story."""
    low = F.lower(F.trim(title))
    return (low != "") & (is_closing(title) | (~is_numbered(title) & low.rlike(_MATTER)))


def is_story(title: Column) -> Column:
    low = F.lower(F.trim(title))
    return (low != "") & ~is_closing(title) & (is_numbered(title) | ~low.rlike(_MATTER))


def same_title(title: Column, name: Column) -> Column:
    """Whether a chapter's title is the book's or the author's, or the start of it, or the other way round; signs and blanks aside."""
    a, b = (F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), _N, "")) for c in (title, name))
    return (a != "") & (b != "") & (F.startswith(a, b) | F.startswith(b, a))


def title_roles_of(chapters: DataFrame) -> DataFrame:
    """chapters(book, chapter, title, book_title, author, by_size) -> plus role.

    The story runs from its first numbered title, or else its first title, to its last one; what ingest cut by size is story whatever it is called.
    Leading titles that are the book's own or its author's are no story. Without story titles the untitled chapters are it, if there are others beside
    them, else all is body. Untitled chapters after the start are the story's; matter inside it is front matter before its middle and back
    matter after it. Null titles are blank ones, null by_size is false.
    """
    book = W.partitionBy("book")
    title, sized = F.coalesce("title", F.lit("")), F.coalesce("by_size", F.lit(False))
    at = lambda flag, pick: pick(F.when(flag, F.col("place"))).over(book)
    c = chapters.withColumn("place", F.row_number().over(book.orderBy("chapter")))
    c = c.withColumns({"named": same_title(title, F.col("book_title")) | same_title(title, F.col("author")), "tale": sized | is_story(title), "blank": (F.trim(title) == "") & ~sized})
    own = F.col("tale") & F.col("named") & ~sized
    c = c.withColumn("opens", at(F.col("tale") & ~own, F.min))
    c = c.withColumn("tale", F.col("tale") & ~(own & F.coalesce(F.col("place") < F.col("opens"), F.lit(True))))
    mixed = F.max("blank").over(book) & ~F.min("blank").over(book)
    c = c.withColumns({"told": F.max("tale").over(book), "mixed": mixed})
    c = c.withColumn("tale", F.when(F.col("told"), F.col("tale")).otherwise(F.col("blank") & F.col("mixed")))
    first = F.coalesce(at(F.col("tale") & is_numbered(title), F.min), at(F.col("tale"), F.min))
    c = c.withColumn("first", F.least(first, at(sized, F.min)))
    c = c.withColumn("last", at(F.col("tale") | (F.col("blank") & (F.col("place") > F.col("first"))), F.max))
    inside = F.when(is_matter(title), F.when(2 * F.col("place") < F.col("first") + F.col("last"), "front").otherwise("back")).otherwise("body")
    role = F.when(~(F.col("told") | F.col("mixed")), "body").when(F.col("place") < F.col("first"), "front").when(F.col("place") > F.col("last"), "back").otherwise(inside)
    return c.select(*chapters.columns, role.alias("role"))


#: Titles that a table of invented words lacks, and how they are dealt to the chapters of the documents.
PLANTED = ("", "Preface", "Chapter 3", "The End", "D. Tale 1", "Notes", "IV. Of Notes", "Civil War", "A Writer", "ÍNDICE", "", "Introductory remarks")

_SQL = f"""WITH {BLOCKS}, c AS (SELECT doc_id AS book, chapter, arg_min(text, pos) AS head, sum(length(text)) AS chars FROM blocks GROUP BY ALL),
t AS (SELECT book, chapter, CASE WHEN chars % 14 < 12 THEN [{', '.join(f"'{p}'" for p in PLANTED)}][(chars % 14)::INT + 1] ELSE head END AS title, chars % 19 = 0 AS sized, row_number() OVER (PARTITION BY book ORDER BY chapter) AS place FROM c),
w AS (SELECT *, lower(trim(title)) AS low, regexp_extract(lower(trim(title)), '{_FIRST_WORD}', 1) AS word FROM t),
n AS (SELECT *, regexp_matches(low, '{_LABELLED}') OR (word <> '' AND regexp_matches(word, '{_ROMAN}')) AS numbered, regexp_matches(low, '{_CLOSING}') AS closing, regexp_matches(low, '{_MATTER}') AS around, lower(regexp_replace(title, '{_N}', '', 'g')) AS plain FROM w),
s AS (SELECT *, sized OR (low <> '' AND NOT closing AND (numbered OR NOT around)) AS tale0, low = '' AND NOT sized AS blank, plain <> '' AND (starts_with(plain, 'dtale1') OR starts_with('dtale1', plain) OR starts_with(plain, 'awriter') OR starts_with('awriter', plain)) AS named FROM n),
o AS (SELECT *, min(place) FILTER (tale0 AND (sized OR NOT named)) OVER (PARTITION BY book) AS opens FROM s),
u AS (SELECT *, tale0 AND NOT (named AND NOT sized AND (opens IS NULL OR place < opens)) AS tale1, bool_or(blank) OVER (PARTITION BY book) AND NOT bool_and(blank) OVER (PARTITION BY book) AS mixed FROM o),
v AS (SELECT *, bool_or(tale1) OVER (PARTITION BY book) AS told FROM u), x AS (SELECT *, CASE WHEN told THEN tale1 ELSE blank AND mixed END AS tale FROM v),
f AS (SELECT *, least(coalesce(min(place) FILTER (tale AND numbered) OVER (PARTITION BY book), min(place) FILTER (tale) OVER (PARTITION BY book)), coalesce(min(place) FILTER (sized) OVER (PARTITION BY book), 1000000000)) AS first FROM x),
l AS (SELECT *, max(place) FILTER (tale OR (blank AND place > first)) OVER (PARTITION BY book) AS last FROM f)
SELECT book, chapter, title, CASE WHEN NOT told AND NOT mixed THEN 'body' WHEN place < first THEN 'front' WHEN place > last THEN 'back' WHEN low <> '' AND (closing OR (NOT numbered AND around)) THEN CASE WHEN place < (first + last) / 2 THEN 'front' ELSE 'back' END ELSE 'body' END AS role FROM l"""


@R.query("TXT-21 WIN-04", _SQL)
def title_roles(spark, sf_dir):
    """Roles of the documents' chapters by planted titles."""
    c = blocks(spark, sf_dir).groupBy(F.col("doc_id").alias("book"), "chapter").agg(F.min_by("text", "pos").alias("head"), F.sum(F.length("text")).alias("chars"))
    pick = (F.col("chars") % 14).cast("int")
    title = F.when(pick < len(PLANTED), F.get(F.array(*[F.lit(p) for p in PLANTED]), pick)).otherwise(F.col("head"))
    t = c.select("book", "chapter", title.alias("title"), F.lit("D. Tale 1").alias("book_title"), F.lit("A. Writer").alias("author"), (F.col("chars") % 19 == 0).alias("by_size"))
    return title_roles_of(t).select("book", "chapter", "title", "role")
