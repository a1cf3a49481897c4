"""Ordered text blocks: reading them from documents, checking them, and finding defects in their text.

A document is an edition; its lines that hold something are its blocks, three lines make a chapter. A short line without
an end mark is a heading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import Registry
from ..session import table

R = Registry()
LINES_A_CHAPTER = 3

#: Phrases that give away text of a library around a book.
MARKERS = ("all rights reserved", "licensed under", "terms of use", "project library")

BLOCKS = r"""raw AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
kept AS (SELECT *, trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos FROM kept WHERE t <> ''),
blocks AS (SELECT doc_id, source, lang, CAST(pos AS BIGINT) AS pos, pos // 3 + 1 AS chapter, pos % 3 + 1 AS seq,
  CASE WHEN length(t) < 40 AND NOT regexp_matches(t, '[.!?]$') THEN 'heading' ELSE 'paragraph' END AS kind, t AS text FROM placed)"""


def blocks(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(doc_id, source, lang, pos, chapter, seq, kind, text), blank lines dropped. Positions come from an array per
    document, so nothing is shuffled. dealt: for what counts words by document. Texts are dealt out by document first, which moves
    fewer bytes than a row for each of their words would, and spares that shuffle."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", "lang", "text").repartition("doc_id") if dealt else docs
    lines = F.filter(F.transform(F.split("text", "\n"), T.normal_space), lambda x: x != "")
    out = docs.select("doc_id", "source", "lang", F.posexplode(lines).alias("pos", "text"))
    kind = F.when((F.length("text") < 40) & ~F.col("text").rlike("[.!?]$"), "heading").otherwise("paragraph")
    return out.select("doc_id", "source", "lang", F.col("pos").cast("long").alias("pos"), (F.floor(F.col("pos") / LINES_A_CHAPTER) + 1).alias("chapter"), (F.col("pos") % LINES_A_CHAPTER + 1).cast("long").alias("seq"), kind.alias("kind"), "text")


@R.query("ING-02 ING-03 ARR-02", f"WITH {BLOCKS} SELECT doc_id, chapter, seq, kind, format('c{{}}.{{}}{{}}', chapter, left(kind, 1), seq) AS block_id, text FROM blocks")
def blocks_view(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return b.select("doc_id", "chapter", "seq", "kind", F.format_string("c%d.%s%d", "chapter", F.substring("kind", 1, 1), "seq").alias("block_id"), "text")


@R.query("ING-02", "WITH l AS (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || ' ' || chr(9) || chr(10)), chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS dropped FROM l WHERE trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g')) = '' GROUP BY doc_id")
def empty_block_warnings(spark, sf_dir):
    """Lines dropped because nothing is in them, over texts with a blank line behind each sentence."""
    spaced = F.replace("text", F.lit(". "), F.lit(".\n \t\n"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(spaced, "\n")).alias("line"))
    return lines.filter(T.normal_space(F.col("line")) == "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("dropped"))


@R.query("ING-21 WIN-11", f"WITH {BLOCKS}, s AS (SELECT *, seq - lag(seq, 1, 0) OVER (PARTITION BY doc_id, chapter ORDER BY pos) <> 1 AS gap FROM blocks) SELECT doc_id, count(*) AS blocks, count(DISTINCT (chapter, seq)) AS ids, count(*) FILTER (gap) AS gaps FROM s GROUP BY doc_id HAVING count(*) <> count(DISTINCT (chapter, seq)) OR count(*) FILTER (gap) > 0 UNION ALL SELECT -1, count(*), count(*), 0 FROM blocks")
def artifact_violations(spark, sf_dir):
    """Editions whose ids repeat or whose sequence has gaps, and one line with the number of blocks checked."""
    b = blocks(spark, sf_dir)
    gap = F.col("seq") - F.lag("seq", 1, 0).over(W.partitionBy("doc_id", "chapter").orderBy("pos")) != 1
    g = b.withColumn("gap", gap).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("chapter", "seq").alias("ids"), F.count_if("gap").alias("gaps"))
    total = b.agg(F.lit(-1).cast("long").alias("doc_id"), F.count(F.lit(1)).alias("blocks"), F.count(F.lit(1)).alias("ids"), F.lit(0).cast("long").alias("gaps"))
    return g.filter((F.col("blocks") != F.col("ids")) | (F.col("gaps") > 0)).unionByName(total)


SEVERITIES = {"empty": "info", "duplicate": "warning", "unreadable": "error"}


@R.query("ING-22 MAP-01", "SELECT event_id, CASE event_type WHEN 'click' THEN 'info' WHEN 'view' THEN 'warning' WHEN 'error' THEN 'error' ELSE 'warning' END AS severity FROM events")
def warning_severity(spark, sf_dir):
    """Severity of a warning's code; an unknown code is a warning."""
    codes = {"click": SEVERITIES["empty"], "view": SEVERITIES["duplicate"], "error": SEVERITIES["unreadable"]}
    known = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(known, "event_type"), F.lit("warning")).alias("severity"))


@R.query("ING-07 ING-13 STR-13", rf"WITH {BLOCKS} SELECT doc_id, pos, regexp_matches(lower(text), '^\[?(pg|page)? ?([0-9]+|[ivxlc]+)\]?$') AS page_line, regexp_matches(lower(text), '^((chapter|part|book) )?([0-9]+|[ivxlc]+)([. ].*)?$') AS numbered FROM blocks")
def line_predicates(spark, sf_dir):
    """Lines that are page numbers, and titles that start with a number."""
    t = F.lower("text")
    return blocks(spark, sf_dir).select("doc_id", "pos", t.rlike(r"^\[?(pg|page)? ?([0-9]+|[ivxlc]+)\]?$").alias("page_line"), t.rlike(r"^((chapter|part|book) )?([0-9]+|[ivxlc]+)([. ].*)?$").alias("numbered"))


@R.query("ING-12", rf"WITH {BLOCKS} SELECT doc_id, pos, text FROM blocks WHERE kind = 'heading' QUALIFY count(*) OVER (PARTITION BY doc_id, lower(text)) < 3")
def chapter_headings(spark, sf_dir):
    """Headings that occur less than three times in their document; others are speakers' names."""
    h = blocks(spark, sf_dir).filter("kind = 'heading'")
    return h.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("doc_id", F.lower("text")))).filter("n < 3").select("doc_id", "pos", "text")


@R.query("ING-13", f"WITH {BLOCKS}, s AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM blocks) SELECT doc_id, CAST(part AS BIGINT) AS part, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, min(pos) AS first_pos FROM s GROUP BY doc_id, part")
def chapter_cut(spark, sf_dir):
    """Chapters cut at headings; what stands before the first is part 0."""
    part = F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("pos"))
    b = blocks(spark, sf_dir).withColumn("part", part)
    return b.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"), F.min("pos").alias("first_pos"))


@R.query("ING-16", f"WITH {BLOCKS}, c AS (SELECT doc_id, chapter, bool_and(kind = 'heading') AS bare FROM blocks GROUP BY ALL), s AS (SELECT *, sum(CASE WHEN bare THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY chapter) - CASE WHEN bare THEN 0 ELSE 1 END + 1 AS joined, sum(CASE WHEN bare THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) AS whole FROM c) SELECT doc_id, chapter, bare, CAST(greatest(1, least(joined, whole)) AS BIGINT) AS folded FROM s")
def fold_bare_chapters(spark, sf_dir):
    """Chapters of headings alone join the next one, a last one the previous; numbers close up."""
    c = blocks(spark, sf_dir).groupBy("doc_id", "chapter").agg(F.bool_and(F.col("kind") == "heading").alias("bare"))
    full = F.when(F.col("bare"), 0).otherwise(1)
    w = W.partitionBy("doc_id")
    joined, whole = F.sum(full).over(w.orderBy("chapter")) - full + 1, F.sum(full).over(w)
    return c.select("doc_id", "chapter", "bare", F.greatest(F.lit(1), F.least(joined, whole)).cast("long").alias("folded"))


@R.query("ING-17 ING-18", f"WITH {BLOCKS}, m AS (SELECT *, max(CASE WHEN text ILIKE '%all rights reserved%' THEN pos END) OVER (PARTITION BY doc_id) AS start_at FROM blocks), e AS (SELECT *, min(CASE WHEN text ILIKE '%licensed under%' AND pos > coalesce(start_at, -1) THEN pos END) OVER (PARTITION BY doc_id) AS end_at FROM m) SELECT doc_id, pos, text FROM e WHERE pos > coalesce(start_at, -1) AND pos < coalesce(end_at, 1000000000)")
def trim_matter(spark, sf_dir):
    """What stands after the last start marker and before the first end marker after it."""
    w = W.partitionBy("doc_id")
    low = F.lower("text")
    m = blocks(spark, sf_dir).withColumn("start_at", F.coalesce(F.max(F.when(low.contains("all rights reserved"), F.col("pos"))).over(w), F.lit(-1)))
    e = m.withColumn("end_at", F.min(F.when(low.contains("licensed under") & (F.col("pos") > F.col("start_at")), F.col("pos"))).over(w))
    return e.filter((F.col("pos") > F.col("start_at")) & (F.col("end_at").isNull() | (F.col("pos") < F.col("end_at")))).select("doc_id", "pos", "text")


@R.query("ING-19 ING-05 ING-20", "SELECT page_id, regexp_matches(url, '/(en|de)/[0-9]+') AS library_page, list_has_any(string_split_regex(regexp_extract(url, '://([^/]*)', 1), '[.]'), ['blog', 'news']) AS marked, length(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', '', 'g'), '<[^>]*>|[ \\t\\n]+', '', 'g')) = 0 AND contains(html, '<img') AS cover FROM pages")
def page_predicates(spark, sf_dir):
    """Library pages by their address, marker words, and covers: images without text."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/]*)", 1)
    bare = F.regexp_replace(F.regexp_replace("html", "(?s)<script.*?</script>|<style.*?</style>", ""), r"<[^>]*>|[ \t\n]+", "")
    return p.select("page_id", F.col("url").rlike("/(en|de)/[0-9]+").alias("library_page"), F.arrays_overlap(F.split(host, "[.]"), F.array(F.lit("blog"), F.lit("news"))).alias("marked"), ((F.length(bare) == 0) & F.contains("html", F.lit("<img"))).alias("cover"))


@R.query("ING-09", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines, count(*) >= 2 AND median(length(line)) < 60 AS verse FROM l WHERE trim(line, ' ') <> '' GROUP BY doc_id")
def verse_classifier(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.trim("line") != "")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), ((F.count(F.lit(1)) >= 2) & (F.percentile(F.length("line"), F.lit(0.5)) < 60)).alias("verse"))


@R.query("AGG-31 AGG-26 HSH-01", f"WITH {BLOCKS} SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))) AS BIGINT) AS words, sha256(string_agg(text || chr(0), '' ORDER BY pos)) AS content_hash FROM blocks GROUP BY doc_id")
def content_hash(spark, sf_dir):
    """Words of an edition, and the digest of its blocks in reading order, each ended by NUL."""
    b = blocks(spark, sf_dir).groupBy("doc_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    joined = F.array_join(F.transform("b", lambda x: F.concat(x["text"], F.lit("\0"))), "")
    return b.select("doc_id", "words", F.sha2(joined, 256).alias("content_hash"))


@R.query("WIN-10 TXT-16", f"WITH {BLOCKS}, n AS (SELECT *, lower(text) AS norm FROM blocks WHERE length(text) >= 100) SELECT doc_id, pos, first_doc, first_pos FROM (SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_pos, row_number() OVER w AS rn FROM n WINDOW w AS (PARTITION BY norm ORDER BY doc_id, pos)) WHERE rn > 1")
def duplicate_blocks(spark, sf_dir):
    """Later blocks with a text of 100 characters or more seen before, and the first that had it. A minimum by digest, joined back: no
    sort of a text's whole group."""
    n = blocks(spark, sf_dir).filter(F.length("text") >= 100).select("doc_id", "pos", F.sha2(F.lower("text"), 256).alias("k"))
    first = n.groupBy("k").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    both = n.join(first, "k").filter((F.col("doc_id") != F.col("f.doc_id")) | (F.col("pos") != F.col("f.pos")))
    return both.select("doc_id", "pos", F.col("f.doc_id").alias("first_doc"), F.col("f.pos").alias("first_pos"))


@R.query("TXT-11", f"WITH {BLOCKS} SELECT doc_id, pos, marker FROM blocks, (VALUES ('all rights reserved'), ('licensed under'), ('terms of use'), ('project library')) m(marker) WHERE contains(lower(text), marker)")
def boilerplate_markers(spark, sf_dir):
    hits = F.filter(F.array(*[F.lit(m) for m in MARKERS]), lambda m: F.contains(F.lower("text"), m))
    return blocks(spark, sf_dir).select("doc_id", "pos", F.explode(hits).alias("marker"))


@R.query("TXT-12", f"WITH {BLOCKS}, c AS (SELECT doc_id, pos, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS place FROM blocks WHERE regexp_matches(text, '[\\x{{FFFD}}\\p{{Cf}}#%]')) SELECT doc_id, pos, CAST(place AS INTEGER) AS place, ch FROM c WHERE ch <> chr(173) AND regexp_matches(ch, '[\\x{{FFFD}}\\p{{Cf}}#%]')")
def odd_characters(spark, sf_dir):
    """Each replacement, format or noise character with its offset; soft hyphens are left alone."""
    odd = r"[\x{FFFD}\p{Cf}#%&&[^\x{AD}]]"
    b = blocks(spark, sf_dir).filter(F.col("text").rlike(odd))
    return b.select("doc_id", "pos", F.posexplode(F.split("text", "")).alias("place", "ch")).filter(F.col("ch").rlike(odd))


@R.query("TXT-17 MAP-02", f"WITH {BLOCKS} SELECT doc_id, pos, sha256(concat_ws(chr(0), CAST(doc_id AS VARCHAR), 'marker', 'None', CAST(length(text) AS VARCHAR), left(text, 20), '')) AS fingerprint FROM blocks")
def finding_fingerprint(spark, sf_dir):
    parts = [F.col("doc_id").cast("string"), F.lit("marker"), F.coalesce(F.lit(None).cast("string"), F.lit("None")), F.length("text").cast("string"), F.substring("text", 1, 20), F.lit("")]
    return blocks(spark, sf_dir).select("doc_id", "pos", F.sha2(F.concat_ws("\0", *parts), 256).alias("fingerprint"))


@R.query("TXT-01", f"WITH {BLOCKS}, s AS (SELECT doc_id, pos, unnest(string_split_regex(regexp_replace(text, '([.!?…]) +', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM blocks) SELECT doc_id, pos, count(*) AS sentences, max(length(sentence)) AS longest FROM s WHERE sentence <> '' GROUP BY doc_id, pos")
def sentence_split(spark, sf_dir):
    s = blocks(spark, sf_dir).select("doc_id", "pos", F.explode(F.split("text", "(?<=[.!?…]) +")).alias("sentence")).filter("sentence <> ''")
    return s.groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("sentences"), F.max(F.length("sentence")).cast("long").alias("longest"))


@R.query("TXT-02 ARR-01 ARR-03", f"""WITH {BLOCKS}, s AS (SELECT doc_id, pos, unnest(string_split_regex(regexp_replace(text, '([.!?…]) +', '\\1' || chr(1), 'g'), chr(1))) AS sentence, generate_subscripts(string_split_regex(regexp_replace(text, '([.!?…]) +', '\\1' || chr(1), 'g'), chr(1)), 1) AS id FROM blocks),
o AS (SELECT *, coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id, pos ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM s)
SELECT doc_id, pos, id::INT AS id, start, (start + length(sentence))::INT AS stop, sentence FROM o WHERE sentence <> ''""")
def sentence_offsets(spark, sf_dir):
    """Sentences as spans, found from a running offset inside each block: one fold over its pieces."""
    b = blocks(spark, sf_dir).select("doc_id", "pos", "text", F.split("text", "(?<=[.!?…]) +").alias("s"))
    kind = "array<struct<id:int,start:int,stop:int>>"
    folded = F.expr(f"aggregate(filter(s, x -> x <> ''), named_struct('at', 1, 'out', cast(array() as {kind})), (acc, x) -> named_struct('at', locate(x, text, acc.at) + length(x), 'out', array_append(acc.out, named_struct('id', size(acc.out) + 1, 'start', locate(x, text, acc.at) - 1, 'stop', locate(x, text, acc.at) - 1 + length(x)))), acc -> acc.out)")
    return b.select("doc_id", "pos", "text", F.inline(folded)).select("doc_id", "pos", "id", "start", "stop", T.span(F.col("text"), F.col("start"), F.col("stop")).alias("sentence"))


@R.query("TXT-26", f"WITH {BLOCKS}, f AS (SELECT doc_id, pos, text FROM blocks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 3) SELECT doc_id, left(string_agg(text, chr(10) || chr(10) ORDER BY pos), 400) AS opening FROM f GROUP BY doc_id")
def opening_excerpt(spark, sf_dir, pieces=3, budget=400):
    b = blocks(spark, sf_dir).filter(F.col("pos") < pieces).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    return b.select("doc_id", F.substring(F.array_join(F.transform("b", lambda x: x["text"]), "\n\n"), 1, budget).alias("opening"))


@R.query("TXT-29 FLT-13", f"WITH {BLOCKS}, w AS (SELECT doc_id, pos, string_split(lower(text), ' ') AS w FROM blocks), g AS (SELECT doc_id, pos, unnest([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) AS gram FROM w WHERE len(w) >= 5) SELECT doc_id, pos, count(*) AS repeated FROM (SELECT doc_id, pos, gram FROM g GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id, pos")
def repeated_phrases(spark, sf_dir):
    """Blocks in which a run of five words comes twice. A block's runs are looked at in its own row, in order, so that none is shuffled."""
    once = lambda c: F.explode(F.array(c))  # noqa: E731  made once a row: a filter that looks at it is not moved below
    w = blocks(spark, sf_dir).select("doc_id", "pos", once(F.split(F.lower("text"), " ")).alias("w")).filter(F.size("w") >= 5)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(5)), " "))
    g = w.select("doc_id", "pos", once(grams).alias("grams")).filter(F.size(F.array_distinct("grams")) < F.size("grams"))
    g = g.select("doc_id", "pos", once(F.array_sort("grams")).alias("g"))
    same = lambda i, j: F.get("g", i).eqNullSafe(F.get("g", j))
    second = F.filter(F.sequence(F.lit(1), F.size("g") - 1), lambda i: same(i, i - 1) & ~((i > 1) & same(i - 1, i - 2)))
    return g.select("doc_id", "pos", F.size(second).cast("long").alias("repeated"))


PACK_LIMIT = 1200


@R.query("WIN-07 TXT-28 ING-14", f"""WITH RECURSIVE {BLOCKS}, p AS (
  SELECT doc_id, pos, 1 AS win, length(text) AS used FROM blocks WHERE pos = 0
  UNION ALL
  SELECT b.doc_id, b.pos, CASE WHEN p.used + length(b.text) > {PACK_LIMIT} THEN p.win + 1 ELSE p.win END, CASE WHEN p.used + length(b.text) > {PACK_LIMIT} THEN length(b.text) ELSE p.used + length(b.text) END
  FROM p JOIN blocks b ON b.doc_id = p.doc_id AND b.pos = p.pos + 1)
SELECT doc_id, CAST(win AS INTEGER) AS win, count(*) AS blocks, CAST(max(used) AS BIGINT) AS chars FROM p GROUP BY doc_id, win""")
def window_packing(spark, sf_dir, limit=PACK_LIMIT):
    """Greedy windows of blocks under a limit of characters; a block over it has a window of its own. A fold over each document's sizes."""
    b = blocks(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.length("text").alias("n")))), lambda x: x["n"]).alias("sizes"))
    kind = "array<struct<win:int,n:int>>"
    fold = F.expr(f"aggregate(sizes, named_struct('w', 1, 's', 0, 'out', cast(array() as {kind})), (a, x) -> if(a.s > 0 and a.s + x > {limit}, named_struct('w', a.w + 1, 's', x, 'out', array_append(a.out, named_struct('win', a.w + 1, 'n', x))), named_struct('w', a.w, 's', a.s + x, 'out', array_append(a.out, named_struct('win', a.w, 'n', x)))), a -> a.out)")
    return b.select("doc_id", F.inline(fold)).groupBy("doc_id", "win").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("chars"))


@R.query("WIN-12", f"WITH {BLOCKS}, c AS (SELECT doc_id, chapter, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks GROUP BY ALL) SELECT doc_id, chapter, chars FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chapter) IN (1, count(*) OVER (PARTITION BY doc_id) // 2 + 1, count(*) OVER (PARTITION BY doc_id))")
def first_middle_last(spark, sf_dir):
    c = blocks(spark, sf_dir).groupBy("doc_id", "chapter").agg(F.sum(F.length("text")).alias("chars"))
    n, total = F.row_number().over(W.partitionBy("doc_id").orderBy("chapter")), F.count(F.lit(1)).over(W.partitionBy("doc_id"))
    return c.withColumns({"n": n, "total": total}).filter((F.col("n") == 1) | (F.col("n") == F.floor(F.col("total") / 2) + 1) | (F.col("n") == F.col("total"))).select("doc_id", "chapter", "chars")


@R.query("WIN-13", f"WITH {BLOCKS}, c AS (SELECT doc_id, chapter, row_number() OVER (PARTITION BY doc_id ORDER BY chapter) - 1 AS i FROM blocks GROUP BY doc_id, chapter) SELECT doc_id, chapter FROM c WHERE i >= 1 AND (i - 1) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chapter) <= 2")
def stepped_sample(spark, sf_dir, step=2, count=2):
    """Every step-th chapter from the middle of the first step on, so many at most."""
    c = blocks(spark, sf_dir).select("doc_id", "chapter").distinct()
    i = F.row_number().over(W.partitionBy("doc_id").orderBy("chapter")) - 1
    return c.withColumn("i", i).filter((F.col("i") >= step // 2) & ((F.col("i") - step // 2) % step == 0) & (F.col("i") < step // 2 + step * count)).select("doc_id", "chapter")


@R.query("WIN-14", f"WITH {BLOCKS} SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chapter, seq) AS INTEGER) AS number, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY chapter, seq) - 1) % 6 AS INTEGER) AS tint FROM blocks")
def group_numbers(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("chapter", "seq"))
    return blocks(spark, sf_dir).select("doc_id", "pos", n.alias("number"), F.pmod(n - 1, F.lit(6)).alias("tint"))


@R.query("TXT-21 WIN-04", f"""WITH {BLOCKS}, t AS (SELECT doc_id, chapter, arg_min(text, pos) AS title, arg_min(kind, pos) AS kind, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks GROUP BY ALL),
s AS (SELECT *, kind = 'heading' AND NOT contains(lower(title), 'rights') AS story FROM t),
f AS (SELECT *, min(chapter) FILTER (story) OVER w AS first_story, max(chapter) FILTER (story) OVER w AS last_story FROM s WINDOW w AS (PARTITION BY doc_id))
SELECT doc_id, chapter, CASE WHEN first_story IS NULL THEN 'body' WHEN chapter < first_story THEN 'front' WHEN chapter > last_story AND kind = 'heading' THEN 'back' ELSE 'body' END AS role FROM f""")
def chapter_roles(spark, sf_dir):
    return roles(blocks(spark, sf_dir)).select("doc_id", "chapter", "role")


def roles(b: DataFrame) -> DataFrame:
    """Front matter stands before the first story chapter, titled chapters after the last are back matter, the rest is body."""
    t = b.groupBy("doc_id", "chapter").agg(F.min_by("text", "pos").alias("title"), F.min_by("kind", "pos").alias("kind"), F.sum(F.length("text")).alias("chars"))
    s = t.withColumn("story", (F.col("kind") == "heading") & ~F.lower("title").contains("rights"))
    w = W.partitionBy("doc_id")
    f = s.withColumns({"first_story": F.min(F.when(F.col("story"), F.col("chapter"))).over(w), "last_story": F.max(F.when(F.col("story"), F.col("chapter"))).over(w)})
    role = F.when(F.col("first_story").isNull(), "body").when(F.col("chapter") < F.col("first_story"), "front").when((F.col("chapter") > F.col("last_story")) & (F.col("kind") == "heading"), "back").otherwise("body")
    return f.withColumn("role", role)


@R.query("TXT-22 AGG-18 AGG-33", f"""WITH {BLOCKS}, c AS (SELECT doc_id, chapter, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks GROUP BY ALL),
m AS (SELECT doc_id, count(*) AS body, CAST(sum(chars) AS BIGINT) AS chars, max(chars) / sum(chars) AS largest, count(*) FILTER (chars < 400) / count(*) AS tiny, CAST(floor(median(chars)) AS BIGINT) AS mid FROM c GROUP BY doc_id)
SELECT doc_id, body, chars, mid, concat_ws(',', CASE WHEN chars >= 60000 AND body <= 2 THEN 'few' END, CASE WHEN body > 2 AND largest > 0.40 THEN 'lopsided' END, CASE WHEN tiny > 0.25 THEN 'tiny' END) AS reasons FROM m""")
def source_shape(spark, sf_dir):
    """Shape of each book and what makes it suspect."""
    c = blocks(spark, sf_dir).groupBy("doc_id", "chapter").agg(F.sum(F.length("text")).alias("chars"))
    m = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("body"), F.sum("chars").alias("chars"), (F.max("chars") / F.sum("chars")).alias("largest"), (F.count_if(F.col("chars") < 400) / F.count(F.lit(1))).alias("tiny"), F.floor(F.percentile("chars", F.lit(0.5))).cast("long").alias("mid"))
    reasons = F.concat_ws(",", F.when((F.col("chars") >= 60000) & (F.col("body") <= 2), "few"), F.when((F.col("body") > 2) & (F.col("largest") > 0.40), "lopsided"), F.when(F.col("tiny") > 0.25, "tiny"))
    return m.select("doc_id", "body", "chars", "mid", reasons.alias("reasons"))


@R.query("ING-08", "WITH p AS (SELECT conv_id, turn, unnest(string_split_regex(text, '\\n[ \\t]*\\n|\\n')) AS part FROM conversations) SELECT conv_id, turn, count(*) AS paragraphs FROM p WHERE trim(part, ' ' || chr(9)) <> '' GROUP BY ALL")
def loose_paragraphs(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"\n[ \t]*\n|\n")).alias("part"))
    return p.filter(F.btrim("part", F.lit(" \t")) != "").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("paragraphs"))
