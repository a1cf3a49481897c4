"""Vocabulary of editions: tokens, frequencies, profiles, useful words, names, and defects that frequencies reveal.

Frequencies come from the corpus itself, on the Zipf scale log10(10^9 * share). A lemma is a lower-cased word; other lemmas and
frequency tables can be given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import Registry
from ..session import table
from .blocks import BLOCKS, blocks

R = Registry()
STOP = ("the", "and", "of", "to", "de", "la", "le", "der", "die", "und", "el", "en", "que", "et")

TOKENS = BLOCKS + r""",
words AS (SELECT doc_id, lang, chapter, pos, unnest(regexp_extract_all(text, '\p{L}+')) AS word, generate_subscripts(regexp_extract_all(text, '\p{L}+'), 1) - 1 AS i FROM blocks),
tokens AS (SELECT *, lower(word) AS lemma FROM words),
zipf AS (SELECT lang, lemma, log10(1e9 * count(*) / (sum(count(*)) OVER (PARTITION BY lang))) AS zipf FROM tokens GROUP BY lang, lemma)"""


def tokens(b: DataFrame) -> DataFrame:
    """(doc_id, lang, chapter, pos, i, word, lemma): alphabetic words of blocks."""
    t = b.select("doc_id", "lang", "chapter", "pos", F.posexplode(T.words(F.col("text"))).alias("i", "word"))
    return t.withColumn("lemma", F.lower("word"))


def by_document(t: DataFrame, *more) -> DataFrame:
    """(doc_id, lang, lemma, n, ...): tokens counted in each document."""
    return t.groupBy("doc_id", "lang", "lemma").agg(F.count(F.lit(1)).alias("n"), *more)


def zipf_table(counted: DataFrame) -> DataFrame:
    """(lang, lemma, zipf) from rows with n: counts first, so that only one row a word meets the language's total. Given counts by
    document that a query also uses itself, both share one shuffle."""
    counts = counted.groupBy("lang", "lemma").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(totals, "lang").select("lang", "lemma", F.log10(F.lit(1e9) * F.col("n") / F.col("total")).alias("zipf"))


@R.query("TXT-03", f"WITH {TOKENS} SELECT doc_id, count(*) AS tokens, count(DISTINCT lemma) AS lemmas FROM tokens GROUP BY doc_id")
def token_counts(spark, sf_dir):
    return tokens(blocks(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("lemma").alias("lemmas"))


@R.query("TXT-04 UDF-01", f"WITH {TOKENS} SELECT lang, lemma, round(zipf, 6) AS zipf FROM zipf")
def word_frequency(spark, sf_dir):
    return zipf_table(tokens(blocks(spark, sf_dir)).withColumn("n", F.lit(1))).select("lang", "lemma", F.round("zipf", 6).alias("zipf"))


@R.query("TXT-07 TXT-05", f"""WITH {TOKENS}, l AS (SELECT doc_id, lang, lemma, count(*) AS n FROM tokens GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS lemmas, round_even(count(*) / sum(n), 6) AS ttr,
  CAST(coalesce(sum(n) FILTER (zipf >= 5), 0) AS BIGINT) AS very_common, CAST(coalesce(sum(n) FILTER (zipf >= 4 AND zipf < 5), 0) AS BIGINT) AS common,
  CAST(coalesce(sum(n) FILTER (zipf >= 3 AND zipf < 4), 0) AS BIGINT) AS uncommon, CAST(coalesce(sum(n) FILTER (zipf < 3), 0) AS BIGINT) AS rare
FROM l JOIN zipf USING (lang, lemma) GROUP BY doc_id""")
def lexical_profile(spark, sf_dir):
    """Tokens, distinct lemmas, their ratio, and tokens by frequency band. Words from 3 on the scale, which are a millionth of all words each
    and so less than a million a language, are sent to the documents' words; the others are rare."""
    n = by_document(tokens(blocks(spark, sf_dir, dealt=True)))
    known = zipf_table(tokens(blocks(spark, sf_dir)).withColumn("n", F.lit(1))).filter("zipf >= 3").select("lang", "lemma", T.band(F.col("zipf")).alias("band"))
    l = n.filter("lang is not null").join(F.broadcast(known), ["lang", "lemma"], "left").withColumn("band", F.coalesce("band", F.lit("rare")))  # noqa: E741
    return l.groupBy("doc_id").agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("lemmas"), F.bround(F.count(F.lit(1)) / F.sum("n"), 6).alias("ttr"),
        *[F.coalesce(F.sum(F.when(F.col("band") == b, F.col("n"))), F.lit(0)).alias(b) for b in ("very_common", "common", "uncommon", "rare")],
    )


@R.query("TXT-06 TXT-23 AGG-13", f"""WITH {TOKENS}, c AS (SELECT doc_id, lemma, word, count(*) AS n, min({{'pos': pos, 'i': i}}) AS first_at, regexp_matches(word, '^\\p{{Lu}}\\p{{Ll}}') AS cap FROM tokens WHERE i > 0 AND lang <> 'de' GROUP BY ALL),
s AS (SELECT doc_id, lemma, sum(n) FILTER (cap) AS caps, coalesce(sum(n) FILTER (NOT cap), 0) AS low, arg_max(word, (n, -first_at.pos, -first_at.i)) FILTER (cap) AS surface FROM c GROUP BY ALL)
SELECT doc_id, lemma, surface, CAST(caps AS BIGINT) AS caps FROM s WHERE caps > low""")
def proper_names(spark, sf_dir):
    """Words capitalised inside a block more often than not, in their most frequent spelling, the first seen of equals. German
    capitalises all nouns and is left out."""
    return named(tokens(blocks(spark, sf_dir, dealt=True)))


def named(t: DataFrame) -> DataFrame:
    """Proper names of tokens that are dealt out by document."""
    t = t.filter((F.col("i") > 0) & (F.col("lang") != "de"))
    # a place as one number: the least of structs would have every word sorted
    c = t.groupBy("doc_id", "lemma", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.shiftleft("pos", 32) + F.col("i")).alias("first_at")).withColumn("cap", F.col("word").rlike(r"^\p{Lu}\p{Ll}"))
    caps = F.sum(F.when(F.col("cap"), F.col("n")))
    s = c.groupBy("doc_id", "lemma").agg(caps.alias("caps"), F.coalesce(F.sum(F.when(~F.col("cap"), F.col("n"))), F.lit(0)).alias("low"), F.max_by(F.col("word"), F.when(F.col("cap"), F.struct("n", -F.col("first_at")))).alias("surface"))
    return s.filter("caps > low").select("doc_id", "lemma", "surface", "caps")


def names_among(b: DataFrame, asked: DataFrame, most: int = 256) -> DataFrame:
    """Proper names of blocks b, dealt by document, that are among asked(doc_id, lemmas), one row a document. Other words are dropped before they
    become rows. A list of more than ``most`` is too long to look through for each word: there all words of the edition are counted."""
    b = b.filter("lang <> 'de'").join(asked.hint("shuffle_hash"), "doc_id")
    placed = F.transform(T.words(F.col("text")), lambda w, i: F.struct(i.alias("i"), w.alias("word"), F.lower(w).alias("lemma")))
    b = b.select("doc_id", "lang", "pos", "lemmas", placed.alias("placed"))
    wanted = F.when(F.size("lemmas") > most, F.col("placed")).otherwise(F.filter("placed", lambda x: F.array_contains("lemmas", x["lemma"])))
    t = b.select("doc_id", "lang", "pos", F.inline_outer(wanted)).filter("word is not null")
    return named(t)


_USEFUL = TOKENS + """,
l AS (SELECT doc_id, lang, lemma, count(*) AS n, count(DISTINCT chapter) AS chapters, bool_or(lemma IN ('the', 'and', 'of', 'to', 'de', 'la', 'le', 'der', 'die', 'und', 'el', 'en', 'que', 'et') OR (i > 0 AND lang <> 'de' AND word <> lemma)) AS out FROM tokens GROUP BY ALL),
c AS (SELECT doc_id, max(chapter) AS chapters_all FROM blocks GROUP BY doc_id),
u AS (SELECT doc_id, lang, lemma, n, round(ln(1 + n) * (0.65 + 0.35 * chapters / chapters_all) * (6 - zipf), 6) AS score FROM l JOIN zipf USING (lang, lemma) JOIN c USING (doc_id) WHERE NOT out AND n >= 2 AND zipf >= 2.5 AND zipf < 5),
useful AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n DESC, lemma) AS place FROM u) WHERE place <= 50)"""


def useful(b: DataFrame, given: DataFrame, most: int = 50) -> DataFrame:
    """An edition's most useful words: frequent in it, not too common or rare in the language, spread over chapters. given: the blocks as
    they are read, for what needs no texts dealt by document, as b's are."""
    t = tokens(b)
    out = F.col("lemma").isin(*STOP) | ((F.col("i") > 0) & (F.col("lang") != "de") & (F.col("word") != F.col("lemma")))
    # by chapter first: a set of chapters would have every word sorted
    n = t.groupBy("doc_id", "lang", "lemma", "chapter").agg(F.count(F.lit(1)).alias("n"), F.max(out).alias("out"))
    n = n.groupBy("doc_id", "lang", "lemma").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("chapters"), F.max("out").alias("out"))
    c = given.groupBy("doc_id").agg(F.max("chapter").alias("chapters_all"))
    asked = zipf_table(tokens(given).withColumn("n", F.lit(1))).filter("zipf >= 2.5 and zipf < 5")
    u = n.filter("not out and n >= 2").join(asked, ["lang", "lemma"]).join(c, "doc_id")
    u = u.withColumn("score", F.round(F.log1p("n") * (0.65 + 0.35 * F.col("chapters") / F.col("chapters_all")) * (6 - F.col("zipf")), 6))
    return u.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("n"), "lemma"))).filter(F.col("place") <= most)


def useful_beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, dealt by document, plus useful: their edition's useful words as structs (lemma, score), 50 at most. Editions without any are left out."""
    b = blocks(spark, sf_dir, dealt=True)
    words = useful(b, blocks(spark, sf_dir)).groupBy("doc_id").agg(F.collect_list(F.struct("lemma", "score")).alias("useful"))
    return b.join(words.hint("shuffle_hash"), "doc_id")


@R.query("TXT-08 MTH-02 ORD-03", f"WITH {_USEFUL} SELECT doc_id, lemma, n, score, CAST(place AS INTEGER) AS place FROM useful")
def useful_words(spark, sf_dir):
    return useful(blocks(spark, sf_dir, dealt=True), blocks(spark, sf_dir)).select("doc_id", "lemma", "n", "score", "place")


@R.query("TXT-09", f"WITH {TOKENS} SELECT doc_id, lemma, pos, CAST(i AS INTEGER) AS i, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lemma ORDER BY pos, i) AS nth FROM tokens) WHERE nth <= 3")
def first_occurrences(spark, sf_dir):
    t = tokens(blocks(spark, sf_dir, dealt=True))
    n = F.row_number().over(W.partitionBy("doc_id", "lemma").orderBy("pos", "i"))
    return t.withColumn("nth", n).filter("nth <= 3").select("doc_id", "lemma", "pos", "i", "nth")


@R.query("TXT-10", f"WITH {_USEFUL}, f AS (SELECT doc_id, lemma, chapter, min((pos, i)) AS at FROM tokens GROUP BY ALL) SELECT u.doc_id, f.chapter, count(*) AS attested, bool_and(u.score > 0) AS ready FROM useful u JOIN f USING (doc_id, lemma) GROUP BY ALL")
def attested_vocabulary(spark, sf_dir):
    """Useful words that a chapter really holds."""
    b = useful_beside(spark, sf_dir)
    held = F.array_intersect(F.transform("useful", lambda u: u["lemma"]), F.transform(T.words(F.col("text")), F.lower))
    b = b.select("doc_id", "chapter", "useful", held.alias("held")).select("doc_id", "chapter", F.explode(F.filter("useful", lambda u: F.array_contains("held", u["lemma"]))).alias("u"))
    here = b.select("doc_id", "chapter", "u.lemma", "u.score").distinct()
    return here.groupBy("doc_id", "chapter").agg(F.count(F.lit(1)).alias("attested"), F.bool_and(F.col("score") > 0).alias("ready"))


def word_pairs(d: DataFrame, gap: str, short: int | None = None) -> DataFrame:
    """d(text, ...) -> ..., i, pair: pairs of whole words of two letters or more with that gap between them, as they stand, and the place
    of the first among a text's runs of letters and of others; pairs overlap. short: one of the two has at most so many letters.
    One walk of a pattern over the text finds every word and, where it starts a pair, that pair."""
    keys = [c for c in d.columns if c != "text"]
    pair = rf"\p{{L}}{{2,}}+{gap}\p{{L}}{{2,}}+"
    if short:
        pair = rf"(?:\p{{L}}{{2,{short}}}+{gap}\p{{L}}{{2,}}+|\p{{L}}{{2,}}+{gap}\p{{L}}{{2,{short}}}+(?!\p{{L}}))"
    found = F.regexp_extract_all("text", F.lit(rf"(?:(?<![\p{{N}}_])(?=({pair}(?![\p{{N}}_]))))?\p{{L}}++"), F.lit(1))
    first = F.when(F.col("text").rlike(r"^\p{L}"), 0).otherwise(1)
    # both are taken off the text before its words become rows, which so don't carry it; outer, or a filter of empty lists walks every text once more
    p = d.select(*keys, first.alias("first"), found.alias("found")).select(*keys, "first", F.posexplode_outer("found").alias("nth", "pair")).filter("pair <> ''")
    return p.select(*keys, (2 * F.col("nth") + F.col("first")).alias("i"), "pair")


@R.query("TXT-18 TXT-19", f"""WITH {TOKENS}, v AS (SELECT doc_id, lang, count(*) AS n, count(*) FILTER (lemma IN ('the', 'and', 'of', 'to', 'was')) AS en, count(*) FILTER (lemma IN ('le', 'la', 'de', 'et', 'des')) AS fr, count(*) FILTER (lemma IN ('der', 'die', 'und', 'das', 'ist')) AS de, count(*) FILTER (lemma IN ('el', 'los', 'que', 'y', 'del')) AS es, sum(length(word)) AS letters FROM tokens GROUP BY ALL)
SELECT doc_id, CASE WHEN greatest(en, fr, de, es) = 0 THEN NULL WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr' WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS voted,
 letters >= 100 AND greatest(en, fr, de, es) > 0 AND greatest(en, fr, de, es) * 5 >= (en + fr + de + es) * 4 AS sure FROM v""")
def stopword_language(spark, sf_dir):
    """The language whose commonest words a text holds most of, and whether the vote is sure enough to act on."""
    lists = {"en": ("the", "and", "of", "to", "was"), "fr": ("le", "la", "de", "et", "des"), "de": ("der", "die", "und", "das", "ist"), "es": ("el", "los", "que", "y", "del")}
    v = tokens(blocks(spark, sf_dir)).groupBy("doc_id").agg(F.sum(F.length("word")).alias("letters"), *[F.count_if(F.col("lemma").isin(*w)).alias(k) for k, w in lists.items()])
    top = F.greatest(*lists)
    total = sum((F.col(k) for k in lists), F.lit(0))
    voted = F.when(top == 0, None)
    for k in lists:
        voted = voted.when(F.col(k) == top, k)
    return v.select("doc_id", voted.alias("voted"), ((F.col("letters") >= 100) & (top > 0) & (top * 5 >= total * 4)).alias("sure"))


@R.query("AGG-35 FLT-11 FLT-12 TXT-24 TXT-25", f"""WITH {_USEFUL}, q AS (SELECT doc_id, lemma FROM useful),
h AS (SELECT q.doc_id, q.lemma, b.pos, strpos(b.text, q.lemma) AS place, b.text FROM q JOIN blocks b ON b.doc_id = q.doc_id AND contains(b.text, q.lemma))
SELECT doc_id, lemma, pos, CAST(place - 1 AS INTEGER) AS start, strpos(substr(text, place + 1), lemma) = 0 AS once, substr(text, place, length(lemma)) = lemma AS current FROM h""")
def citation_anchors(spark, sf_dir):
    """Where quotes stand in their edition's blocks, whether only once, and that the stored span still reads the same."""
    b = useful_beside(spark, sf_dir)
    h = b.select("doc_id", "pos", "text", F.explode(F.filter("useful", lambda u: F.contains("text", u["lemma"]))["lemma"]).alias("lemma")).withColumn("at", F.instr("text", F.col("lemma")))
    return h.select("doc_id", "lemma", "pos", (F.col("at") - 1).alias("start"), F.expr("locate(lemma, text, at + 1) = 0").alias("once"), (T.span(F.col("text"), F.col("at") - 1, F.col("at") - 1 + F.length("lemma")) == F.col("lemma")).alias("current"))
