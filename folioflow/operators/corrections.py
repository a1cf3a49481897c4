"""Corrections of a made edition in bounded rounds: judge, apply what two judges agree on, judge what changed again; then bring chapters down to a level.

The loop over rounds is the driver's; each round is a Spark job over the blocks that the last one changed, and they are written, so
no plan grows with the rounds and a lost executor costs one round at most. What comes to the driver is one count a round. Texts are neither
shuffled nor written for the chapters' sake: sums of their blocks settle levels and verdicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import materialise
from .blocks import BLOCKS, blocks

R = Registry()

ROUNDS = 5
#: A judge: a text -> the first span that it would take out, as struct(start, old), start from 1; null where it finds none.
Judge = Callable[[Column], Column]
CHAPTER = ["edition", "chapter"]


def first_match(pattern: str) -> Judge:
    def judge(text: Column) -> Column:
        found = F.regexp_extract(text, pattern, 0)
        return F.when(found != "", F.struct(F.instr(text, found).alias("start"), found.alias("old")))

    return judge


def take_out(text: Column, span: Column) -> Column:
    """The text without the span, if it still stands there."""
    stands = F.substring(text, span["start"], F.length(span["old"])) == span["old"]
    return F.when(stands, F.concat(F.substring(text, F.lit(1), span["start"] - 1), F.substring(text, span["start"] + F.length(span["old"]), F.length(text)))).otherwise(text)


def corrected(text_blocks: DataFrame, judges: tuple[Judge, Judge], rounds: int = ROUNDS) -> DataFrame:
    """text_blocks(edition, chapter, block, text) -> plus applied (corrections written in) and left (agreed ones after the last round).

    In a round each open block has the first span that both judges name taken out. A block that the judges name nothing in stays as it is,
    since what they say depends on its text alone, and is not judged again; after ``rounds`` rounds none is.
    """
    a, b = (j(F.col("text")) for j in judges)
    backed = F.when(a.eqNullSafe(b), a)
    judged = text_blocks.withColumn("applied", F.lit(0)).withColumn("backed", backed)
    settled = judged.filter("backed is null").drop("backed").withColumn("left", F.lit(0))
    for _ in range(rounds):
        hit = materialise(judged.filter("backed is not null"), "corrections")
        if hit.isEmpty():
            return settled
        changed = hit.withColumn("text", take_out(F.col("text"), F.col("backed"))).withColumn("applied", F.col("applied") + 1)
        judged = materialise(changed.withColumn("backed", backed), "corrections")
        settled = settled.unionByName(judged.filter("backed is null").drop("backed").withColumn("left", F.lit(0)))
    return settled.unionByName(judged.filter("backed is not null").drop("backed").withColumn("left", F.lit(1)))


def settle(text_blocks: DataFrame, judges: tuple[Judge, Judge], rounds: int = ROUNDS) -> DataFrame:
    """corrected, plus rounds: how many changed the chapter, which is the most that any of its blocks had."""
    done = corrected(text_blocks, judges, rounds)
    most = done.groupBy(*CHAPTER).agg(F.max("applied").alias("rounds"))
    return done.join(most, CHAPTER).select(*text_blocks.columns, "applied", "rounds", "left")


def word_length(chars: Column, words: Column) -> Column:
    """Letters a word, in hundredths: what stands for a chapter's level here."""
    return F.floor(100 * chars / F.greatest(words, F.lit(1)))


def letters_of(text: Column) -> Column:
    """All but the blanks between words."""
    return F.length(F.replace(text, F.lit(" "), F.lit("")))


def words_of(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - letters_of(text) + 1)


def rewritten(text_blocks: DataFrame, target: int, spot: Callable[[Column], Column], whole: Callable[[Column], Column]) -> DataFrame:
    """plus text1, the block after its chapter's first try, and text2, after the second, whether the chapter needs them or not."""
    own = word_length(letters_of(F.col("text")), words_of(F.col("text")))
    first = text_blocks.withColumn("text1", F.when(own > target, spot(F.col("text"))).otherwise(F.col("text")))
    return first.withColumn("text2", whole(F.col("text1")))


def verdicts(text_blocks: DataFrame, target: int, spot: Callable[[Column], Column], whole: Callable[[Column], Column], *more: Column) -> DataFrame:
    """(edition, chapter, level, tries, verdict, chars, ...): what becomes of chapters. A chapter above the target has its paragraphs above it
    rewritten once, then, if it still is, all of it once. The three forms of a block are measured together, so that only sums travel."""
    texts = ("text", "text1", "text2")
    sums = [F.sum(f(F.col(t))).alias(f"{k}{i}") for i, t in enumerate(texts) for k, f in (("c", letters_of), ("w", words_of), ("n", F.length))]
    s = rewritten(text_blocks, target, spot, whole).groupBy(*CHAPTER).agg(*sums, *more)
    level = [word_length(F.col(f"c{i}"), F.col(f"w{i}")) for i in range(3)]
    s = s.withColumn("tries", F.when((level[0] > target) & (level[1] > target), 2).when(level[0] > target, 1).otherwise(0))
    last = lambda of: F.when(F.col("tries") == 0, of[0]).when(F.col("tries") == 1, of[1]).otherwise(of[2])
    s = s.withColumn("level", last(level)).withColumn("chars", last([F.col(f"n{i}") for i in range(3)]))
    s = s.withColumn("verdict", F.when(F.col("level") > target, "dropped").when(F.col("tries") > 0, "mended").otherwise("holds"))
    return s.drop(*[f"{k}{i}" for k in "cwn" for i in range(3)])


def mend(text_blocks: DataFrame, target: int, spot: Callable[[Column], Column], whole: Callable[[Column], Column]) -> DataFrame:
    """text_blocks with their chapters' texts after the tries, plus tries (of paragraphs, chapter), own (a block's level), level (its chapter's) and verdict."""
    v = verdicts(text_blocks, target, spot, whole).drop("chars")
    text = F.when(F.col("tries") == 2, F.col("text2")).when(F.col("tries") == 1, F.col("text1")).otherwise(F.col("text"))
    m = rewritten(text_blocks, target, spot, whole).join(v, CHAPTER).withColumn("text", text)
    return m.select(*text_blocks.columns, "tries", word_length(letters_of(F.col("text")), words_of(F.col("text"))).alias("own"), "level", "verdict")


AGREE, ALSO = "[%#*@]{2,}", "[#*@]{2,}|%{3}"
TARGET = 560


def _sql() -> str:
    rounds = [f"WITH {BLOCKS}, r0 AS (SELECT doc_id AS edition, chapter, pos AS block, text, 0 AS applied FROM blocks)"]
    hit = f"regexp_extract(text, '{AGREE}') <> '' AND regexp_extract(text, '{AGREE}') = regexp_extract(text, '{ALSO}')"
    at = f"strpos(text, regexp_extract(text, '{AGREE}'))"
    for n in range(ROUNDS):
        rounds.append(f"r{n + 1} AS (SELECT edition, chapter, block, CASE WHEN {hit} THEN left(text, {at} - 1) || substr(text, {at} + length(regexp_extract(text, '{AGREE}'))) ELSE text END AS text, applied + ({hit})::INT AS applied FROM r{n})")
    rounds.append(f"s AS (SELECT *, ({hit})::INT AS rest, max(applied) OVER (PARTITION BY edition, chapter) AS rounds FROM r{ROUNDS})")
    level = "sum(length(text) - greatest(w - 1, 0)) {0} * 100 // greatest(sum(w) {0}, 1)"
    count = "CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS w"
    chapter = "OVER (PARTITION BY edition, chapter)"
    both = f"(length(text) - greatest(w - 1, 0)) * 100 // greatest(w, 1) AS own, {level.format(chapter)} AS level"
    rounds.append(f"m1 AS (SELECT *, {both} FROM (SELECT *, {count} FROM s))")
    rounds.append(f"t1 AS (SELECT * EXCLUDE (w, own, level) REPLACE (CASE WHEN level > {TARGET} AND own > {TARGET} THEN regexp_replace(text, '([^ ]{{6}})[^ ]{{4,}}', '\\1', 'g') ELSE text END AS text), (level > {TARGET})::INT AS tries FROM m1)")
    rounds.append(f"m2 AS (SELECT *, {both} FROM (SELECT *, {count} FROM t1))")
    rounds.append(f"t2 AS (SELECT * EXCLUDE (w, own, level) REPLACE (CASE WHEN level > {TARGET} THEN regexp_replace(text, '([^ ]{{6}})[^ ]+', '\\1', 'g') ELSE text END AS text, CASE WHEN level > {TARGET} THEN 2 ELSE tries END AS tries) FROM m2)")
    rounds.append(f"m3 AS (SELECT *, {both} FROM (SELECT *, {count} FROM t2))")
    verdict = f"CASE WHEN max(level) > {TARGET} THEN 'dropped' WHEN max(tries) > 0 THEN 'mended' ELSE 'holds' END"
    return ", ".join(rounds) + f" SELECT edition, chapter, max(rounds)::INT AS rounds, sum(applied) AS applied, sum(rest) AS left_over, max(tries) AS tries, {verdict} AS verdict, sum(length(text))::BIGINT AS chars FROM m3 GROUP BY edition, chapter"


@R.query("MUT-13 LVL-08", _sql())
def correction_rounds(spark, sf_dir):
    """Chapters after their corrections: rounds, what was written in and what was left, tries to bring them to the level, and the verdict."""
    b = blocks(spark, sf_dir).select(F.col("doc_id").alias("edition"), "chapter", F.col("pos").alias("block"), "text")
    done = corrected(b, (first_match(AGREE), first_match(ALSO)))
    spot, whole = (lambda t: F.regexp_replace(t, "([^ ]{6})[^ ]{4,}", "$1")), (lambda t: F.regexp_replace(t, "([^ ]{6})[^ ]+", "$1"))
    more = F.max("applied").alias("rounds"), F.sum("applied").alias("applied"), F.sum("left").alias("left_over")
    return verdicts(done, TARGET, spot, whole, *more).select(*CHAPTER, "rounds", "applied", "left_over", "tries", "verdict", "chars")
