"""Titles that count only the words they hold, and corrections that move sums of blocks instead of their texts."""

import random

from pyspark.sql import functions as F

from folioflow.operators import corrections, lexical, providers
from folioflow.operators.blocks import blocks


def shape(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_titles_drop_other_words_before_they_are_rows(spark, data):
    """every word of an edition was counted and sorted for the handful in its title."""
    plan = shape(providers.display_titles(spark, data))
    assert "array_contains(lemmas" in plan and "posexplode(regexp_extract_all" not in plan


def test_names_among_are_proper_names(spark, data):
    """Whether lists are looked through or all words are counted, names are those of all words; copies of an id are one edition."""
    twice = lambda dealt: blocks(spark, data, dealt).withColumn("doc_id", F.floor(F.col("doc_id") / 2))
    asked = twice(False).filter("pos < 2").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("lemma")).distinct()
    lists = asked.groupBy("doc_id").agg(F.collect_list("lemma").alias("lemmas"))
    want = {tuple(r) for r in lexical.named(lexical.tokens(twice(True))).join(asked, ["doc_id", "lemma"]).collect()}
    assert want
    for most in (0, 20, 10_000):
        got = lexical.names_among(twice(True).repartition("doc_id"), lists, most)
        mine = got.join(asked, ["doc_id", "lemma"]).collect()
        assert len(mine) == len(want) and {tuple(r) for r in mine} == want
    assert lexical.names_among(twice(True).repartition("doc_id"), lists, 10_000).count() == len(want) <= lexical.named(lexical.tokens(twice(True))).count()


def test_rounds_shuffle_sums_only(spark, data, monkeypatch):
    """each round shuffled and wrote all texts, and so did each measuring of levels."""
    plans, write = [], corrections.materialise
    monkeypatch.setattr(corrections, "materialise", lambda df, tag: plans.append(shape(df)) or write(df, tag))
    last = shape(corrections.correction_rounds(spark, data))
    assert plans and not any("Exchange" in p for p in plans)
    assert last.count("Exchange hashpartitioning") == 1 and "Join" not in last


def test_rounds_of_an_edition_without_an_id(spark, monkeypatch):
    """As the SQL groups them; joins by chapter lost them. Only blocks that changed are judged again."""
    b = spark.createDataFrame([(None, 1, 0, "## a ** b"), (None, 1, 1, "plain"), (4, 1, 0, ""), (4, 2, 0, "extraordinarily longerwords")], "doc_id long, chapter long, pos long, text string")
    monkeypatch.setattr(corrections, "blocks", lambda *_: b)
    got = sorted(map(tuple, corrections.correction_rounds(spark, "").collect()), key=str)
    assert got == sorted([(None, 1, 2, 2, 0, 0, "holds", 10), (4, 1, 0, 0, 0, 0, "holds", 0), (4, 2, 0, 0, 0, 2, "dropped", 13)], key=str)


def test_mend_agrees_with_verdicts(spark):
    rng = random.Random(8)
    rows = [(e, c, n, " ".join(rng.choice(["ab", "longerwords", "extraordinarily", "", "sixsix"]) for _ in range(rng.randint(0, 9)))) for e in range(9) for c in range(3) for n in range(3)]
    frame = spark.createDataFrame(rows, "edition int, chapter int, block int, text string")
    spot, whole = (lambda t: F.regexp_replace(t, "([^ ]{6})[^ ]{4,}", "$1")), (lambda t: F.regexp_replace(t, "([^ ]{6})[^ ]+", "$1"))
    m = corrections.mend(frame, 560, spot, whole).groupBy("edition", "chapter").agg(F.max("tries"), F.max("verdict"), F.max("level"), F.sum(F.length("text")))
    v = corrections.verdicts(frame, 560, spot, whole).select("edition", "chapter", "tries", "verdict", "level", "chars")
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, v.collect()))
