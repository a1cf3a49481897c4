"""Defects found without rows of all words or pairs being shuffled, and what they are where a language is missing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.operators import defects, lexical

SHAPE = "doc_id long, source string, lang string, pos long, chapter long, seq long, kind string, text string"


@pytest.fixture
def plans(monkeypatch):
    """The plan of each table that is written, by its tag."""
    seen, write = {}, defects.materialise

    def noted(df, tag):
        seen[tag] = shape(df)
        return write(df, tag)

    monkeypatch.setattr(defects, "materialise", noted)
    return seen


def shape(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keys_dealt(plan):
    """The keys of a plan's shuffles, without their numbers."""
    return {re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)}


def test_pairs_are_not_shuffled(spark, data, plans):
    """known words and short ones are sent to the pairs, whatever the session broadcasts by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert keys_dealt(shape(defects.split_words(spark, data))) == set()
        assert defects.attested_split_words(spark, data).count() and keys_dealt(plans["counted"]) == set()
        assert defects.broken_hyphens(spark, data).count() and keys_dealt(plans["hyphens"]) == set()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_editions_words_are_counted_where_it_lies(spark, data, plans):
    """texts are dealt out by document, their words are not."""
    assert defects.attested_split_words(spark, data).count()
    assert keys_dealt(plans["seen"]) == {"doc_id"}
    plans.clear()
    assert defects.detached_initials(spark, data).count()
    assert keys_dealt(plans["seen"]) == {"doc_id"}


def test_tables_too_large_to_send_give_the_same(spark, data, monkeypatch):
    names = ("split_words", "attested_split_words", "broken_hyphens", "detached_initials")
    few = {n: sorted(map(tuple, getattr(defects, n)(spark, data).collect())) for n in names}
    monkeypatch.setattr(defects, "SENT", -1)
    monkeypatch.setattr(defects.sent, "__defaults__", (-1,))
    monkeypatch.setattr(defects, "SENT_NUMBERS", -1)
    assert {n: sorted(map(tuple, getattr(defects, n)(spark, data).collect())) for n in names} == few


def test_initials_without_a_language(spark, monkeypatch):
    """a name that its edition spells twice needs no frequencies, so no language either, as in the SQL."""
    texts = ["Q uorvath came", "then Quorvath and Quorvath", "A lone one", "I lone one"]
    b = spark.createDataFrame([(7, "s", None, i, 1, 1, "paragraph", t) for i, t in enumerate(texts)], SHAPE)
    monkeypatch.setattr(defects, "blocks", lambda *_: b)
    monkeypatch.setattr(defects, "worn", lambda given: given)
    assert [tuple(r) for r in defects.detached_initials(spark, "").collect()] == [(7, 0, "Quorvath", 0.98)]


def test_word_pairs_are_those_of_plain_cuts(spark):
    rng = random.Random(5)
    texts = ["", "a", "ab", " ab cd", "1ab cd", "ab cd_", "ab \n", *["".join(rng.choice(["ab", "c", "d", "é", "  ", " ", "- ", "-", "_", "7", ".", "\t", "\n", "xyzw"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]]
    d = spark.createDataFrame(list(enumerate([*texts, None])), "k int, text string")
    for gap, short in ((r"[ \t]+", 3), (r"[ \t]+", None), (r"-[ \t\r\n]+", None)):
        want = set()
        for k, t in enumerate(texts):
            cut = re.findall(r"[^\W\d_]+|[\W\d_]+", t)
            for i in range(len(cut) - 2):
                left, between, right = cut[i : i + 3]
                outside = (cut[i - 1][-1] if i else "") + (cut[i + 3][0] if i + 3 < len(cut) else "")
                if re.fullmatch(r"[^\W\d_]{2,}", left) and re.fullmatch(gap, between) and len(right) >= 2 and not re.search(r"[\d_]", outside) and (not short or min(len(left), len(right)) <= short):
                    want.add((k, i, left + between + right))
        got = [(r["k"], r["i"], r["pair"]) for r in lexical.word_pairs(d, gap, short).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_counts_over_copies_and_nulls(spark):
    """Repeated questions and rows without text or document count as they should."""
    w = spark.createDataFrame([(1, "Ab ab cd"), (1, "AB"), (2, None), (None, "ab"), (3, "ab")], "doc_id long, text string")
    found = spark.createDataFrame([(1, "ab", "zz"), (1, "ab", "cd"), (2, "ab", "ab"), (None, "ab", "ab")], "doc_id long, l string, r string")
    got = sorted((r["doc_id"] or 0, r["l"], r["r"], r["nl"], r["nr"]) for r in defects.asked_counts(w, found, {"nl": "l", "nr": "r"}).collect())
    assert got == [(0, "ab", "ab", 0, 0), (1, "ab", "cd", 3, 1), (1, "ab", "zz", 3, 0), (2, "ab", "ab", 0, 0)]
    exact = defects.asked_counts(w, found.filter("doc_id = 1").limit(1), {"nl": "l"}, exact=True).select(F.col("nl")).collect()
    assert [r["nl"] for r in exact] == [1]
