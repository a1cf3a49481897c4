"""Matching of cuts, quotes found again, roles of chapters, and planted defects, against plain versions and known cases."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.functions import editing
from folioflow.operators import defects, matching, roles


def plain_match(stored, fresh):
    used, cursor, out = set(), 0, []
    for item in stored:
        free = [p for p, x in enumerate(fresh) if x == item and p not in used]
        at = next((p for p in free if p >= cursor), free[0] if free else None)
        out.append(at)
        if at is not None:
            used.add(at)
            cursor = at + 1
    return out


def test_first_unused_against_plain_walk():
    rng = random.Random(2)
    for _ in range(3000):
        stored = [rng.choice("abcd") for _ in range(rng.randint(0, 15))]
        fresh = stored[:]
        for _ in range(rng.randint(0, 8)):
            rng.shuffle(fresh) if rng.random() < 0.2 else fresh.insert(rng.randint(0, len(fresh)), rng.choice("abcde")) if rng.random() < 0.5 or not fresh else fresh.pop(rng.randrange(len(fresh)))
        assert matching.first_unused(stored, fresh) == plain_match(stored, fresh)
    assert matching.first_unused(["x"] * 200_000, ["x"] * 200_000) == list(range(200_000))


def test_nearest_unused_of_books(spark):
    rng = random.Random(5)
    stored, fresh = [], []
    for book in (1, 2, 3, None):
        texts = [rng.choice(["one", "two", "three", "", None, f"t{rng.random()}"]) for _ in range(40)]
        stored += [(book, p, t) for p, t in enumerate(texts)]
        kept = [t for t in texts if rng.random() < 0.8] + ["new"]
        rng.shuffle(kept)
        fresh += [(book, p * 10, t) for p, t in enumerate(kept)]
    stored.append((7, 0, "only stored"))
    fresh.append((8, 0, "only fresh"))
    schema = "book int, pos int, text string"
    got = defaultdict(list)
    for r in matching.nearest_unused(spark.createDataFrame(stored, schema).repartition(3), spark.createDataFrame(fresh, schema), "book").collect():
        got[r["book"]].append((r["was"], r["now"], r["backwards"]))
    for book in (1, 2, 3, None, 7, 8):
        a, b = [(p, t) for k, p, t in stored if k == book and t], [(p, t) for k, p, t in fresh if k == book and t]
        found = plain_match([t for _, t in a], [t for _, t in b])
        want, last = [], -1
        for (p, _), at in zip(a, found, strict=True):
            want.append((p, None if at is None else b[at][0], at is not None and at < last))
            last = last if at is None else at
        want += [(None, p, False) for at, (p, _) in enumerate(b) if at not in found]
        assert sorted(got[book], key=str) == sorted(want, key=str)


CASES = [
    ("The cat", "the c at", (0, 8 - 1)), ("The cat sat", "cat", (4, 7)), ("a  b\nc d", "B c", (3, 6)), ("abc", "", None), ("abc", "  ", None), ("abc", "d", None), ("", "a", None),
    ("Straße frei", "STRAße FREI", (0, 11)), ("x a b c", "abc", (2, 7)), ("aab aB", "a b", (1, 3)), ("“Oh,” he said", "oh,” he", (1, 8)),
]


@pytest.mark.parametrize("text,quote,want", CASES)
def test_locate(spark, text, quote, want):
    assert editing.locate(text, quote) == want
    r = spark.createDataFrame([(text, quote)], "t string, q string").select(matching.locate(F.col("t"), F.col("q")).alias("s")).first()["s"]
    assert (tuple(r) if r else None) == want


def test_locate_of_nulls_and_marks(spark):
    assert spark.createDataFrame([(None, "a"), ("a", None)], "t string, q string").select(matching.locate(F.col("t"), F.col("q")).alias("s")).filter("s is not null").count() == 0
    assert editing.locate("He said: ‘go’ now", "said go") == (3, 12) and editing.locate("The cat", "the c at") == (0, 7)


# ---- roles


@pytest.mark.parametrize("title,numbered,matter,story", [
    ("Chapter 3", True, False, True), ("IV. Notes", True, False, True), ("I Introduction", True, False, True), ("Civil War", False, False, True), ("DIM", False, False, True), ("Preface", False, True, False),
    ("Передмова", False, True, False), ("ÍNDICE", False, True, False), ("The End", False, True, False), ("La fin du monde", False, False, True), ("", False, False, False), ("  ", False, False, False),
    ("12", True, False, True), ("— xii —", True, False, True), ("Introductory remarks", False, True, False), ("Notebook", False, False, True), ("FIN.", False, True, False), ("About the Author", False, True, False),
])
def test_titles(spark, title, numbered, matter, story):
    t = F.col("t")
    r = spark.createDataFrame([(title,)], "t string").select(roles.is_numbered(t), roles.is_matter(t), roles.is_story(t)).first()
    assert tuple(r) == (numbered, matter, story)


BOOKS = {
    "title page, preface, numbered": (["Dracula", "", "Preface", "Chapter I", "Chapter II", "", "Notes", "THE END"], "Dracula", None, set(), "front front front body body body back back"),
    "no numbers": (["Foreword", "The Storm", "", "The Calm", "Appendix"], "X", None, set(), "front body body body back"),
    "all matter": (["Preface", "Notes"], "X", None, set(), "body body"),
    "nothing titled": (["", "", ""], "X", None, set(), "body body body"),
    "mixed without a story": (["Vorwort", "", "", "Anhang"], "X", None, set(), "front body body back"),
    "cut by size": (["Preface", "", "", "Notes"], "X", None, {1, 2}, "front body body back"),
    "size cut before the first number": (["A", "", "Chapter 2"], "X", None, {1}, "front body body"),
    "author's page": (["Jane Doe", "Jane Doe and I", "End of Days"], "X", "Jane Doe", set(), "front front body"),
    "contents inside": (["The Sea", "Contents", "Chapter 1", "Contents", "Chapter 2", "Illustrations", "Chapter 3"], "X", None, set(), "front front body front body back body"),
    "untitled at the end": (["Chapter 1", "Notes", ""], "X", None, set(), "body back body"),
}


def test_roles_of_books(spark):
    rows = [(n, i + 10, t or None, book, author, i in sized) for n, (titles, book, author, sized, _) in enumerate(BOOKS.values()) for i, t in enumerate(titles)]
    frame = spark.createDataFrame(rows, "book int, chapter int, title string, book_title string, author string, by_size boolean").repartition(3)
    got = defaultdict(dict)
    for r in roles.title_roles_of(frame).collect():
        got[r["book"]][r["chapter"]] = r["role"]
    for n, (name, case) in enumerate(BOOKS.items()):
        assert " ".join(got[n][k] for k in sorted(got[n])) == case[4], name
    assert roles.title_roles_of(frame.limit(0)).count() == 0


# ---- defects


def test_asked_frequencies_are_those_of_all_words(spark):
    rng = random.Random(1)
    texts = [(i, "en" if i % 2 else "fr", i, " ".join(rng.choice(["Ab", "cd", "ef", "gh-ij"]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    b = spark.createDataFrame(texts, "doc_id int, lang string, pos int, text string")
    import math
    import re

    words = {lang: [[w.lower() for w in re.findall(r"[^\W\d_]+", t)] for _, la, _, t in texts if la == lang] for lang in ("en", "fr")}
    found = spark.createDataFrame([("en", "ab", "cd"), ("fr", "gh", "ij"), ("en", "never", "ab")], "lang string, l string, r string")
    got = {(r["lang"], r["l"], r["r"]): (r["zl"], r["zp"]) for r in defects.asked_frequencies(b, found, {"zl": ("l",), "zp": ("l", "r")}).collect()}
    for (lang, left, right), (zl, zp) in got.items():
        total = sum(map(len, words[lang]))
        one = sum(w.count(left) for w in words[lang])
        two = sum((w[i], w[i + 1]) == (left, right) for w in words[lang] for i in range(len(w) - 1))
        assert zl == pytest.approx(math.log10(1e9 * one / total) if one else 0) and zp == pytest.approx(math.log10(1e9 * two / total) if two else 0)
    counted = defects.asked_counts(b, found.withColumn("doc_id", F.lit(1)), {"n": "l"}).collect()
    mine = Counter(w.lower() for w in re.findall(r"[^\W\d_]+", texts[1][3]))
    assert all(r["n"] == mine[r["l"]] for r in counted)


def test_planted_defects_are_found(spark, data):
    from folioflow.plans import catalogue

    for name in ("split_words", "attested_split_words", "broken_hyphens", "detached_initials"):
        assert not catalogue.QUERIES[name](spark, data).isEmpty(), name
