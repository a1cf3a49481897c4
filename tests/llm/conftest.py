import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, target string, taken long, hub long"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls everywhere, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    import random

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    shared = "This Line is long enough to be counted as a repeated one"
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        text = " ".join(base)
        if i % 3 == 0:
            text = f"  {shared.upper() if i % 2 else shared} \n{text}\nshort"
        rows.append((i, text, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(text)))
    near = rows[10][1].split() + words[:150]
    rows.append((100, " ".join(near), "en", "a", 0))
    rows.append((101, " ".join(near[:-1] + ["changed"]), "en", "a", 0))
    rows.append((102, " ".join(near).upper(), "de", "b", 0))
    rows += [(103, None, None, None, None), (104, "", "en", "a", 0), (105, " \n\t ", "en", None, 3), (None, "a null id " + shared, "en", "a", 5), (None, None, None, None, None)]
    rows += [rows[5], rows[5], (106, "12 34 !!", "en", "z", 8), (107, "日本語 テキスト", "ja", "Z", 8), (108, "x" * 200_000, "de", "ä", 1), (109, "one two", "en", "a", 7)]
    rows.append((110, "word " * 30_000, "en", "b", 150_000))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    rows = [(*r, 0.5, 7, "t", 1, 2) for r in corpus]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('none')}/documents.parquet"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
