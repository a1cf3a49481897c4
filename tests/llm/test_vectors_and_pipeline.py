"""Neighbours against all inner products; the pipeline against a plain version; the entry's names."""

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import ann


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.standard_normal(16)], i % 3, 0.0) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 0, 0.0) for i in range(60)]  # copies
    rows += [(i, rows[i][1], 0, 0.0) for i in (20, 40)]  # repeated rows
    rows += [(2000, None, 0, 0.0), (2020, [0.0] * 16, 0, 0.0), (2040, [float("nan")] * 16, 0, 0.0), (2060, [None] + [1.0] * 15, 0, 0.0), (None, [1.0] * 16, 0, 0.0), (2080, [], 0, 0.0), (2100, [float("inf")] * 16, 0, 0.0)]
    rows += [(3000 + 20 * i, [float(v) for v in rng.standard_normal(3)], 0, 0.0) for i in range(5)]
    path = f"file://{tmp_path_factory.mktemp('v')}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_neighbours_are_exact_enough(spark, vectors):
    got = {}
    for r in ann.search(vectors, block=100, probe=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"]]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    asked = {i: v for i, v in rows if i % 20 == 0}
    assert set(got) == set(asked)
    hits = total = 0
    for i, q in asked.items():
        want = sorted((-float((q * v).sum()), j) for j, v in rows if len(v) == len(q) and j != i)[:20]
        mine = sorted(got[i])
        assert len(mine) == len(want) and [r for r, *_ in mine] == list(range(1, len(want) + 1))  # repeated query rows are answered once
        assert all(abs(s - float((q * dict(rows)[j]).sum())) < 1e-12 for _, j, s in mine)
        hits += len({j for _, j, _ in mine} & {j for _, j in want})
        total += len({j for _, j in want})
    assert hits / total >= 0.99


def test_neighbours_of_many_dimensions(spark):
    """More dimensions than have centres, a query id on unlike vectors, and a grid of more than one group."""
    rng = np.random.default_rng(2)
    rows = [(20 * d + i, [float(v) for v in rng.standard_normal(d)]) for d in range(1, 101) for i in range(6)]
    rows += [(2000, [9.0] * 40), (2000, [-3.0] * 40)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, block=2).collect()
    asked = {i: v for i, v in reversed(sorted(rows)) if i % 20 == 0}
    assert len(got) == 3 * len(asked)
    for i, q in asked.items():
        want = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in rows if len(v) == len(q) and j != i)[:3]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == i)
        assert [j for _, j in mine] == [j for _, j in want]


def test_neighbours_empty(vectors):
    assert ann.search(vectors.limit(0)).count() == 0


def test_code_bounds_hold():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    centre, turn = x.mean(0), ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    bits, far, f = ann.encode(x, centre, turn)
    code = (np.unpackbits(bits, axis=1).astype(float) * 2 - 1) / 8
    guess = (q @ centre)[:, None] + (q @ turn) @ code.T * far / f
    error = np.abs(guess - q @ x.T)
    one = np.linalg.norm(q, axis=1)[:, None] * far * np.sqrt((1 - f**2) / f**2 / 63)
    for eps, share in ((ann.EPS, 0.9), (3.0, 0.99)):
        assert (error <= eps * one).mean() > share


def test_pipeline_stages(spark, docs, corpus, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    now, frames = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        now = stage(spark, now, f"file://{tmp_path}")
        now.write.parquet(f"file://{tmp_path}/{name}")
        now = spark.read.parquet(f"file://{tmp_path}/{name}")
        frames.append(now)
    assert all(f.columns == docs.columns for f in frames[:-1])
    known, lines, near, mixed, packed = frames
    assert {103, 104, 105, 106}.isdisjoint(r["doc_id"] for r in known.collect())
    assert lines.count() == known.count()
    assert near.filter("doc_id in (101, 102)").count() == 0 and near.filter("doc_id = 100").count() == 1
    # every token of the mixture is in some piece, once
    from tokenizers import Tokenizer

    from folioflow.llm import packing

    tok = Tokenizer.from_file(packing.default_vocabulary())
    want = sum(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert packed.agg({"length": "sum"}).first()[0] == want
    again = P.run(spark, f"file://{tmp_path}")
    assert again.agg({"length": "sum"}).first()[0] == want


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(entry.oracle_sql()) <= names


def test_batches_are_bounded_in_bytes(spark):
    """Python sees about BATCH_BYTES at once, and one row where that is larger; a session's own bound stays."""
    from folioflow.llm import common

    def sizes():
        return lambda batches: (pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches)

    wide = spark.range(0, 300, 1, 1).selectExpr("repeat('x', 100000) AS text")
    counted = sorted(r["n"] for r in common.materialise(common.map_arrow(wide, "n long", sizes), "sizes").collect())
    assert sum(counted) == 300 and max(counted) * 100_000 <= 1.2 * common.BATCH_BYTES
    longest = spark.range(0, 2, 1, 1).selectExpr("repeat('x', 9000000) AS text")
    assert [r["n"] for r in common.map_arrow(longest, "n long", sizes).collect()] == [1, 1]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "77777")
    common.bound_batches(spark)
    assert spark.conf.get(key) == "77777"
    spark.conf.set(key, before)


CLASHES = ["__lang_pred", "__score", "__read", "__key", "__id", "__lost", "__kept", "__gone", "__doc", "lang_pred", "score", "read", "key", "known", "lost", "kept_text", "gone", "row", "size", "digest", "slot", "length", "taken", "at", "before", "more"]


def test_stages_take_any_column_names(spark, docs, corpus):
    import corpus_pipeline as P

    given = spark.createDataFrame([(*r, *range(len(CLASHES))) for r in corpus], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES))
    for name, stage in P.STAGES:
        out = stage(spark, given, "")
        if name != "packing":
            assert out.columns == given.columns, name
        assert out.count() > 0, name


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline as P

    empty.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0


def test_pipeline_against_plain_version(spark, tmp_path):
    """Rows of known fate through all stages: rejected, lines dropped, copies gone, mixed within one of the targets, every token packed once."""
    import random
    import re
    from collections import Counter, defaultdict

    import corpus_pipeline as P
    from tokenizers import Tokenizer

    from folioflow.llm import packing

    rng = random.Random(5)
    pools = {"aa": "abcdefg", "bb": "nopqrst"}
    words = {k: ["".join(rng.choices(v, k=rng.randint(3, 7))) for _ in range(200)] for k, v in pools.items()}
    line = {k: " ".join(v[:12]) for k, v in words.items()}
    rows = []
    for i in range(240):
        lang = ("aa", "bb")[i % 2]
        text = " ".join(rng.choices(words[lang], k=rng.randint(30, 80)))
        rows.append((i, f"{line[lang]}\n{text}" if i % 3 == 0 else text, lang, ("s", "t", None)[i % 5 % 3], 0))
    for i in range(0, 40):  # copies but for the line
        rows.append((1000 + i, rows[i][1].split("\n")[-1], *rows[i][2:]))
    rows += [(2000, "12 34", "aa", "s", 0), (2001, None, "aa", "s", 0), (2002, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    now, at = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, now, "").write.parquet(f"file://{tmp_path}/{name}")
        now = spark.read.parquet(f"file://{tmp_path}/{name}")
        at[name] = now.collect()
    want = {i: (text, source) for i, text, _, source, _ in rows if i < 2000}
    assert {r["doc_id"] for r in at["language_id"]} == set(want)
    held = {k: max(i for i, (t, _) in want.items() if t.startswith(v + "\n")) for k, v in line.items()}
    for i, (text, source) in want.items():
        head, _, tail = text.partition("\n")
        if head in line.values() and i not in held.values():
            want[i] = tail, source
    assert {r["doc_id"]: r["text"] for r in at["line_dedup"]} == {i: t for i, (t, _) in want.items()}
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    sets = {i: shingles(t) for i, (t, _) in want.items()}
    for i in range(40):
        a, b = sets[i], sets[1000 + i]
        if 100 * len(a & b) >= 80 * len(a | b):
            del want[1000 + i]
    assert {r["doc_id"] for r in at["near_dedup"]} == set(want)
    sizes, taken, cut = defaultdict(int), defaultdict(int), Counter()
    for i, (text, source) in want.items():
        sizes[source] += len(text.split())
    for r in at["mixing"]:
        taken[r["source"]] += len(r["text"].split())
        cut[r["doc_id"]] += 1
        text = want[r["doc_id"]][0]
        assert r["text"] == text or re.fullmatch(re.escape(r["text"]) + r"\s.*", text, re.S)
    target, budget = {}, 1.5 * sum(sizes.values())
    weight = {"s": 5, "t": 2, None: 1}
    while len(target) < 3:
        left, free = budget - sum(target.values()), [s for s in weight if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2.0 * sizes[s] for s in free if share[s] >= 2 * sizes[s]}
        target |= over or share
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and max(cut.values()) <= 2
    tokens = Tokenizer.from_file(packing.default_vocabulary())
    ids = Counter()
    for r in at["mixing"]:
        ids[r["doc_id"]] += len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1
    got, windows = Counter(), defaultdict(list)
    for r in at["packing"]:
        got[r["doc_id"]] += r["length"]
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == ids
    for pieces in windows.values():
        upto = 0
        for offset, length in sorted(pieces):
            assert offset == upto
            upto += length
        assert upto <= 1024
