"""Operators on documents against brute-force versions, over rows with every oddity of the fixture."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflow.llm import lang_id, line_dedup, lm_score, mixing, near_dedup, packing, search, token_count, toxicity


def words(text):
    return (text or "").encode().lower().split()


def test_language_id_learns_and_rejects(spark, docs, corpus):
    model = lang_id.fit(docs, lang_id.held_out())
    got = lang_id.predict(docs, model, ["doc_id"]).collect()
    assert len(got) == len(corpus)
    by = {r["doc_id"]: r for r in got}
    for i in (103, 104, 105, 106):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert set(model.classes) <= {"en", "de", "ja"}
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = lang_id.keep_known(docs, least=0.0)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id = 106 or doc_id = 103").count() == 0


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit(docs, lang_id.held_out())
    got = lang_id.predict(docs.filter(lang_id.held_out()), model, ["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert (model.weights == 0).mean() > 0.3  # the l1 penalty leaves gaps


def test_language_id_without_labels(empty):
    model = lang_id.fit(empty, lang_id.held_out())
    assert model.classes == [] and lang_id.predict(empty, model, ["doc_id"]).count() == 0
    assert model.predict(None) == ("und", 0.0)


def test_language_id_learns_every_language(spark):
    """Seventy languages of unlike sizes, each with letters of its own."""
    rows = []
    for n in range(70):
        letters = [chr(0x4E00 + 40 * n + i) for i in range(40)]
        rows += [(1000 * n + j, " ".join(letters[(j + i) % 40] * 2 for i in range(30)), f"l{n:02}") for j in range(300 if n < 2 else 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs, lang_id.held_out(), max_rows=200)
    assert len(model.classes) == 70
    got = lang_id.predict(docs, model, ["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95


def test_language_id_sample_is_even_and_bounded(spark):
    rows = [(i, f"abc {i}", "big") for i in range(3000)] + [(9000 + i, f"xyz {i}", "small") for i in range(40)] + [(7, "same id, other text", "big")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    original = lang_id.train

    def spy(sample, *rest, **options):
        seen.extend(lang for lang, _, _ in sample)
        return original(sample, *rest, **options)

    lang_id.train, before = spy, lang_id.train
    try:
        lang_id.fit(docs, lang_id.F.lit(False), max_rows=100)
    finally:
        lang_id.train = before
    assert seen.count("small") == 40 and 45 <= seen.count("big") <= 100


def test_language_id_sample_keeps_rare_languages_beside_repeated_rows(spark, monkeypatch):
    rows = [(10_000 * n + i, f"{chr(97 + n) * 3} {i}", f"l{n}") for n in range(3) for i in range(2000)] * 3 + [(90_000 + i, f"xyz {i}", "rare") for i in range(30)] + [(5, "one row many times", "hot")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, original = [], lang_id.train

    def spy(sample, *rest, **options):
        seen.extend(lang for lang, _, _ in sample)
        return original(sample, *rest, **options)

    monkeypatch.setattr(lang_id, "train", spy)
    lang_id.fit(docs, lang_id.F.lit(False), per_class=60)
    assert seen.count("rare") == 30 and seen.count("hot") in (0, 60) and all(30 <= seen.count(f"l{n}") <= 60 for n in range(3))


def test_language_id_against_plain_version(spark, docs, corpus):
    """idf, features, probabilities: worked out with dictionaries from the model's weights."""
    model = lang_id.fit(docs, lang_id.held_out())
    grams = lang_id.Grams()

    def plain(text):
        c, out = " ", []
        for ch in text.lower():
            if ch.isalpha() or c[-1] != " ":
                c += ch if ch.isalpha() else " "
        for i in range(1, len(c)):
            out += [c[i]] * (c[i] != " ") + [c[i - 1 : i + 1]] + [c[i - 2 : i + 1]] * (i > 1)
        return Counter(out)

    mod = 1 << 32
    def bucket(g):
        o = [ord(x) for x in g]
        f = [int(x) for x in grams.FACTORS]
        if len(o) == 1:
            return o[0] * f[0] % mod >> int(grams.shift)
        b = o[1] * f[1] % mod
        two = (o[0] * f[0] % mod ^ (b + (b >> 15)) % mod) * 0x27D4EB2F % mod
        if len(o) == 2:
            return two >> int(grams.shift)
        d = o[2] * f[2] % mod
        return (two ^ (d + (d >> 13)) % mod) * 0x165667B1 % mod >> int(grams.shift)

    def counts(text):
        out = Counter()
        for g, n in plain(text).items():
            out[bucket(g)] += n
        return out

    bags = {}
    for i, text, lang, *_ in corpus:
        if any(x.isalpha() for x in text or ""):
            bags[text] = counts(text)
            assert dict(enumerate(grams(text))).items() >= bags[text].items() and grams(text).sum() == sum(bags[text].values())
    learned = [(text, lang) for i, text, lang, *_ in corpus if text is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)]
    df = Counter(b for text, _ in learned for b in bags.get(text, ()))
    for b in set().union(*bags.values()):
        assert model.idf[b] == pytest.approx(math.log((1 + len(learned)) / (1 + df[b])) + 1)
    got = {r["doc_id"]: r for r in lang_id.predict(docs, model, ["doc_id"]).collect()}
    for i, text, *_ in corpus:
        if i is None or text not in bags:
            continue
        x = {b: (1 + math.log(n)) * model.idf[b] for b, n in bags[text].items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [sum(model.weights[c][b] * v / norm for b, v in x.items()) + model.bias[c] for c in range(len(model.classes))]
        e = [math.exp((v - max(z)) / model.temperature) for v in z]
        assert got[i]["score"] == pytest.approx(max(e) / sum(e), abs=1e-4)


def test_ftrl_is_the_closed_form():
    """Its weights minimise the sum of gradients, proximal terms and both penalties, coordinate by coordinate."""
    learner = lang_id.Ftrl(2, 3)
    rng = np.random.default_rng(1)
    total, squares, centre = np.zeros((2, 3)), np.zeros((2, 3)), np.zeros((2, 3))
    for _ in range(40):
        x, y = rng.standard_normal(3), int(rng.integers(2))
        w = learner.weights()
        p = np.exp(w @ x - (w @ x).max())
        g = (p / p.sum() - np.eye(2)[y])[:, None] * x
        centre += (np.sqrt(squares + g * g) - np.sqrt(squares)) / learner.alpha * w
        total, squares = total + g, squares + g * g
        learner.learn(np.arange(3), x, y)
    w = learner.weights()
    f = lambda v: (total - centre) * v + (np.sqrt(squares) + learner.beta) / learner.alpha * v * v / 2 + learner.l2 * v * v / 2 + learner.l1 * np.abs(v)
    for step in (1e-4, -1e-4):
        assert (f(w) <= f(w + step) + 1e-12).all()


def test_language_id_pieces_and_temperature(monkeypatch):
    grams = lang_id.Grams()
    text = "Ab  c1ddé, ff;  gŋ 日本 x" * 7
    whole = grams(text)
    for piece in (1, 2, 3, 10):
        monkeypatch.setattr(lang_id, "PIECE", piece)
        assert (grams(text) == whole).all() and grams("12 !") is None
    monkeypatch.undo()
    assert grams("12 !") is None and grams(None) is None
    assert grams("ab ab").sum() == 4 + 5 + 4
    assert lang_id.temperature([(0, np.array([9.0, 0.0])), (1, np.array([9.0, 0.0]))] * 5) > 5


def test_lm_score_against_counting(docs, corpus):
    for options in ({}, {"chunk_words": 300, "bucket_entries": 500}):
        got = defaultdict(list)
        for r in lm_score.score(docs, **options).collect():
            got[r["doc_id"]].append(r)
        texts = [words(t) for _, t, *_ in corpus]
        total = [Counter() for _ in range(4)]
        grams = lambda w: [Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) for n in (1, 2, 3)]
        for w in texts:
            for n, g in enumerate(grams(w)):
                total[n + 1].update(g)
        size = sum(map(len, texts))
        for (i, *_), w in zip(corpus, texts, strict=True):
            own = grams(w)
            c = lambda *g: total[len(g)][g] - own[len(g) - 1][g]  # noqa: E731, B023
            n, logs = size - len(w), 0.0
            for j in range(len(w)):
                if j > 1 and c(*w[j - 2 : j + 1]):
                    s = c(*w[j - 2 : j + 1]) / c(*w[j - 2 : j])
                elif j > 0 and c(*w[j - 1 : j + 1]):
                    s = c(*w[j - 1 : j + 1]) / c(w[j - 1]) * (0.4 if j > 1 else 1)
                else:
                    s = (c(w[j]) / n if c(w[j]) else 1 / (n + 1)) * 0.4 ** min(j, 2)
                logs += math.log(s)
            near = min(got[i], key=lambda r: abs(r["log_score"] - logs))
            assert near["log_score"] == pytest.approx(logs, rel=1e-9, abs=1e-9) and near["n_words"] == len(w)
            assert (near["mean_log_score"] is None) == (not w)


def test_lm_chunk_digest_tells_orders_apart():
    h, starts = np.arange(6, dtype=np.uint64), np.array([0, 2, 6])
    one = lm_score.chunk_digest([1, 2], h, starts)
    assert one == lm_score.chunk_digest([1, 2], h.copy(), starts.copy())
    assert len({one, lm_score.chunk_digest([2, 1], h, starts), lm_score.chunk_digest([1, 2], h[::-1].copy(), starts), lm_score.chunk_digest([1, 2], h, np.array([0, 3, 6])), lm_score.chunk_digest([None, 2], h, starts)}) == 5


def test_lm_score_empty(empty):
    assert lm_score.score(empty).count() == 0


def test_lm_hash_codec():
    codec = lm_score.Codec()
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 999, np.uint64) & lm_score.KEPT)
    assert (codec.read_hashes(*codec.hashes(x)) == x).all()
    n = np.array([0, 1, 70_000, 2**32 - 1])
    assert (codec.read_numbers(codec.numbers(n)) == n).all()


def test_mixing_reaches_targets(docs, corpus):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus)
    sizes = defaultdict(int)
    for _, text, _, source, _ in corpus:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:  # the plain loop
        left = budget - sum(target.values())
        share = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / share >= 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / share for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
        if not free:
            break
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1 + 0.02 * target[s] + sum(1 for x in corpus if x[3] == s)
    assert sorted(got, key=str) == sorted(mixing.mix(docs).collect(), key=str)


def test_mixing_repeats_texts(docs):
    out = mixing.repeat_texts(docs)
    assert out.columns == docs.columns
    taken = sum(r["taken"] for r in mixing.mix(docs).collect())
    assert sum(len(words(r["text"])) for r in out.select("text").collect()) == taken


@pytest.mark.parametrize("ids", [[None] * 1000, [7] * 1000, list(range(1000))])
def test_mixing_of_rows_that_share_a_slot(spark, ids):
    """Equal rows, rows of one id and rows without an id come to the target as others do."""
    docs = spark.createDataFrame([(i, "word", "a") for i in ids], "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs).collect()
    assert got[0]["target"] == 1500 and sum(r["taken"] for r in got) == 1500 and {r["taken"] for r in got} == {1, 2}
    assert mixing.repeat_texts(docs).count() == 1500
    mixed = docs.withColumn("text", mixing.F.concat_ws(" ", "text", mixing.F.monotonically_increasing_id())).unionByName(docs.withColumn("source", mixing.F.lit(None).cast("string")))
    sums = defaultdict(int)
    for r in mixing.mix(mixed).collect():
        sums[r["source"], r["target"]] += r["taken"]
    assert all(abs(taken - target) <= 1 for (_, target), taken in sums.items())


def test_mixing_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.repeat_texts(empty).count() == 0


def brute_lines(corpus, min_docs=5, min_chars=40):
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(low)
    holders = defaultdict(set)
    for i, text, *_ in corpus:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders[key(line)].add(i)
    top = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    for i, text, *_ in corpus:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or not (key(x) in top and top[key(x)] != i)]
        yield i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_line_dedup(docs, corpus, monkeypatch):
    want = sorted(map(str, brute_lines(corpus)))
    assert any(int(w.split(",")[2]) for w in want)
    assert sorted(str(tuple(r)) for r in line_dedup.digests(docs).collect()) == want
    # many shards, and copies of those that get more than two probes
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 3)
    monkeypatch.setattr(line_dedup, "PROBES", 2)
    assert sorted(str(tuple(r)) for r in line_dedup.digests(docs).collect()) == want
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_line_dedup_of_rows_without_ids(spark):
    line = "a line that is long enough to be found in many documents"
    rows = [(None, None)] * 50 + [(None, line)] * 6 + [(i, f"{line}\nown {i}") for i in range(5)] + [(4, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == Counter([(None, None)] * 50 + [(None, line)] * 6 + [(i, f"own {i}") for i in range(4)] + [(4, f"{line}\nown 4")] + [(4, None)] * 40)


def test_line_dedup_empty(empty):
    assert line_dedup.digests(empty).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 64, 20_000, np.uint64))
    mph = line_dedup.PerfectHash.build(keys)
    assert (np.sort(mph(keys)) == np.arange(len(keys))).all()
    again = line_dedup.PerfectHash.load(*mph.dump())
    assert (again(keys) == mph(keys)).all()
    assert sum(len(b) for b in mph.levels) * 8 < 4.5 * len(keys)
    assert len(line_dedup.PerfectHash.build(keys[:0])(keys[:5])) == 5


@pytest.mark.parametrize("merge_tokens", [packing.MERGE_TOKENS, 1500])
def test_packing_is_a_partition_of_ids(docs, corpus, monkeypatch, merge_tokens):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "MERGE_TOKENS", merge_tokens)
    tok = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.pack(docs).collect()
    want = Counter()
    for i, text, *_ in corpus:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        want[i, len(ids)] += 1
    starts = defaultdict(list)
    windows = defaultdict(list)
    texts = {i: t for i, t, *_ in corpus}
    for r in got:
        starts[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(piece.tobytes()) == r["ids_crc32"]
    for key, n in want.items():
        cover = Counter(p for s, length in starts[key] for p in range(s, s + length))
        assert cover == Counter({p: n for p in range(key[1])})
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    # at most one window isn't full where one task joins what is left
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in corpus)
    assert sum(sum(n for _, n in p) < 1024 for p in windows.values()) <= (1 if merge_tokens > total else -(-total // merge_tokens))
    # a window closed by the rule holds its documents' last pieces whole, one cut off is a slice of one document
    for r in got:
        if r["how"] == "slice":
            assert r["length"] == 1024 and r["start"] % 1024 == 0
        elif r["how"] == "rule":
            assert r["start"] % 1024 == 0 and r["start"] + r["length"] == r["doc_tokens"]


def test_packing_places_by_sum_of_squares():
    """Every placement against trying all levels; windows closed by the rule are what it says."""
    import random

    rng, size = random.Random(9), 12
    packer, levels, closed, got = packing.Packer(size), Counter(), 0, []
    for i in range(3000):
        s = rng.randint(1, size - 1)
        options = []
        for h in [0, *(h for h in levels if levels[h] and h + s <= size)]:
            after = levels.copy()
            after[h] -= h > 0
            after[h + s] += h + s < size
            options.append((sum(v * v for k, v in after.items() if 0 < k < size), -h))
        h = -min(options)[1]
        levels[h] -= h > 0
        levels[h + s] += h + s < size
        closed += h + s == size
        got += packer.add(i, np.zeros(s, np.uint32))
        assert all(packer.count[k] == levels[k] for k in range(1, size))
    assert len({p[4] for p in got}) == closed and closed >= 1400
    left = list(packer.close())
    lengths = Counter()
    for p in left:
        lengths[p[4]] += len(p[2])
    assert sum(v < size for v in lengths.values()) <= 1 and {p[6] for p in left} <= {"joined"}


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


def test_packing_special_token_and_rule():
    from tokenizers import Tokenizer

    text = "a <|endoftext|> b  \n\n  c d　e"
    path = packing.default_vocabulary()
    assert packing.Encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    p = packing.Packer(10)
    list(p.add(1, np.zeros(4, np.uint32)))
    assert p.count[4] == 1 and p.place(6) == 4  # filling a window lowers the squares
    assert p.place(4) in (0, 4)


def test_near_dedup_components(docs, corpus):
    for k in (4, 5):
        sets = defaultdict(frozenset)
        for i, text, *_ in corpus:
            w = words(text)
            sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
        ids = [i for i in sets if i is not None]
        root = {i: i for i in ids}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in ids:
            for b in ids:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = near_dedup.find(docs, k=k).collect()
        assert len(got) == len(corpus)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
                continue
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    out = near_dedup.keep_one(docs)
    assert out.columns == docs.columns and out.filter("doc_id in (101, 102)").count() == 0


def test_near_dedup_empty(empty):
    assert near_dedup.find(empty).count() == 0


def test_setsketch_merge_and_estimate():
    rng = np.random.default_rng(4)
    sketch = near_dedup.Sketcher()
    x = rng.integers(0, 1 << 64, 4000, np.uint64)
    a, b = x[:3000], x[1000:]
    assert (near_dedup.merge(sketch(a), sketch(b)) == sketch(x)).all()
    size = np.array([3000])
    j = near_dedup.estimate(*near_dedup.compare_registers(sketch(a)[None], sketch(b)[None]), size, size)
    assert abs(j[0] - 0.5) < 0.15
    assert near_dedup.estimate(np.array([0]), np.array([0]), size, size)[0] == 1


def test_near_dedup_chain_of_hubs(spark):
    """A chain whose neighbours are linked but whose ends are not is one component."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        rows.append((50 - i, " ".join(base[5 * i : 5 * i + 250])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.find(docs, k=4).collect()}
    assert set(got.values()) == {39}


def test_segments_against_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(200):
        s = rng.integers(-4, 4, rng.integers(1, 25)).astype(float)
        got = toxicity.segments(s)
        total = np.concatenate([[0], np.cumsum(s)])
        # the best segment is found, and no two overlap
        best = max(total[j] - total[i] for i in range(len(s)) for j in range(i + 1, len(s) + 1))
        if best > 0:
            assert max(x for _, _, x in got) == best
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
        # a maximal segment's prefixes and suffixes are positive
        for a, b, x in got:
            assert x == total[b] - total[a] and all(total[i] > total[a] for i in range(a + 1, b + 1)) and all(total[b] > total[i] for i in range(a, b))


def test_toxicity_finds_planted(spark):
    import random

    rng = random.Random(1)
    plain = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(200)]
    bad = ["vilething", "vilest", "grimword"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", ",", "***"])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic), "y"))
    labels += [(7, None, None), (None, 1, None), (0, 0, None)]
    rows += [(401, None, None), (402, "", ""), (None, "vilething vilething vilest", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in range(400))
    assert got[401] == got[402] < 0.1 and got[None] >= 0.7
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), marks)).count() == 0  # no texts for the labels
    none = toxicity.fit(docs, marks.limit(0))
    assert all(r["score"] < 1e-6 for r in toxicity.score(docs, none).collect())


def test_toxicity_against_plain_version(spark):
    """Weights, calibration and score worked out again with loops, for ties, repeated rows, several texts an id and unlabelled rows."""
    import random

    rng = random.Random(6)
    plain = ["".join(rng.choices("abcdefghij", k=3)) for _ in range(150)]
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        if i % 4 == 0:
            w[rng.randrange(len(w)) :] = ["zzz", "yyy"] * rng.randint(1, 3)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [rows[0]] * 9 + [(8, "another text of one id"), (400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), strength=50.0)

    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    hashed = {r["doc_id"]: r["text"] for r in docs.selectExpr("doc_id", "text", "xxhash64(text) h").filter("text is not null").orderBy(toxicity.F.desc("h")).collect()}  # the last: the smallest hash
    sample = [(i, y, (hashed[i]).encode().split()) for i, y in labels if not held(i)]
    order = {r["doc_id"]: n for n, r in enumerate(docs.select("doc_id").distinct().orderBy(toxicity.F.xxhash64("doc_id", toxicity.F.lit(23)), "doc_id").collect())}
    sample.sort(key=lambda s: order[s[0]])
    share, fold = toxicity.copies([w for _, _, w in sample])
    prior = Counter(w for _, text in rows for w in (text or "").encode().split())
    vocabulary = sorted({w for _, y, words in sample if y for w in words})
    a0 = {w: 50.0 * (prior[w] + 0.5) / sum(prior[v] + 0.5 for v in vocabulary) + 1e-3 for w in vocabulary}

    def weights(chosen):
        count = [Counter(), Counter()]
        for k in chosen:
            for w in sample[k][2]:
                if w in a0:
                    count[sample[k][1]][w] += share[k]
        n, a = [sum(c.values()) for c in count], sum(a0.values())
        out = {}
        for w in vocabulary:
            odds = [math.log((count[y][w] + a0[w]) / (n[y] + a - count[y][w] - a0[w])) for y in (0, 1)]
            error = math.sqrt(sum(1 / (count[y][w] + a0[w]) for y in (0, 1)))
            if odds[1] - odds[0] > 0.5 and (odds[1] - odds[0]) / error >= 3:
                out[w] = min(odds[1] - odds[0], 8.0)
        # lambda: the root of the mean of exp(lambda * score) over clean words, by bisection
        shares = [(count[0][w] + 0.5 / max(1, len(out)), v - 0.5) for w, v in out.items()] + [(sum(count[0][w] for w in vocabulary if w not in out), -0.5), (max(1.0, n[0]), -0.5)]
        low, high = 0.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(s * math.exp(min(mid * x, 600)) for s, x in shares) < sum(s for s, _ in shares) else (low, mid)
        return out, (low + high) / 2

    def best_segments(weight, rate, words):
        s, found = [weight.get(w, 0.0) - 0.5 for w in words], []

        def split(a, b):  # the best stretch, the longest of equals, then what is left beside it
            top = max(((sum(s[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0), key=lambda t: (round(t[0], 9), t[2] - t[1], -t[1]))
            if top[0] > 0:
                found.append(rate * top[0] - math.log(len(words)))
                split(a, top[1])
                split(top[2], b)

        split(0, len(s))
        return found

    everything, rate = weights(range(len(sample)))
    assert model.weights == pytest.approx(everything, rel=1e-9) and set(everything) == {b"zzz", b"yyy"}
    aside = {}
    for f in range(toxicity.FOLDS):
        learned = weights([k for k in range(len(sample)) if fold[k] != f])
        aside |= {k: best_segments(*learned, sample[k][2]) for k in range(len(sample)) if fold[k] == f}
    clean = sorted((max(aside[k]), share[k]) for k in range(len(sample)) if not sample[k][1] and aside[k])
    location, spread = 0.0, 1.0
    if len(clean) >= 20:
        raise AssertionError("clean texts hold none of the two words here")
    some = (sum(w for _, w in clean) + 0.5) / (sum(share[k] for k in range(len(sample)) if not sample[k][1]) + 1)
    assert (model.location, model.spread) == (location, spread) and model.any_share == pytest.approx(some)
    for i, text in rows[:60]:
        z = sorted(((x - location) / spread for x in best_segments(everything, rate, text.encode().split())), reverse=True)
        one = -math.log(-math.expm1(-math.exp(-z[0]))) - math.log(some) if z else 0.0
        sums = [sum(z[:r]) - (r - 1) * math.log(sum(z[:r])) + math.lgamma(r + 1) + math.lgamma(r) for r in range(1, len(z) + 1) if z[r - 1] > 0]
        got = model.features(model.spans(text.encode().split()))
        assert got[:2] == pytest.approx((one, max([one, *sums]) if z else 0.0), rel=1e-5, abs=1e-5)
        a, b, c = model.logistic
        want = 1 / (1 + math.exp(-(a * min(got[0], 12) + b * min(got[1], 24) + c)))
        assert model.score(*got[:2]) == pytest.approx(want)
    assert toxicity.score(docs, model).count() == len(rows)


@pytest.mark.parametrize("options", [{}, {"shard_words": 500, "dense": 4, "group": 1}])
def test_search_against_all_scores(docs, corpus, options):
    asked = docs.filter("doc_id % 10 = 0").selectExpr("doc_id as query_id", "text")
    got = defaultdict(list)
    for r in search.search(docs, asked, k=7, **options).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    bags = [(i, Counter(words(t))) for i, t, *_ in corpus]
    lengths = [sum(b.values()) for _, b in bags]
    avg, n = sum(lengths) / len(bags), len(bags)
    df = Counter(t for _, b in bags for t in b)
    seen = set()
    for i, q in bags:
        if i is None or i % 10 or i in seen or not q:
            continue
        seen.add(i)
        all_scores = []
        for (d, b), length in zip(bags, lengths, strict=True):
            s = sum(f * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * length / avg)) for t, f in q.items() if b[t])
            if s > 0 and d is not None:
                all_scores.append((-round(s, 6), d))
        want = sorted(all_scores)[:7]
        mine = sorted(got[i])
        assert [d for _, d, _ in mine] == [d for _, d in want]
        assert [s for *_, s in mine] == pytest.approx([-s for s, _ in want], abs=2e-6)


def test_search_empty(docs, empty):
    asked = docs.selectExpr("doc_id as query_id", "text")
    assert search.search(docs, asked.limit(0)).count() == 0
    assert search.search(empty, asked.filter("doc_id = 1")).count() == 0


@pytest.mark.parametrize("group", [1, 16])
def test_search_moves_no_copies(docs, group):
    """Shards and queries meet where they are read: no exchange or broadcast holds either, however many groups of queries there are."""
    found = search.search(docs, docs.selectExpr("doc_id as query_id", "text"), group=group)
    text = found._jdf.queryExecution().explainString(docs.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]", text)
    assert moved and not any(re.search(r"\b(data|terms|queries)#", columns) for columns in moved)


def test_query_groups_hold_every_query_within_bounds(spark):
    import pickle

    blocks = [[(10 * b + i, 0, np.arange(n, dtype=np.uint64), np.ones(n)) for i in range(2)] for b, n in enumerate((5, 70_000, 3, 40_000, 90_000, 1))]
    frame = spark.createDataFrame([(b, bytearray(pickle.dumps(x))) for b, x in enumerate(blocks)], "qblock long, queries binary")
    rows = search.query_groups(frame, 1, 1).collect()
    got = [[(i, len(t)) for i, _, t, _ in pickle.loads(r["queries"])] for r in rows]
    assert sorted(x for g in got for x in g) == sorted((i, len(t)) for x in blocks for i, _, t, _ in x) and len({r["column"] for r in rows}) == len(rows)
    assert len(got) > 1 and all(sum(n for _, n in g) <= search.QUERY_TERMS // 4 or len(g) == 2 for g in got)


def plain_count(pieces, word):
    """Pieces of the best segmentation, by a table over all prefixes."""
    longest = max(map(len, pieces))
    table = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(table[start][0] + pieces[word[start:end]], -(end - start), table[start][1] + 1) for start in range(max(0, end - longest), end) if word[start:end] in pieces]
        score, _, n = max(options)
        table.append((score, n))
    return table[-1][1]


def test_token_counts_of_long_pretokens(monkeypatch):
    """Long strings that share prefixes, over the bounds of what is looked up and kept at once."""
    import random
    import time

    rng = random.Random(4)
    pieces = token_count.read_pieces(packing.default_vocabulary())
    counter = token_count.TrieCounter(pieces)
    base = bytes(rng.choice(b"etaoinsh") for _ in range(900))
    words = sorted({base[:n] + bytes(rng.choice(b"xyz ") for _ in range(m)) for n, m in ((60, 5), (60, 300), (49, 0), (48, 0), (47, 3), (500, 1), (500, 400), (900, 0), (100, 0), (700, 50))} | {b"a" * 130, b" " * 200, "ä日".encode() * 40})
    want = [plain_count(pieces, w) for w in words]
    assert counter(words).tolist() == want
    monkeypatch.setattr(token_count, "PIECE", 37)
    monkeypatch.setattr(token_count, "SHARED", 90)
    assert counter(words).tolist() == want
    monkeypatch.undo()
    began = time.perf_counter()
    assert counter([b"x" * 1_000_000])[0] > 0
    assert time.perf_counter() - began < 30


def test_token_counts_against_plain_search(docs, corpus):
    import public_tokenizers
    import regex

    pieces = token_count.read_pieces(packing.default_vocabulary())
    split = regex.compile(public_tokenizers.PATTERN).findall
    memo = {}
    want = Counter()
    for i, text, *_ in corpus:
        parts = split(text or "")
        for p in parts:
            if p not in memo:
                memo[p] = plain_count(pieces, p.encode())
        want[i, len(parts), sum(memo[p] for p in parts)] += 1
    for options in ({}, {"remember": 5, "at_once": 3}):
        assert Counter(tuple(r) for r in token_count.count_tokens(docs, **options).collect()) == want


def test_token_counts_empty(empty):
    assert token_count.count_tokens(empty).count() == 0


def test_null_ids_take_no_place_among_equal_documents():
    import pickle

    k, bag = 3, (np.array([7], np.uint64), np.array([1]), 1)
    for ids, want in (([search.NOBODY, search.NOBODY, 5, 6, 7, 8], [5, 6, 7]), ([search.NOBODY] * 6, [])):
        n, words, _, df, data = search.pack_shard(ids, [bag] * 6, k)
        assert (n, words, np.frombuffer(df, np.int32).tolist()) == (6, 6, [6])
        assert pickle.loads(data)[0].tolist() == want


def test_search_passes_over_blocks(monkeypatch):
    """Of many blocks only pivots are read, and what is found is what full scoring finds."""
    rng = np.random.default_rng(6)
    hashes = search.common.WordHashes()
    # a topic's documents have a length of their own, so that they lie together; all share some words
    texts = [" ".join([f"t{i // 60}w{int(v)}" for v in rng.integers(0, 40, 30 + i // 60)] + [f"c{int(v)}" for v in rng.integers(0, 200, 20)]) for i in range(3000)]
    bags = [search.bag_of(t, hashes) for t in texts]
    _, _, terms, _, data = search.pack_shard(list(range(3000)), bags, 5)
    shard = search.Shard(terms, data, 30.0, 16)
    read = []
    original = search.ranges
    monkeypatch.setattr(search, "ranges", lambda a, b: read.append(int((b - a).sum())) or original(a, b))
    cell = search.Cell(5)
    df = Counter(x for t, *_ in bags for x in t.tolist())
    cell.queries = [(i, 0, t, tf * np.log(1 + (3000.5 - np.array([df[x] for x in t.tolist()])) / (np.array([df[x] for x in t.tolist()]) + 0.5))) for i, (t, tf, _) in enumerate(bags[:1200:60])]
    cell.search(shard)
    for q, (_, _, t, w) in enumerate(cell.queries):
        every = [(-round(sum(v * search.impacts(tf, n, 30.0) for v, tf in zip(w[np.isin(t, dt)], dtf[np.isin(dt, t)], strict=True)), 6), i) for i, (dt, dtf, n) in enumerate(bags)]
        want = sorted(every)[:5]
        assert cell.d[cell.q == q].tolist() == [i for _, i in want]
        assert cell.s[cell.q == q] == pytest.approx([-x for x, _ in want], abs=2e-6)
    # ranges are: all pairs of the terms; postings in leading blocks; postings in pivots
    rare = sum(df[x] for _, _, t, _ in cell.queries for x in t.tolist() if shard.place[np.searchsorted(shard.terms, x)] < 0)
    assert 0 < read[1] + read[2] < 0.5 * rare


def test_near_dedup_repeated_ids_with_unlike_texts(spark):
    """A document on several rows is linked where any of its texts is, whichever row comes first."""
    import random

    rng = random.Random(11)
    text = lambda n=60: " ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(n))
    rows, want = [], {}
    for g in range(60):
        base, first, second = 10 * g, text(), text()
        rows += [(base, first), (base + 1, first + " tail"), (base + 2, text()), (base + 2, second), (base + 3, second + " end"), (base + 1, text())]
        # 0 - 1 by the first text, 2 - 3 by the second; 4 ties both together
        rows += [(base + 4, first), (base + 4, second)] if g % 2 else []
        want |= {base: base, base + 1: base, base + 2: base if g % 2 else base + 2, base + 3: base if g % 2 else base + 2, base + 4: base}
    rows += [(2, None), (7, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = near_dedup.find(docs, k=4).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == (7 if r["doc_id"] == 7 else want[r["doc_id"]]) for r in got)


def test_near_dedup_loses_no_pair_at_the_threshold(spark):
    """Pairs of sets at a similarity of exactly 0.8, short and long."""
    rows, n = [], 0
    for size in (9, 45, 90):
        for _ in range(400):
            shared = size * 8 // 9
            words = [f"w{n}x{i}" for i in range(shared + 3)]
            extra = [f"e{n}x{i}" for i in range(size - shared)], [f"f{n}x{i}" for i in range(size - shared)]
            rows += [(2 * n, " ".join(words + extra[0])), (2 * n + 1, " ".join(words + extra[1]))]
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.find(docs, k=4).collect()}
    assert all(got[2 * i + 1] == got[2 * i] == 2 * i for i in range(n))


def test_near_dedup_blocks_of_a_key_with_an_unlike_hub(spark, monkeypatch):
    """Noisy copies around the threshold, in many blocks: the same components as from all pairs."""
    import random

    rng = random.Random(3)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(70):
        kept = list(base)
        for _ in range(8 if i == 0 else rng.choice((2, 3, 4, 5))):
            kept[rng.randrange(150)] = f"x{i}y{rng.randrange(1000)}"
        texts[i] = " ".join(kept)
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(147)} for i, t in texts.items()}
    root = {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=4).collect()}
    assert links and 1 < len(set(root.values())) < len(texts) and got == root


def test_likelihood_rises_up_to_the_estimate():
    rng = np.random.default_rng(8)
    larger, smaller = rng.integers(0, 90, 3000), rng.integers(0, 90, 3000)
    n_a = rng.integers(50, 60, 3000)
    n_b = rng.integers(50, 60, 3000)
    j = near_dedup.estimate(larger, smaller, n_a, n_b)
    for least in (0.5, 0.67, 0.8):
        differs = near_dedup.reaches(larger, smaller, n_a, n_b, least) != (j >= least - 1e-9)
        assert not differs[np.abs(j - least) > 0.006].any()
    assert near_dedup.reaches(larger, smaller, n_a, n_b, -0.2).all()
