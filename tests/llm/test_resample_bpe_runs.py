"""Resampling, word BPE and run detection against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import resample, runs, word_bpe

# ---- resampling


def plain_resampling(docs, target, percent=25, min_words=20, most=2, buckets=10_000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    mine = [(i, *features(text)) for i, text in docs]
    s, t = Counter(b for _, _, f in mine for b in f), Counter(b for text in target for b in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, n, f in mine:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: math.floor(percent * len(able) / 100)]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("options", [{}, {"chunk": 64}, {"chunk": 1, "most": 3, "percent": 60, "min_words": 2}, {"buckets": 70_000, "most": 1}])
def test_resampling_against_plain_version(docs, corpus, spark, options):
    target = [corpus[10][1], corpus[11][1], None, ""]
    frame = spark.createDataFrame([(t, 1.0) for t in target], "text string, score double")
    got = sorted((tuple(r) for r in resample.resample(docs, frame, **options).collect()), key=str)
    want = plain_resampling([r[:2] for r in corpus], target, **{k: v for k, v in options.items() if k != "chunk"})
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(r[0], r[1], r[2], r[3]) for r in want]
    # equal rows have ranks next to each other, in any order
    assert sorted((r[0], r[3], r[4]) for r in got if r[4]) == sorted((r[0], r[3], r[4]) for r in want if r[4])


def test_resampling_of_repeated_rows_and_ties(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(7, text)] * 9000 + [(i, text + f" x{i}") for i in range(100, 160)] + [(None, text)] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    got = [tuple(r) for r in resample.resample(frame, target, percent=100).collect()]
    want = plain_resampling(rows, ["w1 w2 w3"], percent=100)
    assert sorted(got, key=str) == want and sorted(r[4] for r in got) == list(range(1, len(rows) + 1))


def test_resampling_of_nothing(spark, empty):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(empty, none).count() == 0
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert [tuple(r) for r in resample.resample(some, none).collect()] == plain_resampling([(1, "a b c " * 10)], [])


def test_chunks_own_every_start():
    rng = random.Random(2)
    for _ in range(300):
        text = b" ".join(bytes(rng.choices(b"abc", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 40)))
        for size in (1, 5, 30):
            parts = list(resample.chunks_of(text, size, 2))
            assert b" ".join(own.strip() for own, _ in parts).split() == text.split()
            both = [resample.hashed(own, more, 3, 50) for own, more in parts]
            whole = resample.hashed(text, b"", 3, 50)
            assert sum(n for n, _ in both) == whole[0]
            assert sorted(np.concatenate([b for _, b in both]).tolist()) == sorted(whole[1].tolist())


# ---- word BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe.default_vocabulary())


@pytest.fixture(scope="module")
def encoder():
    return word_bpe.WordEncoder(word_bpe.default_vocabulary())


POOLS = ["aaab", "abcdefghijklmnopqrstuvwxyz'  ", "é́é İΣσςßẞǅ", "日本語テキスト が", "<|startoftext|>endof<|endoftext|></w>", "\n\t\x0b\x1c\x85 　ab1½²Ⅷ﻿", "".join(map(chr, range(32, 0x600))), "".join(map(chr, range(0x10000, 0x10400)))]


def test_word_bpe_equals_the_library(library, encoder):
    rng = random.Random(11)
    for _ in range(4000):
        pool = "".join(rng.sample(POOLS, rng.randint(1, 3)))
        text = "".join(rng.choice(pool) if rng.random() < 0.9 else rng.choice(["<|startoftext|>", "</w>", "<|endoftext|>", "the ", "  ", "'s", "'LL"]) for _ in range(rng.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids, repr(text)
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_word_bpe_of_every_token(library, encoder):
    """Each token's own string, and pairs of tokens written together."""
    rng = random.Random(4)
    names = [t.removesuffix("</w>") for t in encoder.merges.ids]
    letters = encoder.letters
    texts = [bytes(letters[c] for c in a + b).decode("utf-8", "ignore") for a, b in [(x, "") for x in rng.sample(names, 4000)] + [(rng.choice(names), rng.choice(names)) for _ in range(4000)]]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == want.ids, repr(text)


def test_pattern_tables_agree_below_common(library, encoder):
    own = {b: c for c, b in encoder.letters.items()}
    for code in range(word_bpe.COMMON):
        text = f"a{chr(code)}1{chr(code)}!{chr(code)}"
        text = encoder.normalise(text)
        assert ["".join(own[b] for b in w.encode()) for w in encoder.find(text)] == [w for w, _ in encoder.pre_tokenise(text)], code


def test_word_bpe_forgets_and_goes_by_segments(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "SEGMENT", 50)
    small = word_bpe.WordEncoder(word_bpe.default_vocabulary(), remember=7)
    small.merges.remember = 20
    text = " ".join(f"word{i} é́ Straße{i * 7919} xyzあ" for i in range(60)) + "<|endoftext|>" + "q" * 3000
    ids = library.encode(text, add_special_tokens=False).ids
    assert small.encode(text) == ids and len(small.known) <= 7
    count, a, b = small.digests(text)
    assert (count, a, b) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_word_bpe_query(docs, corpus, empty, library):
    got = sorted((tuple(r) for r in word_bpe.digest_texts(docs).collect()), key=str)
    want = []
    for i, text, *_ in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = {(r["doc_id"], r["n_tokens"], hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in word_bpe.encode_texts(docs).collect()}
    assert full == {(i, n, d) for i, n, _, d in want}
    assert word_bpe.digest_texts(empty).count() == 0


# ---- runs


def plain_runs(w, least):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, b - a, q) for (a, b), q in out.items())


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_against_all_periods(least):
    rng = random.Random(least)
    for _ in range(1200):
        w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 80))]
        if w and rng.random() < 0.6:
            unit = w[: rng.randint(1, 12)]
            w = w + unit * rng.randint(1, 8) + w[::-1] + [9] * rng.randint(0, 2) + w
        assert runs.find_runs(np.array(w, np.int32), least) == plain_runs(w, least), w


def test_runs_of_known_words():
    fib = [[0], [0, 1]]
    while len(fib) < 16:
        fib.append(fib[-1] + fib[-2])
    for w in (fib[-1], [0, 1] * 500 + [2] + [0, 1] * 500, list(range(2000)) * 3, [5] * 3000, list(range(300))):
        assert runs.find_runs(np.array(w, np.int32), 12) == plain_runs(w, 12)


def test_borders_with_many_periods_go_in_slices():
    w = np.array(list(range(700)) * 2 + list(range(900)), np.int32)
    places = runs.Places(w)
    prefix = np.zeros(len(w), np.int64)
    prefix[1:] = places.right(places.suffixes[:-1], places.suffixes[1:])
    blocks = runs.blocks_of(*runs.previous_factors(places.suffixes, prefix))
    assert runs.at_borders(places, blocks, 12, together=64) == runs.at_borders(places, blocks, 12)


def test_previous_factors_against_all_pairs():
    rng = random.Random(8)
    for _ in range(100):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        places = runs.Places(np.array(w, np.int32))
        assert sorted(range(len(w)), key=lambda i: w[i:]) == places.suffixes.tolist()
        prefix = np.zeros(len(w), np.int64)
        prefix[1:] = places.right(places.suffixes[:-1], places.suffixes[1:])
        length, source = runs.previous_factors(places.suffixes, prefix)
        for i in range(len(w)):
            best = max((next((k for k in range(len(w) - i) if w[j + k] != w[i + k]), len(w) - i) for j in range(i)), default=0)
            assert length[i] == best and (best == 0 or source[i] < i and w[source[i] : source[i] + best] == w[i : i + best])


def test_runs_query(docs, corpus, empty):
    got = sorted((tuple(r) for r in runs.digest_runs(docs).collect()), key=str)
    want = []
    for i, text, *_ in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if i is not None and w and (h := zlib.crc32(str(i).encode())) % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = plain_runs(w, 12) if len(w) < 1000 else [(0, len(w), 1)]
        lost = {j for s, size, q in found for j in range(s + q, s + size)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
        kept = " ".join(x for j, x in enumerate(w) if j not in lost)
        want.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert any(r[1] for r in want)
    assert runs.digest_runs(empty).count() == 0
