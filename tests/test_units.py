"""Sources, edits, alignment, findings, levels and streams on small planted inputs."""

import io
import itertools
import os
import re
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import editing as E
from folioflow.functions import money, ordinal, time
from folioflow.operators import blocks, defects, lexical, vectors
from folioflow.sources import books, files
from folioflow.sources.html import html_blocks, read_blocks, resolve_image

PAGE = """<html><head><style>p{}</style></head><body><nav><a href=x>menu</a></nav><h1> A <b>title</b></h1><p>One
two<p>Three<br>four<hr><div class="poem"><p>first line<br/>second line</p></div><blockquote><p>said</p><p>he</p></blockquote>
<div>loose <i>text</i><br>short<br><br>next para that is long enough not to be taken for verse by its median length at all</div>
<table><tr><td>12</td><td>cell</td><td>words</td></tr></table><p>[pg 5]</p><img src="../i/a.png" alt="plate"><p hidden>no</p>
<aside>a note</aside><p></p><span class="pagenum">7</span><svg><image xlink:href="b.png"/></svg><script>var t="</p>";</script>"""


def test_html_blocks():
    got = [(k, t) for _, k, t, _ in read_blocks(PAGE)]
    assert got == [
        ("heading", "A title"), ("paragraph", "One two"), ("paragraph", "Three four"), ("separator", ""), ("verse_line", "first line"), ("verse_line", "second line"),
        ("blockquote", "said he"), ("verse_stanza", "loose text\nshort"), ("paragraph", "next para that is long enough not to be taken for verse by its median length at all"),
        ("verse_line", "cell words"), ("image", "plate"), ("footnote", "a note"), ("image", ""),
    ]
    assert list(read_blocks(None)) == [] and list(read_blocks("")) == []
    assert resolve_image("OEBPS/text/c.xhtml", "../i/a.png") == "OEBPS/i/a.png"


def test_html_blocks_frame(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    out = html_blocks(df, "page_id").collect()
    assert [r["seq"] for r in out] == list(range(1, 14)) and out[0]["block_id"] == "c1.h1" and out[0]["attributes"] == {"level": "1"}


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns:dc="urn:dc"><metadata><dc:title>T</dc:title><dc:language>en</dc:language></metadata><manifest><item id="n" href="n.html" properties="nav"/><item id="b" href="b.html"/><item id="a" href="a.html"/></manifest><spine><itemref idref="n"/><itemref idref="b"/><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("o/a.html", "<p>alpha")
        z.writestr("o/b.html", "<h2>Beta</h2><p>beta")
        z.writestr("o/n.html", "<p>nav")
    return out.getvalue()


TEI = b'<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>Poem</title><author>Some One</author></teiHeader><text><front><div><head>Before</head></div></front><body><div><head>I</head><lg><l>a b</l><l>c</l></lg><div><p>inner</p></div></div></body></text></TEI>'


def test_books(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(epub())
    (tmp_path / "y.xml").write_bytes(TEI)
    (tmp_path / "z.txt").write_text("no book")
    out = books.read_books(spark, f"file://{tmp_path}").collect()
    by = {}
    for r in out:
        by.setdefault(r["path"][-4:], []).append((r["chapter"], r["kind"], r["text"], r["author"]))
    assert by["epub"] == [(1, "heading", "Beta", "Unknown"), (1, "paragraph", "beta", "Unknown"), (2, "paragraph", "alpha", "Unknown")]
    assert [(c, k, t) for c, k, t, _ in by[".xml"]] == [(1, "heading", "Before"), (2, "heading", "I"), (2, "verse_stanza", "a b\nc"), (3, "paragraph", "inner")]
    with pytest.raises(ValueError):
        books.source_kind("a.pdf")
    with pytest.raises(ValueError):
        books.parse_xml(b'<!DOCTYPE x [<!ENTITY a "b">]><x/>')


def test_strict_json_and_bundles(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"id": 1, "v": "a"}\n{"id": 2, "v": null}\n')
    (tmp_path / "bad.json").write_text('{"id": 1, "v": "a", "more": 1}\n')
    assert files.strict_json(spark, f"file://{tmp_path}/ok.json", "id int, v string").count() == 2
    with pytest.raises(Exception, match="fit the schema"):
        files.strict_json(spark, f"file://{tmp_path}/bad.json", "id int, v string").collect()
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z")], "k string, n int, v string")
    new = spark.createDataFrame([("b", 2, "z"), ("b", 1, "changed"), ("a", 1, "x"), ("c", 1, "w")], "k string, n int, v string")
    files.write_bundle(new, f"file://{tmp_path}/bundle", "k")
    got = files.import_bundle(spark, f"file://{tmp_path}/bundle", old, "k")
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x"), ("b", 1, "changed"), ("b", 2, "z"), ("c", 1, "w")]
    assert files.unanswered(old, new.filter("k = 'a'"), "k").count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", ",", "d"]), max_size=25), st.lists(st.sampled_from(["a", "b", "c", ",", "d"]), max_size=25))
def test_word_diff_round_trip(a, b):
    old, new = " ".join(a), " ".join(b)
    parts = E.word_diff(old, new)
    assert "".join(t for o, t in parts if o != "insert") == old
    assert "".join(t for o, t in parts if o != "delete") == new


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,;:—", max_size=120))
def test_clauses_and_slices_cover_the_text(text):
    assert "".join(text[a:z] for a, z in E.clauses(text)) == text
    try:
        assert "".join(p for _, p in E.fitted(text, 40)) == text
    except ValueError:
        assert any(len(s) > 20 for s in text.split(". "))


def test_edits():
    text = "She went to the old house, then home."
    assert E.locate(text, "the OLD  house") == (12, 25) and E.locate(text, "castle") is None
    assert E.sentence_bounds("One. Two three. Four.", 5, 8) == (5, 15)
    a, z, new = E.replacement_span("a big house stands", 2, 5, "big red house")
    assert "a big house stands"[:a] + new + "a big house stands"[z:] == "a big red house stands"
    assert E.display_title("THE WAY TO PARIS", {"paris": "Paris"}) == "The way to Paris" and E.display_title("Quiet", {}) == "Quiet"
    assert E.spec_identity({"a": 1, "m": [{"pricing_per_million": 2}]}) == E.spec_identity({"m": [{"pricing_per_million": 9}], "a": 1})
    assert E.natural_uuid("a", 1) == E.natural_uuid("a", 1) != E.natural_uuid("a1", "")
    assert E.change_ratio("a b c d", "a b c d") == 0


def naive(source, target, shapes, least, skip):
    """Best total by trying every alignment."""
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    conf = lambda i, a, j, b: max(0.0, float(unit(sum(map(unit, source[i : i + a]))) @ unit(sum(map(unit, target[j : j + b])))))

    def best(i, j):
        if i == len(source) or j == len(target):
            return -skip * (len(source) - i + len(target) - j)
        out = [best(i + 1, j) - skip, best(i, j + 1) - skip]
        for a, b in shapes:
            if i + a <= len(source) and j + b <= len(target) and (c := conf(i, a, j, b)) >= least:
                out.append(best(i + a, j + b) + c * (a + b) / 2)
        return max(out)

    return best(0, 0)


def test_alignment_against_all():
    rng = np.random.default_rng(6)
    shapes = ((1, 1), (1, 2), (2, 1))
    for n, m in itertools.product(range(1, 5), range(1, 5)):
        s, t = rng.standard_normal((n, 3)), rng.standard_normal((m, 3))
        got = vectors.monotonic(s, t, shapes, 0.3, 0.15)
        used_s, used_t = sum(a for _, a, *_ in got), sum(b for *_, b, _ in got)
        total = sum(c * (a + b) / 2 for _, a, _, b, c in got) - 0.15 * (n - used_s + m - used_t)
        assert total == pytest.approx(naive(s, t, shapes, 0.3, 0.15))
        assert all(x[0] + x[1] <= y[0] and x[2] + x[3] <= y[2] for x, y in zip(got, got[1:], strict=False))
    assert vectors.monotonic(np.zeros((0, 3)), np.ones((2, 3))) == []
    with pytest.raises(ValueError):
        vectors.monotonic(np.ones((1, 2)), np.ones((1, 3)))


def block_frame(spark, texts):
    return spark.createDataFrame([(0, "s", "en", i, 1, i + 1, "paragraph", t) for i, t in enumerate(texts)], "doc_id long, source string, lang string, pos long, chapter long, seq long, kind string, text string")


def test_split_words_and_initials(spark, monkeypatch):
    filler = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2600))] * 40
    n = len(filler)
    texts = [*filler, "together " * 30, "we came to gether again", "T ogether they sang", "H e said", "together"]
    b = block_frame(spark, texts)
    monkeypatch.setattr(defects, "blocks", lambda *_: b)
    monkeypatch.setattr(defects, "worn", lambda given: given)
    found = {(r["pos"], r["suggested"]) for r in defects.split_words(spark, "").collect()}
    assert found == {(n + 1, "together")}
    first = {(r["pos"], r["suggested"]) for r in defects.detached_initials(spark, "").collect()}
    assert first == {(n + 2, "Together")}


def test_scalars(spark):
    one = spark.range(1).select(
        F.to_json(F.struct(
            time.next_renewal(F.lit("2024-01-31").cast("date"), F.lit("2024-02-10").cast("date")).cast("string").alias("renewal"),
            time.duration(F.lit(3725)).alias("long"), time.duration(F.lit(65)).alias("short"), money.nice_max(F.lit(9.0)).alias("axis"),
            ordinal.ordinal(F.lit("B1")).alias("b1"), ordinal.ordinal(F.lit("X")).alias("none"), ordinal.level(F.lit(6)).alias("top"), money.format_usd(F.lit(0.0042)).alias("small"),
        ))
    ).first()[0]
    assert one == '{"renewal":"2024-02-29","long":"1h 02m","short":"1m 05s","axis":10.0,"b1":3,"top":"C2","small":"$0.0042"}'


def test_packing_windows_are_greedy(spark, monkeypatch):
    b = block_frame(spark, ["x" * n for n in (3, 4, 5, 6, 2)])
    monkeypatch.setattr(blocks, "blocks", lambda *_: b)
    got = {(r["win"], r["chars"]) for r in blocks.window_packing(spark, "", limit=8).collect()}
    assert got == {(1, 7), (2, 5), (3, 8)}


def test_cosine_rejects_unlike_dimensions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.filter("size(a) = 2").select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] == 0
    with pytest.raises(Exception, match="dimensions"):
        df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).agg(F.sum("c")).collect()


def test_alignment_of_250_by_250_is_quick():
    import time as clock

    rng = np.random.default_rng(1)
    s, t = rng.standard_normal((250, 64)), rng.standard_normal((250, 64))
    start = clock.perf_counter()
    assert vectors.monotonic(s, t, ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1)), 0.1, 0.15, 0.08)
    assert clock.perf_counter() - start < 10


def at(*degrees):
    return np.array([[np.cos(np.radians(d)), np.sin(np.radians(d)), 0.0] for d in degrees])


def test_acceptance_needs_the_margin():
    e = np.eye(5)
    target = np.stack([0.78 * e[0] + np.sqrt(1 - 0.78**2) * e[2], e[1], e[3]])
    for rival, certain in ((e[4], True), (0.1 * e[0] + np.sqrt(0.99) * e[2], False)):  # the second is 0.70 like the first target
        first = vectors.graded(np.stack([e[0], e[1], rival]), target, None, 0.65)[0]
        assert (first["source"], first["target"], first["certain"]) == ([0], [0], certain)
        assert first["acceptance"] == ("reciprocal_margin" if certain else "uncertain")


def test_cover_holds_every_sentence_of_both_sides_once():
    g = lambda s, t: vectors.group(s, t, True, 0.9)
    got = vectors.cover(6, 7, [g([1], [0]), g([4], [5])])
    assert [(x["source"], x["target"], x["certain"]) for x in got] == [([0, 1], [0], False), ([2], [1, 2], False), ([3], [3, 4], False), ([4], [5], True), ([5], [6], False)]
    assert [(x["source"], x["target"]) for x in vectors.cover(1, 3, [g([0], [0])])] == [([0], [0, 1, 2])]
    assert [(x["source"], x["target"], x["acceptance"]) for x in vectors.cover(0, 2, [])] == [([], [0, 1], "no_partner")]


def test_correspondence_of_frames(spark):
    """Both sides' leftovers are kept, also where a chapter's numbers have gaps."""
    rows = [(1, 3, 3, [1.0, 0.0, 0.0]), (1, 8, 8, [0.0, 1.0, 0.0])], [(1, 2, 2, [1.0, 0.0, 0.0]), (1, 5, 5, [-0.6, -0.6, 0.5]), (1, 9, 9, [0.0, 1.0, 0.0]), (2, 4, 4, [1.0, 0.0, 0.0])]
    frames = [spark.createDataFrame(r, "chapter int, seq long, sentence long, v array<double>") for r in rows]
    got = sorted(vectors.correspondence(*frames).collect())
    assert [tuple(r)[:5] + (r["certain"], r["method"]) for r in got] == [(1, 3, 1, 2, 2, False, "vectors"), (1, 8, 1, 9, 1, True, "vectors"), (2, None, 0, 4, 1, False, "missing_sentences")]


def test_size_limit_pairs_by_position():
    sides = [np.ones((601, 2)), np.ones((601, 2))]
    method, groups = vectors.correspond(sides, [np.arange(601)] * 2)
    assert method == "size_limit" and len(groups) == 601 and not any(x["certain"] for x in groups)
    method, groups = vectors.correspond([np.ones((2, 2))] * 2, [np.arange(2)] * 2, [["a" * 12_001, "b"], ["c", "d"]])
    assert method == "size_limit" and len(groups) == 2
    assert vectors.correspond([np.ones((2, 2))] * 2, [np.arange(2)] * 2, [["a", "b"]] * 2)[0] == "identical_text"


def test_clauses_refine_until_groups_stand():
    same = at(0, 90)
    assert [(x[0], x[1]) for x in vectors.refine(same, same)] == [([0], [0]), ([1], [1])]
    crossed = vectors.refine(at(0, 50), at(25, 25))  # either clause is as near to the other's partner: one group is left
    assert [(x[0], x[1], x[3]) for x in crossed] == [([0, 1], [0, 1], None)]
    three = np.eye(3)
    method, groups = vectors.correspond([three, three], [np.array([0, 0, 1])] * 2)
    assert method == "vectors" and [(x["source"], x["target"], x["certain"], x["granularity"]) for x in groups] == [([0], [0], True, "clause"), ([1], [1], True, "clause"), ([2], [2], True, "sentence")]


def test_attested_split_words_and_broken_hyphens(spark, monkeypatch):
    filler = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2600))] * 40
    n = len(filler)
    texts = [*filler, "together " * 30, "we came to gether again", "they went so on", "soon " * 30, "bro-ken", "a toge- ther b", "toge-\nther", "x1toge- ther", "toge- wabc"]
    b = block_frame(spark, texts).withColumn("doc_id", (F.col("pos") == n + 3).cast("long"))
    monkeypatch.setattr(defects, "blocks", lambda *_: b)
    monkeypatch.setattr(defects, "worn", lambda given: given)
    found = {(r["pos"], r["suggested"]): r["confidence"] for r in defects.attested_split_words(spark, "").collect()}
    assert set(found) == {(n + 1, "together")}  # "soon" stands in another edition only
    loose = {(r["pos"], r["suggested"]): r["confidence"] for r in defects.split_words(spark, "").collect()}
    assert (n + 2, "soon") in loose and found[n + 1, "together"] == pytest.approx(loose[n + 1, "together"] + 0.08)
    assert {(r["pos"], r["suggested"]) for r in defects.broken_hyphens(spark, "").collect()} == {(n + 5, "together"), (n + 6, "together")}


def test_meetings_of_parts_ties_copies_and_nulls(spark, tmp_path, monkeypatch):
    """Chapters over more than one part equal all pairs in one; equal cosines go to the smaller number; a null vector has no cosine; copies of a
    row are no competitor of it."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4)).round(1)
    v[10], v[11:40:4], v[20] = 0, v[3], v[7]
    rows = [(i, None if i == 31 else v[i].tolist(), i % 3 if i < 59 else 9) for i in range(60)] + [(6, v[8].tolist(), 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(vectors, "MEETING", 7)
    f32 = lambda x: np.float32(x).astype(float)
    pairs = {}
    for i, a, p in rows:
        for j, b, q in rows:
            if i % 2 == 0 and j % 2 == 1 and p == q:
                c = None
                if a is not None and b is not None:
                    x, y = f32(a), f32(b)
                    n = sum(x * x) * sum(y * y)
                    c = float(np.clip(sum(x * y) / np.sqrt(n), -1, 1)) if n else 0.0
                pairs.setdefault((p, i // 2, j // 2), []).append(c)
    flat = [(*k, c) for k, cs in pairs.items() for c in cs]
    got = sorted((tuple(r) for r in vectors.cosine_pairs(spark, str(tmp_path)).select("chapter", "s", "t", "cos").collect()), key=str)
    assert [r[:3] for r in got] == [r[:3] for r in sorted(((*k[:3], None if k[3] is None else round(k[3], 6)) for k in flat), key=str)]
    assert all(r[3] is None and None in pairs[r[:3]] or min(abs(r[3] - c) for c in pairs[r[:3]] if c is not None) < 1e-6 for r in got)
    known = [(p, s, t, -9 if c is None else c) for p, s, t, c in flat]
    near, back = {}, {}
    for p, s, t, c in known:
        near[p, s] = min(near.get((p, s), (9, 0)), (-c, t))
        back[p, t] = min(back.get((p, t), (9, 0)), (-c, s))
    mutual = {p: sum(back[p, t][1] == s for (q, s), (_, t) in near.items() if p == q) for p in (0, 1, 2)}
    assert {r["chapter"]: r["matched"] for r in vectors.mutual_top1(spark, str(tmp_path)).collect()} == mutual
    want = []
    for p, s, t, c in known:
        other = max([d for q, x, y, d in known if q == p and d > -9 and ((x == s) != (y == t))], default=1.0)
        want.append((p, s, t, None if c == -9 else c - other))
    margins = sorted((tuple(r) for r in vectors.reciprocal_margin(spark, str(tmp_path)).collect()), key=str)
    key = lambda r: (*r[:3], r[3] is None, r[3] or 0)
    for a, b in zip(sorted(margins, key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and (a[3] is None) == (b[3] is None) and abs((a[3] or 0) - (b[3] or 0)) < 2e-6, (a, b)
    settled = {(p, s) for p, s, t, c in flat if s == t}
    want = [(p, s, t, "settled") for p, s, t, c in flat if s == t] + [(p, s, t, "found") for p, s, t, c in known if c > 0.5 and (p, s) not in settled and (p, t) not in settled]
    assert sorted(tuple(r) for r in vectors.settled_groups(spark, str(tmp_path)).collect()) == sorted(want)


def test_parts_are_shuffled_a_few_times_only(spark):
    """A part is copied once for each part of the other side; these are about as many as a task's memory asks for."""
    n = 9000
    e = spark.range(2 * n).selectExpr("cast(id % 2 as int) as side", "cast(7 as int) as chapter", "cast(floor(id / 2) as bigint) as seq", "array(cast(id as float), 1f) as v")

    def sizes(left, right):
        yield {"s": np.array([len(left.seq)]), "t": np.array([len(right.seq)])}

    got = [tuple(r) for r in vectors.met(e, sizes, "s long, t long").collect()]
    assert len(got) == 9 and sum(s for _, s, _ in got) == sum(t for *_, t in got) == 3 * n


def struct_side(rng, n, missing=()):
    v = rng.normal(size=(n, 64)).astype(np.float32)
    rows = [{"seq": int(i), "v": None if i in missing else x} for i, x in enumerate(v)]
    return vectors.Side(pa.array(rows, pa.struct([("seq", pa.int64()), ("v", pa.list_(pa.float32()))])))


def test_large_meetings_come_in_order_and_in_fewer_bytes(monkeypatch, tmp_path):
    """The same pairs with the same numbers, NaN and -0.0 among them; files of them are smaller."""
    rng = np.random.default_rng(8)
    left, right = struct_side(rng, 2100, {7}), struct_side(rng, 2000, {0, 3})

    def pairs():
        def strips():
            for at, c in vectors.cosines(left, right, False):
                yield at, {"cos": vectors.rounded(c), "more": vectors.rounded(c * left.seq[at, None])}

        out = list(vectors.pairs_of(left, right, strips(), "cos"))
        return {c: np.concatenate([x[c] for x in out]) for c in ("s", "t", "null", "cos", "more")}

    got = pairs()
    monkeypatch.setattr(vectors, "IN_ORDER", 1 << 30)
    want = pairs()
    o, p = np.lexsort((got["t"], got["s"])), np.lexsort((want["t"], want["s"]))
    for c, x in got.items():
        assert np.array_equal(x[o], want[c][p], equal_nan=c in ("cos", "more"))
    assert np.array_equal(np.signbit(got["cos"][o])[~got["null"][o]], np.signbit(want["cos"][p])[~want["null"][p]])
    assert (np.signbit(got["cos"]) & (got["cos"] == 0)).any()
    size = []
    for k, x in enumerate((got, want)):
        pq.write_table(pa.table({c: x[c] for c in ("s", "t", "cos")}), f"{tmp_path}/{k}", compression="snappy")
        size.append(os.path.getsize(f"{tmp_path}/{k}"))
    assert size[0] < 0.8 * size[1]


def test_nearest_are_carried_from_strip_to_strip(spark, tmp_path):
    """1,024 blocks a side are more than one strip, and their margins come in order; of small whole numbers, so that there are ties."""
    rng = np.random.default_rng(9)
    v = rng.integers(-2, 3, (2048, 3))
    v[400] = 0
    spark.createDataFrame([(i, x.astype(float).tolist(), 1) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    a, b = v[0::2], v[1::2]
    norm = np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1))
    c = np.divide(a @ b.T, norm, out=np.zeros(norm.shape), where=norm > 0)
    rivals = np.empty_like(c)
    for i in range(1024):
        for j in range(1024):
            rivals[i, j] = max(np.delete(c[i], j).max(), np.delete(c[:, j], i).max()) if (i + j) % 37 == 0 else np.nan
    got = np.zeros((1024, 1024))
    frame = vectors.reciprocal_margin(spark, str(tmp_path)).toPandas()
    assert len(frame) == 1024 * 1024 and frame["margin"].is_monotonic_increasing
    got[frame["s"], frame["t"]] = frame["margin"]
    some = ~np.isnan(rivals)
    assert np.abs(got - (c - rivals))[some].max() < 1e-6
    assert not (np.signbit(got) & (got == 0)).any()
    row, column = c.argmax(1), c.argmax(0)
    assert vectors.mutual_top1(spark, str(tmp_path)).first()["matched"] == sum(column[j] == i for i, j in enumerate(row))


def test_durations_round_to_the_nearest_second(spark, tmp_path):
    from folioflow.operators import ledger

    at = "timestamp_ntz'2024-01-01 00:00:00.{0}'"
    spark.sql(f"select 1L event_id, {at.format('000001')} ts, 1L user_id, 'view' event_type, 1.0D value, '{{}}' props union all select 2L, timestamp_ntz'2024-01-01 00:00:59.9', 1L, 'view', 2.0D, '{{}}'").write.parquet(f"{tmp_path}/events.parquet")
    assert ledger.durations(spark, str(tmp_path)).first()["lasted"] == "1m 00s"


def test_long_alignment_keeps_no_cells(monkeypatch):
    """An alignment that makes its decisions anew between kept rows equals one that keeps all, in memory far below that of its cells."""
    import tracemalloc

    rng = np.random.default_rng(5)
    s = rng.normal(size=(1500, 8))
    t = np.repeat(s, 2, axis=0)[::2] + rng.normal(size=(1500, 8)) * 0.3
    want = vectors.monotonic(s, t, vectors.SHAPES, 0.3, size_cost=0.08)
    monkeypatch.setattr(vectors, "CELLS", 10_000, raising=False)
    tracemalloc.start()
    got = vectors.monotonic(s, t, vectors.SHAPES, 0.3, size_cost=0.08)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and len(got) > 1000
    assert peak < 1500 * 1500 * 8  # one table of that many doubles; the old form held seven


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_neither_sorted_nor_shuffled_one_by_one(spark, data):
    """Sets, structs and runs of words made a row for each word travel or be sorted; texts are dealt by document instead."""
    for f in (lexical.useful_words, lexical.attested_vocabulary, lexical.citation_anchors):
        assert "collect_set" not in plan_of(f(spark, data))
    assert not re.search(r"min\(named_struct|partial_min\(struct", plan_of(lexical.proper_names(spark, data)))
    assert not re.search(r"hashpartitioning\(doc_id#\d+L, lemma", plan_of(lexical.first_occurrences(spark, data)))
    assert not re.search(r"hashpartitioning\(doc_id#\d+L, lemma|hashpartitioning\(lang#\d+, lemma#\d+, \d+\).*\n.*doc_id", plan_of(lexical.lexical_profile(spark, data)))
    assert "Exchange" not in plan_of(blocks.repeated_phrases(spark, data))
