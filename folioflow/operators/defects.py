"""Defects that frequencies reveal: words split by a blank, broken by a hyphen, or parted from their first letter.

Only candidates ask for frequencies: the distinct words and pairs that they name meet the corpus' counts, so that neither a table of all words nor
one of all pairs is made for a handful of findings; an edition's own words are counted for the candidates that are left then.

The given texts are clean, so ``worn`` plants one defect a block in three blocks of four; frequencies are those of the texts as given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import Registry
from ..session import materialise
from .blocks import BLOCKS, blocks
from .lexical import word_pairs

R = Registry()

# Limits on the Zipf scale, on letters, and how sure a finding is.
KNOWN, NO_WORD, RARE_WORD, FRAGMENT, RARITY = 3.0, 2.5, 4.2, 3, 1.0
SURE, MOST_SURE, ATTESTED = 0.7, 0.98, 2

_SECOND = r"^([^\p{L}]*\p{L}+ +)(\p{L}{3})(\p{L}{3,})"
_FIRST = r"^(\p{Lu})(\p{Ll}{3,})"


def worn(b: DataFrame) -> DataFrame:
    """Blocks with a defect planted: by document and place the second word broken or split after three letters, or the first letter set apart."""
    kind = F.pmod(F.col("doc_id") + F.col("pos"), F.lit(4))
    text = F.when(kind == 1, F.regexp_replace("text", _SECOND, "$1$2- $3")).when(kind == 2, F.regexp_replace("text", _SECOND, "$1$2 $3")).when(kind == 3, F.regexp_replace("text", _FIRST, "$1 $2"))
    return b.withColumn("text", text.otherwise(F.col("text")))


def zipf(n: Column, total: Column) -> Column:
    """A count on the Zipf scale; 0 for what was never seen."""
    return F.when(n > 0, F.log10(F.lit(1e9) * n / total)).otherwise(0.0)


#: Rows of a written table up to which it is sent to every task, and of one that is a number a row. Larger ones are joined as the planner sees fit.
SENT, SENT_NUMBERS = 1 << 20, 1 << 22


def sent(written: DataFrame, most: int = SENT) -> DataFrame:
    return F.broadcast(written) if written.count() <= most else written


def word_counts(b: DataFrame) -> DataFrame:
    """(lang, word, n), written: how often each word, in lower case, stands in blocks b. All frequencies of words and all totals come from it."""
    words = b.select("lang", F.explode(T.words(F.col("text"))).alias("word")).select("lang", F.lower("word").alias("word"))
    return materialise(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")


def totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang").agg(F.sum("n").alias("total"))


def frequencies(counts: DataFrame) -> DataFrame:
    """(lang, word, z): counted words on the Zipf scale. Words without a language have none."""
    return counts.join(totals(counts), "lang").select("lang", "word", zipf(F.col("n"), F.col("total")).alias("z"))


def asked_frequencies(b: DataFrame, found: DataFrame, terms: dict[str, tuple[str, ...]], counts: DataFrame | None = None) -> DataFrame:
    """found(lang, ...) plus a column for each of terms: the frequency of its columns' values, one word or two neighbouring ones, in blocks b,
    whose word_counts are counts."""
    counts = word_counts(b) if counts is None else counts
    found = materialise(found, "asked")  # it is met once for each term
    for size in (1, 2):
        named = {k: v for k, v in terms.items() if len(v) == size}
        if not named:
            continue
        parts = [f"w{i}" for i in range(size)]
        if size == 1:
            known = frequencies(counts).withColumnRenamed("word", "w0")
        else:
            each = F.array(*[F.struct(*[F.col(c).alias(p) for c, p in zip(columns, parts, strict=True)]) for columns in named.values()])
            asked = found.select("lang", F.explode(each).alias("t")).select("lang", "t.*").distinct().withColumn("h", F.xxhash64("lang", *parts))
            asked = materialise(asked, "pairs")
            two = F.arrays_zip(F.col("words").alias("w0"), F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))).alias("w1"))
            there = b.select("lang", T.words(F.col("text")).alias("words")).select("lang", F.explode(two).alias("p")).select("lang", *[F.lower(f"p.{p}").alias(p) for p in parts]).filter("w1 is not null")
            # by a number first, so that pairs nobody asks for are dropped where they are read
            there = there.withColumn("h", F.xxhash64("lang", *parts)).join(sent(asked.select("h"), SENT_NUMBERS), "h", "left_semi").drop("h")
            there = there.join(asked.drop("h"), ["lang", *parts], "left_semi").groupBy("lang", *parts).agg(F.count(F.lit(1)).alias("n"))
            known = there.join(totals(counts), "lang").select("lang", *parts, zipf(F.col("n"), F.col("total")).alias("z"))
        for name, columns in named.items():
            mine = known.select("lang", *[F.col(p).alias(c) for c, p in zip(columns, parts, strict=True)], F.col("z").alias(name))
            found = found.join(mine, ["lang", *columns], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return found


def asked_counts(w: DataFrame, found: DataFrame, terms: dict[str, str], exact: bool = False) -> DataFrame:
    """found(doc_id, ...) plus a column for each of terms: how often its column's value stands among the words of that document. Texts and
    asked words are dealt out by document together, so that words are counted where they lie."""
    found = materialise(found, "counted")
    asked = found.select("doc_id", F.array_distinct(F.array(*terms.values())).alias("words"))
    documents = materialise(asked.select("doc_id").distinct(), "editions")
    near = w.select("doc_id", "text")
    near = near.join(F.broadcast(documents), "doc_id", "left_semi") if documents.count() <= SENT else near
    dealt = near.withColumn("words", F.lit(None).cast("array<string>")).unionByName(asked.withColumn("text", F.lit(None).cast("string"))).repartition("doc_id")
    word = F.when(F.col("text").isNull(), F.col("word")).otherwise(F.col("word") if exact else F.lower("word"))
    words = dealt.select("doc_id", "text", F.explode(F.coalesce("words", T.words(F.col("text")))).alias("word")).select("doc_id", word.alias("word"), F.col("text").isNull().alias("asks"))
    counted = words.groupBy("doc_id", "word").agg(F.count_if(~F.col("asks")).alias("n"), F.max(F.col("asks")).alias("asks")).filter("asks and n > 0").drop("asks")
    counted = materialise(counted, "seen")
    for name, column in terms.items():
        found = found.join(counted.withColumnsRenamed({"word": column, "n": name}), ["doc_id", column], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return found


_WORN = (
    BLOCKS
    + rf""",
worn AS MATERIALIZED (SELECT * REPLACE (CASE (doc_id + pos) % 4 WHEN 1 THEN regexp_replace(text, '{_SECOND}', '\1\2- \3') WHEN 2 THEN regexp_replace(text, '{_SECOND}', '\1\2 \3') WHEN 3 THEN regexp_replace(text, '{_FIRST}', '\1 \2') ELSE text END AS text) FROM blocks),
given AS MATERIALIZED (SELECT doc_id, lang, pos, list_transform(regexp_extract_all(text, '\p{{L}}+'), lambda w: lower(w)) AS w FROM blocks),
totals AS MATERIALIZED (SELECT lang, sum(len(w)) AS total FROM given GROUP BY lang),
zipf AS MATERIALIZED (SELECT lang, lemma, log10(1e9 * count(*) / any_value(total)) AS z FROM (SELECT lang, unnest(w) AS lemma FROM given) JOIN totals USING (lang) GROUP BY lang, lemma),
zipf2 AS MATERIALIZED (SELECT lang, lemma, log10(1e9 * count(*) / any_value(total)) AS z FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS lemma FROM given) JOIN totals USING (lang) GROUP BY lang, lemma),
seen AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\p{{L}}+')) AS word FROM worn) GROUP BY ALL),
folded AS MATERIALIZED (SELECT doc_id, lower(word) AS word, sum(n) AS n FROM seen GROUP BY ALL),
cuts AS (SELECT doc_id, lang, pos, unnest(regexp_extract_all(text, '\p{{L}}+|[^\p{{L}}]+')) AS piece, generate_subscripts(regexp_extract_all(text, '\p{{L}}+|[^\p{{L}}]+'), 1) - 1 AS i FROM worn),
five AS (SELECT doc_id, lang, pos, i, lag(piece) OVER w AS before, piece AS a, lead(piece) OVER w AS gap, lead(piece, 2) OVER w AS b, lead(piece, 3) OVER w AS after FROM cuts WINDOW w AS (PARTITION BY doc_id, pos ORDER BY i)),
two AS MATERIALIZED (SELECT *, lower(a) AS l, lower(b) AS r, lower(a || b) AS j FROM five WHERE regexp_matches(a, '^\p{{L}}{{2,}}$') AND length(b) >= 2 AND NOT regexp_matches(coalesce(before, ''), '[\p{{N}}_]$') AND NOT regexp_matches(coalesce(after, ''), '^[\p{{N}}_]'))"""
)
_RATED = """SELECT t.*, coalesce(zj.z, 0) AS zj, coalesce(zl.z, 0) AS zl, coalesce(zr.z, 0) AS zr FROM t LEFT JOIN zipf zj ON zj.lang = t.lang AND zj.lemma = t.j LEFT JOIN zipf zl ON zl.lang = t.lang AND zl.lemma = t.l LEFT JOIN zipf zr ON zr.lang = t.lang AND zr.lemma = t.r"""
_SPLIT = rf"""WITH {_WORN}, t AS MATERIALIZED (SELECT * FROM two WHERE regexp_matches(gap, '^[ \t]+$') AND least(length(a), length(b)) <= 3), x AS ({_RATED}),
y AS (SELECT x.*, coalesce(nj.n, 0) AS nj, coalesce(nl.n, 0) AS nl, coalesce(nr.n, 0) AS nr FROM x LEFT JOIN folded nj ON nj.doc_id = x.doc_id AND nj.word = x.j LEFT JOIN folded nl ON nl.doc_id = x.doc_id AND nl.word = x.l LEFT JOIN folded nr ON nr.doc_id = x.doc_id AND nr.word = x.r WHERE zj >= 3),
f AS (SELECT *, least(CASE WHEN length(a) <= 3 AND (zl < 2.5 OR (zl < 4.2 AND @left)) THEN zl END, CASE WHEN length(b) <= 3 AND (zr < 2.5 OR (zr < 4.2 AND @right)) THEN zr END) AS z FROM y)"""


def joined_pairs(w: DataFrame, known: DataFrame, gap: str, short: int | None = None) -> DataFrame:
    """Pairs of words in blocks w whose joined spelling is among known(lang, word, z): (doc_id, lang, pos, i, left, right, l, r, j, z_joined)."""
    p = word_pairs(w.select("doc_id", "lang", "pos", "text"), gap, short).withColumn("j", F.coalesce(F.lower(F.regexp_replace("pair", r"[^\p{L}]+", "")), F.lit("")))  # never null: no filter works it out twice
    p = p.join(sent(known).withColumnsRenamed({"word": "j", "z": "z_joined"}), ["lang", "j"])
    p = p.withColumn("left", F.regexp_substr("pair", F.lit(r"^\p{L}+"))).withColumn("right", F.regexp_substr("pair", F.lit(r"\p{L}+$"))).drop("pair")
    return p.withColumn("l", F.lower("left")).withColumn("r", F.lower("right"))


def split_candidates(b: DataFrame, w: DataFrame) -> DataFrame:
    """Neighbouring words with blanks between, one of them short, whose joined spelling is known, with the frequencies of the joined word
    and of short halves, the others' being 0. Known words are a millionth of all words each and short ones have few letters: both are
    tables that hardly grow with the texts, and pairs meet them where they are read."""
    z = frequencies(word_counts(b))
    p = joined_pairs(w, materialise(z.filter(F.col("z") >= KNOWN), "known"), r"[ \t]+", FRAGMENT)
    # the one letter that is longer in lower case gains a dot above
    short = materialise(z.filter(F.length(F.replace("word", F.lit("\u0307"), F.lit(""))) <= FRAGMENT), "short")
    for side, key in (("left", "l"), ("right", "r")):
        p = p.join(sent(short).withColumnsRenamed({"word": key, "z": f"z_{side}"}), ["lang", key], "left").withColumn(f"z_{side}", F.coalesce(f"z_{side}", F.lit(0.0)))
    low = lambda side: F.when((F.length(side) <= FRAGMENT) & (F.col(f"z_{side}") < RARE_WORD), F.col(f"z_{side}"))
    return p.filter(F.col("z_joined") - F.least(low("left"), low("right")) >= RARITY)


def rarest(vouched: Column, others: dict[str, Column]) -> Column:
    """The frequency of the rarer half that is a fragment, null where none is."""
    half = lambda side: F.when((F.length(side) <= FRAGMENT) & ((F.col(f"z_{side}") < NO_WORD) | ((F.col(f"z_{side}") < RARE_WORD) & vouched & others[side])), F.col(f"z_{side}"))
    return F.least(half("left"), half("right"))


@R.query("", _SPLIT.replace("@left", "true").replace("@right", "true") + """ SELECT doc_id, pos, i::INT AS i, a || b AS suggested, round(least(0.9, 0.6 + (zj - z - 1) * 0.1), 6) AS confidence FROM f WHERE zj - z >= 1""")
def split_words(spark, sf_dir):
    """Two words that are one word split by a blank, by frequencies alone: looser than TXT-15, which attested_split_words has."""
    b = blocks(spark, sf_dir)
    yes = F.lit(True)
    f = split_candidates(b, worn(b)).withColumn("rarity", F.col("z_joined") - rarest(yes, {"left": yes, "right": yes})).filter(F.col("rarity") >= RARITY)
    return f.select("doc_id", "pos", "i", F.concat("left", "right").alias("suggested"), F.round(F.least(F.lit(0.9), 0.6 + (F.col("rarity") - 1) * 0.1), 6).alias("confidence"))


@R.query("TXT-15", _SPLIT.replace("@left", "nj >= 2 AND nl = 1").replace("@right", "nj >= 2 AND nr = 1") + """ SELECT doc_id, pos, i::INT AS i, a || b AS suggested, round(least(0.98, least(0.9, 0.6 + (zj - z - 1) * 0.1) + CASE WHEN nj >= 2 THEN 0.08 ELSE 0 END), 6) AS confidence FROM f WHERE zj - z >= 1""")
def attested_split_words(spark, sf_dir):
    """Two words that are one word split by a blank: a fragment of at most three letters is no word (Zipf under 2.5), or is rare (under
    4.2) and its edition vouches, where the joined word stands twice and the fragment only here."""
    b = blocks(spark, sf_dir)
    w = worn(b)
    z = asked_counts(w, split_candidates(b, w), {"n_joined": "j", "n_left": "l", "n_right": "r"})
    z = z.withColumn("rarity", F.col("z_joined") - rarest(F.col("n_joined") >= ATTESTED, {s: F.col(f"n_{s}") == 1 for s in ("left", "right")})).filter(F.col("rarity") >= RARITY)
    sure = F.least(F.lit(0.9), 0.6 + (F.col("rarity") - 1) * 0.1) + F.when(F.col("n_joined") >= ATTESTED, 0.08).otherwise(0.0)
    return z.select("doc_id", "pos", "i", F.concat("left", "right").alias("suggested"), F.round(F.least(F.lit(MOST_SURE), sure), 6).alias("confidence"))


@R.query("TXT-13", rf"""WITH {_WORN}, t AS MATERIALIZED (SELECT * FROM two WHERE regexp_matches(gap, '^-[ \t\r\n]+$')), x AS ({_RATED}), y AS (SELECT x.*, zj - coalesce(p.z, 0) AS gain FROM x LEFT JOIN zipf2 p ON p.lang = x.lang AND p.lemma = x.l || ' ' || x.r)
SELECT doc_id, pos, i::INT AS i, a || b AS suggested, round(least(0.98, 0.7 + gain / 2), 3) AS confidence FROM y WHERE zj >= 3 AND gain >= 0""")
def broken_hyphens(spark, sf_dir):
    """A word broken by a hyphen and a blank: the joined spelling is known and no rarer than the two words next to each other."""
    b = blocks(spark, sf_dir)
    counts = word_counts(b)
    known = materialise(frequencies(counts).filter(F.col("z") >= KNOWN), "known")
    p = materialise(joined_pairs(worn(b), known, r"-[ \t\r\n]+"), "hyphens")
    kinds = asked_frequencies(b, p.select("lang", "l", "r", "j", "z_joined").distinct(), {"z_pair": ("l", "r")}, counts)
    kinds = kinds.withColumn("gain", F.col("z_joined") - F.col("z_pair")).filter(F.col("gain") >= 0).select("lang", "l", "r", "j", "gain")
    z = p.join(kinds, ["lang", "l", "r", "j"])
    return z.select("doc_id", "pos", "i", F.concat("left", "right").alias("suggested"), F.round(F.least(F.lit(MOST_SURE), SURE + F.col("gain") / 2), 3).alias("confidence"))


_INITIAL = r'^["“«]?(\p{Lu})[ \t]+(\p{Ll}+)'


@R.query("TXT-14", rf"""WITH {_WORN}, t AS MATERIALIZED (SELECT *, lower(a) AS l, b AS r, lower(a || b) AS j FROM (SELECT doc_id, lang, pos, regexp_extract(text, '{_INITIAL}', 1) AS a, regexp_extract(text, '{_INITIAL}', 2) AS b FROM worn) WHERE a <> ''), x AS ({_RATED}),
y AS (SELECT x.*, zj - coalesce(p.z, 0) AS gain, coalesce(n.n, 0) AS nj FROM x LEFT JOIN zipf2 p ON p.lang = x.lang AND p.lemma = x.l || ' ' || x.r LEFT JOIN seen n ON n.doc_id = x.doc_id AND n.word = x.a || x.b)
SELECT doc_id, pos, a || b AS suggested, CASE WHEN zj >= 2 AND gain >= 0.5 THEN round(least(0.98, 0.7 + gain / 2), 3) ELSE 0.98 END AS confidence FROM y WHERE (zj >= 2 AND gain >= 0.5) OR (a NOT IN ('A', 'I') AND length(b) >= 3 AND nj >= 2 AND zr < 2)""")
def detached_initials(spark, sf_dir):
    """A block's first capital set apart from its word: by frequencies, or, for names that no table has, where the edition spells the joined word twice."""
    b = blocks(spark, sf_dir)
    w = worn(b)
    d = w.select("doc_id", "lang", "pos", F.regexp_extract("text", _INITIAL, 1).alias("left"), F.regexp_extract("text", _INITIAL, 2).alias("r")).filter("left <> ''")
    d = d.withColumn("l", F.lower("left")).withColumn("joined", F.concat("left", "r")).withColumn("j", F.lower("joined"))
    d = materialise(d, "initials")
    counts = word_counts(b)
    kinds = materialise(asked_frequencies(b, d.select("lang", "l", "r", "j").distinct(), {"z_joined": ("j",), "z_right": ("r",)}, counts), "kinds")
    # a pair's frequency is only asked for where the joined word has one
    pairs = asked_frequencies(b, kinds.filter("z_joined >= 2"), {"z_pair": ("l", "r")}, counts)
    kinds = pairs.unionByName(kinds.filter("z_joined < 2").withColumn("z_pair", F.lit(0.0)))
    z = d.join(kinds, ["lang", "l", "r", "j"], "left").fillna(0.0, ["z_joined", "z_right", "z_pair"])  # without a language there are no frequencies
    gain = F.col("z_joined") - F.col("z_pair")
    rated = (F.col("z_joined") >= 2.0) & (gain >= 0.5)
    named = ~F.col("left").isin("A", "I") & (F.length("r") >= 3) & (F.col("z_right") < 2)
    z = materialise(z.withColumn("confidence", F.when(rated, F.round(F.least(F.lit(MOST_SURE), SURE + gain / 2), 3))).filter(F.col("confidence").isNotNull() | named), "rated")
    # only names that frequencies don't settle are counted in their edition
    vouched = asked_counts(w, z.filter("confidence is null"), {"n_joined": "joined"}, exact=True).filter(F.col("n_joined") >= ATTESTED).withColumn("confidence", F.lit(MOST_SURE))
    out = ("doc_id", "pos", F.col("joined").alias("suggested"), "confidence")
    return z.filter("confidence is not null").select(*out).unionByName(vouched.select(*out))
