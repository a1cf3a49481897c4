"""BPE encoding and decoding by one pass over prefixes, for vocabularies with word ends.

A pre-token of n bytes is a string of n symbols: its bytes, of which the last carries the word end. Its encoding by merges has one
property that makes the search for merges needless: every prefix has exactly one encoding, hence one last token, and that token is the
only one that (1) ends at the prefix's end and (2) is compatible with the last token of the prefix it leaves. So ``last[i]`` is found
from left to right:

* an Aho-Corasick automaton over all tokens walks the pre-token once; its suffix links list the tokens that end at each position;
* two tokens are compatible when merging their joined strings gives back the two. Merges go by rank. On the way to token a its rightmost
  symbol is in turn each of the right parts of a, from a byte up to a itself, each until the merge that takes it; b's leftmost likewise. The two
  are apart for ever unless some pair of such parts has a merge that comes while both stand there: before the left part is
  taken (a merge of the same rank to the left comes first) and not after the right part is.

Following ``last`` back from the end gives the ids. A token that merging its own string does not give can stand nowhere, and is left out.

Texts are cut as the tokenizers library cuts them: strings of special tokens first, then its normalisation, then its pattern. On code
points below ``COMMON`` the Unicode tables of the library and of Python's modules agree (a test compares them all): there a composed text is
normalised by lower-casing (white space is no part of a pre-token) and cut by the regex module; the library itself does both beyond, and for
capital sigma, whose small form depends on its place in Python. Decoding writes tokens with a blank between, which is what decode
does where a file names no decoder.

A worker keeps the encodings of the last pre-tokens it has seen, at most twice ``remember``. Texts are gone through in segments of about a
megabyte that end at a blank, and their digests grow with them, so that memory is bounded by a text itself and its longest pre-token.

Defined results: null and empty texts have no tokens and the digests of nothing; repeated rows and rows with a null doc_id are encoded
like others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import byte_letters

COMMON = 0x558
SEGMENT = 1 << 20
NEVER = 1 << 60
BLANK = re.compile("[\t-\r ]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """A vocabulary with its merges: which tokens end where, and which may follow each other."""

    def __init__(self, spec: dict, remember: int = 1_000_000):
        import ahocorasick

        model = spec["model"]
        ending, letters = model["end_of_word_suffix"], byte_letters()
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.allowed: dict[int, bool] = {}
        self.remember = remember
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made, a, b = self.ids[left + right], self.ids[left], self.ids[right]
            if made in parts:
                raise ValueError(f"two merges make {left + right!r}")
            self.rank[a, b], parts[made] = rank, (rank, a, b)
        # what stands at a token's end (its start) on the way to it, and the rank of the merge that takes it
        self.right_edge = {t: self._edge(t, parts, 2) for t in self.names}
        self.left_edge = {t: self._edge(t, parts, 1) for t in self.names}
        whole = set(self.names) - set(parts)
        for made, (rank, a, b) in parts.items():  # in the order of ranks
            if a in whole and b in whole and self._first_meeting(a, b) == rank:
                whole.add(made)
        self.automaton = ahocorasick.Automaton()
        for t in whole:
            name = self.names[t]
            last = name.endswith(ending) and name != ending
            raw = [letters[c] for c in (name[: -len(ending)] if last else name)]
            symbols = "".join(map(chr, raw[:-1])) + chr(raw[-1] + 256 * last)
            self.automaton.add_word(symbols, (len(symbols), t))
        self.automaton.make_automaton()

    @staticmethod
    def _edge(token: int, parts: dict, side: int) -> list[tuple[int, int]]:
        edge, until = [], NEVER
        while True:
            edge.append((token, until))
            if token not in parts:
                return edge
            until, token = parts[token][0], parts[token][side]

    def _first_meeting(self, a: int, b: int) -> int:
        """The rank of the first merge across the border of a and b, NEVER if there is none."""
        first = NEVER
        for x, until_x in self.right_edge[a]:
            for y, until_y in self.left_edge[b]:
                rank = self.rank.get((x, y), NEVER)
                if rank < until_x and rank <= until_y:
                    first = min(first, rank)
        return first

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.allowed.get(key)
        if known is None:
            if len(self.allowed) >= self.remember:
                self.allowed.clear()
            known = self.allowed[key] = self._first_meeting(a, b) == NEVER
        return known

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token, not empty."""
        symbols = word[:-1].decode("latin-1") + chr(256 + word[-1])
        size, known = len(symbols), self.allowed.get
        # small lists are the quicker ones, arrays the smaller ones
        last, length = ([-1] * (size + 1), [0] * (size + 1)) if size < 1000 else (array("i", [-1]) * (size + 1), array("i", [0]) * (size + 1))
        for at, (k, token) in self.automaton.iter(symbols):
            end = at + 1
            if last[end] < 0:
                before = last[end - k]
                if k < end:
                    if before < 0:
                        continue
                    fits = known(before << 32 | token)
                    if not (self.compatible(before, token) if fits is None else fits):
                        continue
                last[end], length[end] = token, k
        out, end = [], size
        while end:
            if last[end] < 0:
                raise ValueError(f"no encoding of {word!r}")
            out.append(last[end])
            end -= length[end]
        return out[::-1]


class WordEncoder:
    """Texts to ids and back, as a tokenizers file states."""

    def __init__(self, path: str, remember: int = 200_000):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.pre_tokenise = library.pre_tokenizer.pre_tokenize_str
        self.letters = byte_letters()
        (pattern,) = (p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern).findall
        self.beyond = re.compile(f"[^\\x00-{chr(COMMON - 1)}]").search
        # code points whose small form lies beyond or depends on their neighbours
        moving = "".join(c for c in map(chr, range(128, COMMON)) if c == "\u03a3" or max(map(ord, c.lower())) >= COMMON)
        self.uncommon = re.compile(f"[^\\x00-{chr(COMMON - 1)}]|[{moving}]").search
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.merges = Merges(spec)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.remember = remember

    def words(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text without special tokens, segment by segment."""
        start = 0
        while start < len(text):
            blank = BLANK.search(text, start + SEGMENT) if len(text) - start > SEGMENT else None
            end = blank.start() if blank else len(text)
            part, start = text[start:end], end
            if not self.uncommon(part) and is_normalized("NFC", part):
                yield self.find(part.lower())
            elif not self.beyond(part := self.normalise(part)):
                yield self.find(part)
            else:
                yield [bytes(map(self.letters.__getitem__, w)).decode("utf-8") for w, _ in self.pre_tokenise(part)]

    def _learn(self, word: str) -> tuple[bytes, bytes]:
        out = self.older.get(word)
        if out is None:
            ids = self.merges.encode(word.encode("utf-8"))
            out = " ".join(map(str, ids)).encode(), " ".join(map(self.merges.names.__getitem__, ids)).encode()
        if len(self.known) >= self.remember:
            self.known, self.older = {}, self.known
        self.known[word] = out
        return out

    def pieces(self, text: str) -> Iterator[list[tuple[bytes, bytes]]]:
        """(ids, names) of each pre-token or special token, with blanks between; some at a time."""
        start = 0
        for found in [*(self.cut.finditer(text) if self.cut else ()), None]:
            for words in self.words(text[start : found.start()] if found else text[start:]):
                part = list(map(self.known.get, words))
                if None in part:
                    part = [p or self._learn(w) for p, w in zip(part, words, strict=True)]
                yield part
            if found:
                start = found.end()
                yield [(b"%d" % self.special[found[0]], found[0].encode())]

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids and of what they decode to."""
        count, gap, ids, names = 0, b"", hashlib.sha256(), hashlib.sha256()
        for part in self.pieces(text):
            if part:
                numbers, decoded = map(b" ".join, zip(*part, strict=True))
                count += numbers.count(b" ") + 1
                ids.update(gap + numbers)
                names.update(gap + decoded)
                gap = b" "
        return count, ids.hexdigest(), names.hexdigest()

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.pieces(text) for ids, _ in part for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        special = {i: t for t, i in self.special.items()}
        return " ".join(special.get(i) or self.merges.names[i] for i in ids)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One a worker process: the automaton is built once."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _mapped(docs: DataFrame, vocabulary: str | None, schema: str, row) -> DataFrame:
    path = vocabulary or default_vocabulary()
    fields = [f.name for f in docs.sparkSession.createDataFrame([], schema).schema][1:]

    def make():
        encode, kinds = encoder(path), [{"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}.get(f, pa.string()) for f in fields]

        def run(batches):
            for b in batches:
                # few whole texts at a time
                for low in range(0, b.num_rows, 200):
                    part = b.slice(low, 200)
                    rows = [row(encode, t.as_py() or "") for t in part.column(1)]
                    columns = zip(*rows, strict=True)
                    yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *fields])

        return run

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, make)


def encode_texts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids, decoded."""

    def row(encode: WordEncoder, text: str):
        ids = encode.encode(text)
        return len(ids), ids, encode.decode(ids)

    return _mapped(docs, vocabulary, "doc_id long, n_tokens long, ids array<int>, decoded string", row)


def digest_texts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256: encode_texts without its long columns."""
    return _mapped(docs, vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", WordEncoder.digests)


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_texts(common.table(spark, sf_dir, "documents"))
