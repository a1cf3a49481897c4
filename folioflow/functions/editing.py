"""Edits of text that SQL has no form for: diffs, spans, clauses, display titles. Plain functions and their Arrow-batched columns."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s+|\w+|[^\w\s]")


def word_diff(old: str, new: str, shortest: int = 2) -> list[tuple[str, str]]:
    """(equal, delete or insert; text) pieces over tokens; equal runs of fewer than `shortest` words between changes join them."""
    a, b = TOKEN.findall(old), TOKEN.findall(new)
    parts: list[list[str]] = []
    steps = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    for n, (op, i, j, k, m) in enumerate(steps):
        same = "".join(a[i:j])
        short = op == "equal" and 0 < n < len(steps) - 1 and len(same.split()) < shortest
        if op == "equal" and not short:
            parts.append(["equal", same, same])
        elif parts and parts[-1][0] == "change":
            parts[-1][1] += same
            parts[-1][2] += "".join(b[k:m])
        else:
            parts.append(["change", same, "".join(b[k:m])])
    out = []
    for op, gone, came in parts:
        out += [("equal", gone)] if op == "equal" else [(o, t) for o, t in (("delete", gone), ("insert", came)) if t]
    return out


def change_ratio(old: str, new: str) -> float:
    """Share of words that changed."""
    a, b = old.split(), new.split()
    return 1 - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def replacement_span(text: str, start: int, stop: int, new: str) -> tuple[int, int, str]:
    """The span grown over neighbouring words that the replacement repeats at its ends, so that they don't come twice."""
    words = new.split()
    before, after = text[:start].split(), text[stop:].split()
    key = lambda w: w.strip(".,;:!?\"'“”").casefold()
    for n in range(min(len(words), len(before)), 0, -1):
        if [key(w) for w in words[:n]] == [key(w) for w in before[-n:]]:
            start = len(text[:start].rstrip()) - len(" ".join(before[-n:]))
            break
    for n in range(min(len(words), len(after)), 0, -1):
        if [key(w) for w in words[-n:]] == [key(w) for w in after[:n]]:
            stop += re.match(r"\s*" + r"\s+".join(map(re.escape, after[:n])), text[stop:]).end()
            if after[n - 1] != words[-1] and not words[-1][-1:] in ".,;:!?":
                new += after[n - 1][len(after[n - 1].rstrip(".,;:!?")) :]
            break
    return max(0, start), stop, new


def locate(text: str, quote: str) -> tuple[int, int] | None:
    """Where a quote stands: as it is, else whatever the blanks and the case, else by its words with any marks between."""
    at = text.find(quote)
    if at >= 0 and quote:
        return at, at + len(quote)
    fold = lambda c: c.lower() if len(c.lower()) == 1 else c
    places = [i for i, c in enumerate(text) if not c.isspace()]
    wanted = "".join(fold(c) for c in quote if not c.isspace())
    if not wanted:
        return None
    at = "".join(fold(text[i]) for i in places).find(wanted)
    if at >= 0:
        return places[at], places[at + len(wanted) - 1] + 1
    words = re.findall(r"\w+", quote)
    m = re.search(r"[\W_]+".join(map(re.escape, words)), text, re.I) if words else None
    return m.span() if m else None


def sentence_bounds(text: str, start: int, stop: int) -> tuple[int, int]:
    """From after the last sentence end before the span to after the first one behind it."""
    ends = [m.end() for m in re.finditer(r"[.!?] |\.\n", text[:start])]
    after = re.search(r"[.!?](?= |\n|$)", text[max(stop - 1, 0) :])
    return ends[-1] if ends else 0, max(stop - 1, 0) + after.end() if after else len(text)


def clauses(text: str) -> list[tuple[int, int]]:
    """Spans cut behind ; : , and dashes, with two words or more on each side for ; and four for the others."""
    cuts, last = [], 0
    for m in re.finditer(r"[;:,]\s|\s?(?:—|--)\s?", text):
        need = 2 if m.group().strip() == ";" else 4
        if len(text[last : m.end()].split()) >= need and len(text[m.end() :].split()) >= need:
            cuts.append((last, m.end()))
            last = m.end()
    return [*cuts, (last, len(text))] if text else []


def display_title(title: str, names: dict[str, str]) -> str:
    """A shouted title in sentence case, with the book's own names as it writes them."""
    if title != title.upper() or title == title.lower():
        return title
    words = [names.get(w.lower(), w.lower()) for w in title.split()]
    text = " ".join(words)
    return text[:1].upper() + text[1:]


def fitted(text: str, limit: int) -> list[tuple[int, str]]:
    """Exact slices of at most `limit` characters, cut at sentence ends; a sentence over the limit is an error."""
    out, start = [], 0
    ends = [m.end() for m in re.finditer(r"[.!?…]+\s+", text)] + [len(text)]
    last = 0
    for end in ends:
        if end - start > limit:
            if last == start:
                raise ValueError("a sentence is longer than the limit")
            out.append((start, text[start:last]))
            start = last
            if end - start > limit:
                raise ValueError("a sentence is longer than the limit")
        last = end
    return [*out, (start, text[start:])] if text else []


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def without(value: object, key: str) -> object:
    """A nested value without one key, wherever it stands."""
    if isinstance(value, dict):
        return {k: without(v, key) for k, v in value.items() if k != key}
    return [without(v, key) for v in value] if isinstance(value, list) else value


def spec_identity(spec: dict, price_key: str = "pricing_per_million") -> str:
    """Digest of a specification that a change of prices alone leaves as it is."""
    return hashlib.sha256(canonical_json(without(spec, price_key)).encode()).hexdigest()


def natural_uuid(*parts: object) -> str:
    """A key that is the same whenever it is made: digest of the natural key's parts, each ended by NUL."""
    h = hashlib.sha256("".join(f"{p}\0" for p in parts).encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def column(f: Callable, kind: str) -> Callable[..., Column]:
    """A plain function of strings as a column, batched by Arrow; null in, null out."""

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*series, strict=True)], dtype=object)

    return run
