"""Redaction rules over batches of texts.

Searching literals is far cheaper than any rule, so each text is searched for the literals of
all rules first; a rule then runs only on the spans around its literals that can hold a match,
never on the whole text. The module is pickled by value, so executors need no copy of the package.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Step:
    """A rule in Python's syntax, the literals a match needs, and what a match cannot leave.

    ``span``: ``token`` (no white space inside a match), ``line`` (no line end inside), ``start`` (a literal stands at most
    ``back`` characters behind the start of a match), ``text`` (anything). A match may begin one character before its span.
    """

    category: str
    pattern: str
    replacement: str
    ignore_case: bool
    needs: tuple[str, ...]
    span: str
    back: int = 0


@dataclass(frozen=True)
class Shape:
    """What else a scan needs to know: white space, and how random tokens look."""

    space: str
    control: str
    token: str
    not_secret: str
    bits: float
    mark: str


_UPPER = {c: c + 32 for c in range(65, 91)}


class View:
    """A text and what is computed from it once, when it is first needed."""

    __slots__ = ("text", "_low", "_gaps")

    def __init__(self, text: str):
        self.text, self._low, self._gaps = text, None, {}

    @property
    def low(self) -> str:
        """Lower case, character by character; may fold more than ASCII, which only adds candidates."""
        if self._low is None:
            low = self.text.lower()
            self._low = low if len(low) == len(self.text) else self.text.translate(_UPPER)
        return self._low

    def gaps(self, between: re.Pattern) -> list[int]:
        """Places of the characters that end a span."""
        if between not in self._gaps:
            self._gaps[between] = [m.start() for m in between.finditer(self.text)]
        return self._gaps[between]


class Scanner:
    """A chain of rules. One is made for each batch; Python keeps the compiled patterns."""

    def __init__(self, steps: tuple[Step, ...], shape: Shape):
        self.steps = [(s, re.compile(s.pattern, re.ASCII | (re.IGNORECASE if s.ignore_case else 0))) for s in steps]
        self.between = {"token": re.compile(f"[{shape.space}]"), "line": re.compile(r"[\r\n]")}
        self.shape, self.token = shape, re.compile(shape.token, re.ASCII)
        self.control, self.not_secret = re.compile(f"[{shape.control}]"), re.compile(shape.not_secret, re.ASCII | re.IGNORECASE)
        self.edges = re.compile(f"^[{shape.space}]+|[{shape.space}]+\\Z")

    def _spans(self, view: View, step: Step) -> list[tuple[int, int]]:
        hay, gaps, size = view.low if step.ignore_case else view.text, None, len(view.text)
        found = set()
        for literal in step.needs:
            at = hay.find(literal)
            while at >= 0:
                if gaps is None:
                    gaps = view.gaps(self.between[step.span])
                i = bisect_left(gaps, at)
                found.add(i)
                if i == len(gaps):
                    break
                at = hay.find(literal, gaps[i])
        return [(max(gaps[i - 1], 0) if i else 0, gaps[i] if i < len(gaps) else size) for i in sorted(found)]

    def matches(self, view: View, step: Step, rule: re.Pattern) -> Iterator[re.Match]:
        """The matches a search of the whole text from the left would give."""
        if step.span in self.between:
            for start, end in self._spans(view, step):
                yield from rule.finditer(view.text, start, end)
            return
        hay = view.low if step.ignore_case else view.text
        if step.span == "text":
            at = min((p for p in map(hay.find, step.needs) if p >= 0), default=-1)
            if at >= 0:
                yield from rule.finditer(view.text, at)
            return
        hits, done = set(), 0
        for literal in step.needs:
            at = hay.find(literal)
            while at >= 0:
                hits.add(at)
                at = hay.find(literal, at + 1)
        for hit in sorted(hits):
            for start in range(max(done, hit - step.back), hit + 1):
                m = rule.match(view.text, start)
                if m:
                    done = m.end()
                    yield m
                    break

    def replaced(self, text: str, counts: list[int] | None = None) -> str:
        """The rules one after the other, each on what the ones before left."""
        view = View(text)
        for i, (step, rule) in enumerate(self.steps):
            parts, done = [], 0
            for m in self.matches(view, step, rule):
                lead = (m[1] or "") if "$1" in step.replacement else ""
                parts += [view.text[done : m.start()], step.replacement.replace("$1", lead)]
                done = m.end()
                if counts is not None:
                    counts[i] += 1
            if parts:
                view = View("".join(parts) + view.text[done:])
        return view.text

    def categories(self, text: str) -> list[str]:
        """Sorted categories of the rules that match the text as it is."""
        view, found = View(text), set()
        for step, rule in self.steps:
            if step.category not in found and next(self.matches(view, step, rule), None):
                found.add(step.category)
        return sorted(found)

    def any(self, text: str) -> bool:
        view = View(text)
        return any(next(self.matches(view, step, rule), None) for step, rule in self.steps)

    def looks_random(self, token: str) -> bool:
        if self.not_secret.match(token) or "REDACTED" in token or not re.search("[A-Za-z]", token) or not re.search("[0-9]", token):
            return False
        shares = [n / len(token) for n in Counter(token).values()]
        return -sum(p * math.log2(p) for p in shares) >= self.shape.bits

    def without_random(self, text: str) -> tuple[str, int]:
        """Random-looking tokens replaced, and how many; only long runs without white space are looked at."""
        if len(text) < 32:
            return text, 0
        view = View(text)
        gaps = view.gaps(self.between["token"])
        parts, done, n, start = [], 0, 0, 0
        for end in [*gaps, len(text)]:
            if end - start >= 32:
                for m in self.token.finditer(text, max(start - 1, 0), end):
                    if self.looks_random(m[0]):
                        parts += [text[done : m.start()], self.shape.mark]
                        done, n = m.end(), n + 1
            start = end + 1
        return ("".join(parts) + text[done:], n) if n else (text, 0)

    def shown(self, text: str) -> tuple[str, int]:
        """Without control characters and outer white space, and how many control characters there were."""
        text, n = self.control.subn("", text)
        return self.edges.sub("", text), n


def composed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def cut(text: str, limit: int) -> str:
    return text[: max(0, limit - 1)] + "…" if len(text) > limit else text


SLICE = 256  # texts that are Python strings at a time


def _in_slices(function, texts: pa.Array, kind: pa.DataType, fixed: dict) -> pa.Array:
    """``function`` of an Arrow batch, a few texts at a time: only their strings and results are Python objects at once."""
    parts = []
    for start in range(0, len(texts), SLICE):
        found = function(pd.Series(texts.slice(start, SLICE).to_pylist(), dtype=object), **fixed)
        if isinstance(found, pd.DataFrame):
            fields = [kind.field(i) for i in range(kind.num_fields)]
            parts.append(pa.StructArray.from_arrays([pa.array(found[f.name].tolist(), f.type) for f in fields], fields=fields))
        else:
            parts.append(pa.array(found.tolist(), kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def column_of(function, kind: pa.DataType, **fixed):
    """``function`` of a batch of texts with its other arguments set, as Spark takes it; ``kind``: the type of what it gives."""

    def run(texts: pa.Array) -> pa.Array:
        return _in_slices(function, texts, kind, fixed)

    return run


def categories(texts: pd.Series, steps: tuple[Step, ...], shape: Shape) -> pd.Series:
    scan = Scanner(steps, shape)
    return texts.map(lambda t: [] if t is None else scan.categories(t))


def any_match(texts: pd.Series, steps: tuple[Step, ...], shape: Shape) -> pd.Series:
    scan = Scanner(steps, shape)
    return texts.map(lambda t: None if t is None else scan.any(t))


def metadata(texts: pd.Series, steps: tuple[Step, ...], shape: Shape, limit: int) -> pd.DataFrame:
    """clean, truncated and counts (one per rule, then random tokens and control characters) of whole texts."""
    scan = Scanner(steps, shape)

    def one(text: str | None) -> tuple:
        counts = [0] * (len(steps) + 2)
        if text is None:
            return None, None, counts
        left, counts[-2] = scan.without_random(scan.replaced(composed(text), counts))
        shown, counts[-1] = scan.shown(left)
        return cut(shown, limit) if shown else "unknown", len(shown) > limit, counts

    return pd.DataFrame([one(t) for t in texts], columns=["clean", "truncated", "counts"])


def excerpt(texts: pd.Series, secrets: tuple[Step, ...], locations: tuple[Step, ...], shape: Shape, limit: int) -> pd.Series:
    """Conversation text for an excerpt: none where a known secret occurs, locations replaced."""
    known, places = Scanner(secrets, shape), Scanner(locations, shape)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        text = composed(text)
        if known.any(text):
            return None
        return cut(places.shown(places.replaced(known.without_random(text)[0]))[0], limit) or None

    return texts.map(one)
