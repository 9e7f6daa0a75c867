"""Edit-aware token counts over per-document trees of pre-tokens."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm.base import per_batch, table

# The added token of byte_bpe_50k.json, cut out of the text before all else, and how the rest is cut into
# pre-tokens: punctuation ends where the token begins, and white space before it is whole.
ADDED = "<|endoftext|>"
_ADDED = regex.escape(ADDED)
PRETOKEN = regex.compile(rf"{_ADDED}|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!{_ADDED})[^\s\p{{L}}\p{{N}}])+|\s+(?:(?!\S)|(?={_ADDED}))|\s+")
#: Spans that a privacy edit replaces: (pattern, replacement).
EDITS = (
    (regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "<EMAIL>"),
    (regex.compile(r"https?://[^\s<>\"]+"), "<URL>"),
    (regex.compile(r"\+?\d[\d\s().-]{6,}\d"), "<NUMBER>"),
)


class Counter:
    """Number of ids of a pre-token, with a bounded cache."""

    def __init__(self, path: str, words: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.model, self.words, self.cache = Tokenizer.from_file(path).model, words, {}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = iter(range(256, 512))
        self.letters = [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]

    def __call__(self, piece: str) -> int:
        count = self.cache.get(piece)
        if count is None:
            if len(self.cache) >= self.words:
                self.cache.clear()
            count = self.cache[piece] = 1 if piece == ADDED else len(self.model.tokenize("".join([self.letters[b] for b in piece.encode("utf-8", "surrogatepass")])))
        return count


class Tree:
    """A document's pre-tokens in leaves of up to ``fan`` pieces, under a binary tree of character and token sums.

    An edit touches the leaves it overlaps and their neighbours' boundary: pre-tokens are cut anew from the start of the one
    before the edit, or the length of an added token before it, until a cut falls on an old one again; only these are encoded, the rest of the leaf is kept. Sums
    are updated along the path to the root. A leaf that grows past twice its size is split, and the tree above is
    rebuilt from the leaves' sums when the number of leaves has doubled.
    """

    def __init__(self, text: str, count: Counter, fan: int = 64) -> None:
        self.count, self.fan, self.encoded = count, fan, 0
        pieces = PRETOKEN.findall(text)
        self.leaves = [pieces[i : i + fan] for i in range(0, len(pieces), fan)] or [[]]
        self.tokens = [[count(p) for p in leaf] for leaf in self.leaves]
        self._build()

    def _build(self) -> None:
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.size = size
        self.chars_of, self.tokens_of = [0] * (2 * size), [0] * (2 * size)
        for i, (leaf, tokens) in enumerate(zip(self.leaves, self.tokens)):
            self.chars_of[size + i], self.tokens_of[size + i] = sum(map(len, leaf)), sum(tokens)
        for i in range(size - 1, 0, -1):
            self.chars_of[i] = self.chars_of[2 * i] + self.chars_of[2 * i + 1]
            self.tokens_of[i] = self.tokens_of[2 * i] + self.tokens_of[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens_of[1]

    @property
    def chars(self) -> int:
        return self.chars_of[1]

    def _update(self, leaf: int) -> None:
        i = self.size + leaf
        self.chars_of[i], self.tokens_of[i] = sum(map(len, self.leaves[leaf])), sum(self.tokens[leaf])
        while i > 1:
            i //= 2
            self.chars_of[i] = self.chars_of[2 * i] + self.chars_of[2 * i + 1]
            self.tokens_of[i] = self.tokens_of[2 * i] + self.tokens_of[2 * i + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` and the leaf's first character."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at >= start + self.chars_of[i]:
                start += self.chars_of[i]
                i += 1
        leaf = min(i - self.size, len(self.leaves) - 1)
        if leaf != i - self.size:
            start = self.chars - self.chars_of[self.size + leaf]
        return leaf, start

    def text(self) -> str:
        return "".join(map("".join, self.leaves))

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end; counts are those of the whole new text."""
        first, begin = self._find(max(0, start - 1))
        while first and start - begin < 2 + len(ADDED):  # a cut depends on at most so many characters behind it
            first -= 1
            begin -= self.chars_of[self.size + first]
        keep, at = 0, begin  # pre-tokens of the first leaf that end before the one before the edit stay
        leaf = self.leaves[first]
        while keep + 2 < len(leaf) and at + len(leaf[keep]) + len(leaf[keep + 1]) + len(ADDED) < start:
            at += len(leaf[keep])
            keep += 1
        last, last_begin = self._find(end)
        while True:
            old = [p for leaf in self.leaves[first : last + 1] for p in leaf][keep:]
            known = [n for tokens in self.tokens[first : last + 1] for n in tokens][keep:]
            joined = "".join(old)
            edited = joined[: start - at] + new + joined[end - at :]
            shift, done = len(new) - (end - start), last + 1 >= len(self.leaves)
            ahead = "" if done else "".join(self.leaves[last + 1])  # boundary context
            cuts, place = {}, at
            for k, p in enumerate(old):
                if place >= end:
                    cuts[place + shift - at] = k
                place += len(p)
            cuts[len(edited)] = len(old)
            pieces, counts, here, resume = [], [], 0, None
            for m in PRETOKEN.finditer(edited + ahead):
                if here >= start - at + len(new) and here in cuts:
                    resume = cuts[here]
                    break
                if m.start() >= len(edited) or not done and m.end() + len(ADDED) > len(edited) + len(ahead):  # more context may change this cut
                    break
                pieces.append(m.group())
                counts.append(self.count(m.group()))
                self.encoded += len(m.group())
                here = m.end()
            if resume is None and here == len(edited) and (done or len(ahead) >= len(ADDED)):
                resume = len(old)
            if resume is not None:
                break
            last += 1  # no old cut met: take the next leaf in
        pieces = self.leaves[first][:keep] + pieces + old[resume:]
        counts = self.tokens[first][:keep] + counts + known[resume:]
        if last == first and len(pieces) <= 2 * self.fan:
            self.leaves[first], self.tokens[first] = pieces, counts
            self._update(first)
            return
        parts = range(0, len(pieces), self.fan)
        new_leaves = [pieces[i : i + self.fan] for i in parts] or [[]]
        new_tokens = [counts[i : i + self.fan] for i in parts] or [[]]
        if len(new_leaves) <= last + 1 - first:  # fits into the old leaves: later ones stay empty
            spare = last + 1 - first - len(new_leaves)
            self.leaves[first : last + 1], self.tokens[first : last + 1] = new_leaves + [[]] * spare, new_tokens + [[]] * spare
            for i in range(first, last + 1):
                self._update(i)
        else:
            self.leaves[first : last + 1], self.tokens[first : last + 1] = new_leaves, new_tokens
            self._build()


def privacy_edits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of addresses, links and long numbers, in order, without overlaps."""
    found = sorted((m.start(), -m.end(), new) for pattern, new in EDITS for m in pattern.finditer(text))
    out: list[tuple[int, int, str]] = []
    for start, end, new in found:
        if not out or start >= out[-1][1]:
            out.append((start, -end, new))
    return out


def counts_after_edits(docs: DataFrame, tokenizer: str, edits=privacy_edits) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, encoded_chars: token counts of whole texts before and after edits.

    ``edits`` gives (start, end, replacement) in characters of the old text, in order and without overlaps. They
    are applied from the last to the first, so places stay right; ``encoded_chars`` is how much was encoded again.
    Null text counts as empty. Ids may be null or repeat; other columns are ignored. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "encoded_chars"]

    def make():
        count = Counter(tokenizer)

        def one(text: str) -> tuple[int, int, int, int]:
            tree, todo = Tree(text, count), edits(text)
            before = tree.total
            for start, end, new in reversed(todo):
                tree.replace(start, end, new)
            return before, len(todo), tree.total, tree.encoded

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [one(t.as_py() or "") for t in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], pa.int64()) for k in range(4))], names)

        return step

    return docs.select("doc_id", "text").mapInArrow(per_batch(make), f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_after long, encoded_chars long")


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counts_after_edits(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
