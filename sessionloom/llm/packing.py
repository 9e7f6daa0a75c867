"""Hierarchical multi-length packing of token sequences."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm.base import table

TIERS = (512, 1024, 2048, 4096)
END_ID = 2


# The tokenizer's pre-tokens, spelled out for lower-case Latin-1 text.
_LETTERS, _DIGITS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", " \t\n\x0b\x0c\r\x85\xa0"
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_BYTES = _byte_letters()


class WordEncoder:
    """Ids of whole texts, with bounded caches of words and pre-tokens.

    Text is parted at spaces and line breaks, which always end a pre-token and leave no id.
    A new word of Latin-1 text, which needs no normal form, is cut into pre-tokens by one pattern and these go straight
    to the tokenizer's model; words of other text, and of text that may hold special tokens, go through the whole tokenizer.
    """

    def __init__(self, path: str, words: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), words
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.words:
                self.pieces.clear()
            shown = piece if piece.isascii() and piece.isprintable() else "".join([_BYTES[b] for b in piece.encode()])
            ids = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        return ids

    def _plain(self, word: str) -> bytes:
        return b"".join(map(self._piece, _PRETOKEN.findall(word)))

    def _other(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, words: list[str], cache: dict[str, bytes], learn: Callable[[str], bytes]) -> np.ndarray:
        out = list(map(cache.get, words))
        if None in out:
            if len(cache) + out.count(None) > self.words:
                cache.clear()
            for i, known in enumerate(out):
                if known is None:
                    word = words[i]
                    if word not in cache:
                        cache[word] = learn(word)
                    out[i] = cache[word]
        return np.frombuffer(b"".join(out), "<u4")

    def __call__(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
            plain = "<|" not in text
        except UnicodeEncodeError:
            plain = False
        words = (text.lower() if plain else text).replace("\n", " ").split(" ")
        return self._ids(words, self.plain, self._plain) if plain else self._ids(words, self.other, self._other)


@dataclass
class Piece:
    """A run of a document's ids that is not placed yet."""

    doc: object
    start: int
    ids: np.ndarray
    total: int

    def split(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:at], self.total), Piece(self.doc, self.start + at, self.ids[at:], self.total)


@dataclass
class Packer:
    """Packs the documents of one partition, a bounded group at a time.

    Whole windows of a long document leave at once; its rest and shorter documents go to the
    smallest tier that holds them. Tiers are packed from the longest: a document opens a
    window of its tier, the largest fitting pieces of shorter tiers fill the gap, and
    one piece is cut to close it. The window left open at a group's end goes to
    the next group; at the partition's end its tokens are dealt to sequences at powers of two.
    """

    tiers: tuple[int, ...] = TIERS
    group_tokens: int = 1 << 20
    pool: list[Piece] = field(default_factory=list)
    waiting: int = 0
    closed: list[tuple[int, list[Piece]]] = field(default_factory=list)

    def add(self, doc: object, ids: np.ndarray) -> None:
        rest, top = Piece(doc, 0, ids, len(ids)), self.tiers[-1]
        while len(rest.ids) >= top:
            head, rest = rest.split(top)
            self.closed.append((top, [head]))
        if len(rest.ids):
            self.pool.append(rest)
            self.waiting += len(rest.ids)
        if self.waiting >= self.group_tokens:
            self.pack()

    def pack(self) -> None:
        pool = sorted(self.pool, key=lambda p: len(p.ids))
        sizes = [len(p.ids) for p in pool]
        self.pool, self.waiting = [], 0

        def take(i: int) -> Piece:
            sizes.pop(i)
            return pool.pop(i)

        while pool:
            tier = next(t for t in self.tiers if t >= sizes[-1])
            window = [take(-1)]
            gap = tier - len(window[0].ids)
            while gap and pool:
                i = bisect.bisect_right(sizes, gap) - 1
                if i < 0 and gap < sizes[0]:
                    i = bisect.bisect_right(sizes, tier // 2) - 1  # cut a piece of a shorter tier if there is one
                    head, tail = take(max(i, 0)).split(gap)
                    at = bisect.bisect_left(sizes, len(tail.ids))
                    sizes.insert(at, len(tail.ids))
                    pool.insert(at, tail)
                    window.append(head)
                    gap = 0
                else:
                    window.append(take(i))
                    gap -= len(window[-1].ids)
            if gap:
                self.pool, self.waiting = window, tier - gap
            else:
                self.closed.append((tier, window))

    def finish(self) -> None:
        self.pack()
        rest, self.pool = self.pool, []
        left = sum(len(p.ids) for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            window, need = [], size
            while need:
                piece = rest.pop(0)
                if len(piece.ids) > need:
                    piece, tail = piece.split(need)
                    rest.insert(0, tail)
                window.append(piece)
                need -= len(piece.ids)
            self.closed.append((size, window))
            left -= size


def step_groups(closed: list[tuple[int, list[Piece]]], size: int) -> list[int]:
    """Step number of every sequence: groups of one length, dealt out in serpentine order of attention cost."""
    out, steps = [0] * len(closed), 0
    for length in sorted({t for t, _ in closed}, reverse=True):
        members = [i for i, (t, _) in enumerate(closed) if t == length]
        members.sort(key=lambda i: (-sum(len(p.ids) ** 2 for p in closed[i][1]), i))
        groups = -(-len(members) // size)
        for rank, i in enumerate(members):
            turn, place = divmod(rank, groups)
            out[i] = steps + (place if turn % 2 == 0 else groups - 1 - place)
        steps += groups
    return out


def pack_documents(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, step_sequences: int = 64, with_ids: bool = False, flush: int = 8192) -> DataFrame:
    """Pieces of documents in full sequences of the tiers' lengths.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier
    (the sequence's length), step_id (sequences of one length with like attention cost), with ``with_ids`` also ids.
    Every partition of the input packs its own documents, so nothing is shuffled and a lost task is simply run
    again; a partition leaves no padding, at most a dozen short sequences at powers of two.
    ``tokenizer`` is the path of a tokenizers file, which must be readable on the executors.

    Null text counts as empty: a document of the end id alone. Ids may be null or repeat; each row is
    a document of its own. A very long text is cut like any other. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = WordEncoder(tokenizer), Packer(tuple(sorted(tiers)))
        id_type, base = None, TaskContext.get().partitionId() << 36
        sequences = steps = 0

        def emit() -> pa.RecordBatch:
            nonlocal sequences, steps
            cols: list[list] = [[] for _ in names]
            numbers = step_groups(packer.closed, step_sequences)
            for (length, window), step in zip(packer.closed, numbers):
                at = 0
                for p in window:
                    n = len(p.ids)
                    row = [p.doc, p.start, n, zlib.crc32(p.ids.tobytes()), p.total, base + sequences, at, length, base + steps + step]
                    for col, value in zip(cols, row + [p.ids.astype(np.int32)] * with_ids):
                        col.append(value)
                    at += n
                sequences += 1
            steps += max(numbers, default=-1) + 1
            packer.closed = []
            types = [id_type] + [pa.int64()] * 6 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0), batch.column(1)):
                packer.add(doc.as_py(), np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4"))
                if len(packer.closed) >= flush:
                    yield emit()
        if id_type is not None:
            packer.finish()
            yield emit()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizer())
