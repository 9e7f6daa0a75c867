"""Exact removal of repeated word spans by suffix automata of reference shards."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.base import drop_stash, per_batch, stash, table

_LAST = (1 << 63) - 1  # the key of a null id: after all others
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(text: bytes, step: int = 1 << 20) -> np.ndarray:
    """A 32-bit hash of every word, read in slices that end between words."""
    parts, at = [np.empty(0, np.uint64)], 0
    while at < len(text):
        gap = _GAP.search(text, at + step)
        end = gap.start() if gap else len(text)
        words = text[at:end].split()
        parts.append(np.fromiter(map(crc32, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts)


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word and the byte behind it."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(text, np.uint8)], [True]])
    edge = np.nonzero(space[1:] != space[:-1])[0]
    return edge[0::2], edge[1::2]


def anchors(hashes: np.ndarray, doc: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``length`` words that share their least gram: gram hash, place of the first window, windows.

    ``doc`` numbers the document of every word; windows lie inside one document. The least gram (the first of
    equals) depends on a window's words alone, so equal windows anywhere have the same gram at the same place in them.
    """
    n = len(hashes)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - gram + 1 + i]
    for multiplier in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(multiplier)
    least = np.lib.stride_tricks.sliding_window_view(h, length - gram + 1).argmin(1)
    at = np.nonzero(doc[: n - length + 1] == doc[length - 1 :])[0]
    if not len(at):
        return np.empty(0, np.int64), at, at
    hit = at + least[at]
    heads = np.nonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(hit) != 0)]))[0]
    return h[hit[heads]].view(np.int64), at[heads], np.diff(np.append(heads, len(at)))


class Automaton:
    """Suffix automaton of several word sequences; every state knows the least document key among its occurrences."""

    def __init__(self, words: list[bytes], move: dict[int, int], link: list[int], length: list[int], least: list[int]):
        self.words, self.move, self.link, self.length, self.least = words, move, link, length, least
        self.number = {w: i for i, w in enumerate(words)}

    @classmethod
    def build(cls, pieces: list[bytes], docs: list[int]) -> Automaton:
        number: dict[bytes, int] = {}
        after: list[dict[int, int]] = [{}]
        link, length, least = [-1], [0], [_LAST]

        def copy_of(state: int, size: int) -> int:
            after.append(dict(after[state]))
            link.append(link[state])
            length.append(size)
            least.append(_LAST)
            return len(after) - 1

        def split(p: int, w: int) -> int:
            """The state of the words of p followed by w, as a state of its own."""
            q = after[p][w]
            if length[q] == length[p] + 1:
                return q
            new = copy_of(q, length[p] + 1)
            link[q] = new
            while p >= 0 and after[p].get(w) == q:
                after[p][w] = new
                p = link[p]
            return new

        for piece, doc in zip(pieces, docs):
            last = 0
            for word in piece.split():
                w = number.setdefault(word, len(number))
                if w in after[last]:
                    last = split(last, w)
                else:
                    new, p = len(after), last
                    after.append({})
                    length.append(length[last] + 1)
                    least.append(_LAST)
                    link.append(0)
                    while p >= 0 and w not in after[p]:
                        after[p][w] = new
                        p = link[p]
                    if p >= 0:
                        link[new] = split(p, w)
                    last = new
                if doc < least[last]:
                    least[last] = doc
        for state in np.argsort(-np.array(length), kind="stable").tolist():
            up = link[state]
            if up >= 0 and least[state] < least[up]:
                least[up] = least[state]
        size = max(len(number), 1)
        return cls(list(number), {s * size + w: t for s, moves in enumerate(after) for w, t in moves.items()}, link, length, least)

    def spans(self, piece: bytes, doc: int, length: int) -> list[tuple[int, int]]:
        """Maximal spans of words covered by matches of at least ``length`` words with a document before ``doc``."""
        move, link, sizes, least, size = self.move.get, self.link, self.length, self.least, max(len(self.words), 1)
        state, matched, out = 0, 0, []
        for i, word in enumerate(piece.split(), 1):
            w = self.number[word]
            while True:
                to = move(state * size + w)
                if to is not None and least[to] < doc:
                    state, matched = to, matched + 1
                    break
                if state == 0:
                    matched = 0
                    break
                state = link[state]
                matched = sizes[state]
            if matched >= length:
                if out and i - matched <= out[-1][1]:
                    out[-1][1] = i
                else:
                    out.append([i - matched, i])
        return [tuple(s) for s in out]


def _runs(docs: DataFrame, length: int, gram: int, flush: int = 400_000) -> DataFrame:
    """(gram, key, version, start, windows) of every run of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows, n = [], [], 0
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                held.append(word_hashes(text.as_py()))
                rows.append(i)
                n += len(held[-1])
                if n >= flush or i == batch.num_rows - 1:
                    sizes = [len(h) for h in held]
                    first = np.cumsum([0, *sizes[:-1]])
                    owner = np.repeat(np.arange(len(held)), sizes)
                    hashes, at, windows = anchors(np.concatenate(held), owner, length, gram)
                    own = owner[at]
                    take = pa.array(np.array(rows)[own])
                    start = pa.array(at - first[own], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column(0).take(take), batch.column(1).take(take), start, pa.array(windows, pa.int32())], names)
                    held, rows, n = [], [], 0

    names = ["gram", "key", "version", "start", "windows"]
    return docs.select("key", "version", "text").mapInArrow(cut, "gram long, key long, version long, start int, windows int")


_PIECE = "gram long, key long, version long, start int, piece binary"
_PIECE_SCHEMA = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("piece", pa.binary())])


def _cut_pieces(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """The words of every run, joined by one space."""
    per_doc = runs.groupBy("key", "version").agg(F.collect_set(F.struct("gram", "start", "windows")).alias("runs"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(5)]
            for key, version, text, runs in zip(*(batch.column(i) for i in range(2)), batch.column(2).cast(pa.binary()), batch.column(3)):
                raw, key, version = text.as_py(), key.as_py(), version.as_py()
                begin, end = word_places(raw)
                grams, start, windows = (runs.values.field(k).to_numpy() for k in ("gram", "start", "windows"))
                last = end[start + windows + length - 2]
                out[0] += grams.tolist()
                out[1] += [key] * len(grams)
                out[2] += [version] * len(grams)
                out[3] += start.tolist()
                out[4] += [b" ".join(raw[a:b].split()) for a, b in zip(begin[start].tolist(), last.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)

        return step

    return docs.join(per_doc, ["key", "version"]).select("key", "version", "text", "runs").mapInArrow(per_batch(make), _PIECE)


def _single_windows(pieces: DataFrame, length: int) -> DataFrame:
    """Every window of the pieces as a piece of its own, under a hash of its words."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(5)]
            for _, key, version, start, piece in zip(*(c.to_pylist() for c in batch.columns)):
                words = piece.split()
                for i in range(len(words) - length + 1):
                    window = b" ".join(words[i : i + length])
                    row = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), key, version, start + i, window
                    for column, value in zip(out, row):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)

        return step

    return pieces.select("gram", "key", "version", "start", "piece").mapInArrow(per_batch(make), _PIECE)


def repeated_spans(docs: DataFrame, copies: DataFrame, length: int = 13, gram: int = 5, shard_words: int = 100_000, stream_rows: int = 100_000, crowd: int = 2_000) -> DataFrame:
    """(key, version, start, end): word spans covered by windows of ``length`` words that also start under a smaller key.

    ``docs`` has (key long, version long, text); those in ``copies`` (key, version) get no spans, their texts stand under a smaller key. A
    window belongs to its least gram, so copies of a window meet under one gram, and a gram of one text has none. The different
    pieces under the remaining grams, each with its least key, are the reference; they are dealt to shards of about ``shard_words`` words
    by their gram. All pieces stream past the suffix automaton of their shard. The shard's reference, which is bounded and far
    smaller than its automaton, is sent to every task that streams pieces of it, one for each ``stream_rows`` of them, and
    the automaton is built there. A gram with more than ``crowd`` different pieces is dealt by single windows instead.
    """
    rows = _runs(docs, length, gram)
    often = stash(rows.groupBy("gram").agg(F.min("version").alias("a"), F.max("version").alias("b")).where("a <> b").select("gram"))
    runs = stash(rows.join(often, "gram", "left_semi").join(copies, ["key", "version"], "left_anti"))
    pieces = stash(_cut_pieces(docs, runs, length))
    drop_stash(often, runs)
    kind = lambda x: x.groupBy("gram", "piece").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    kinds = stash(kind(pieces))
    crowded = stash(kinds.groupBy("gram").count().where(F.col("count") > crowd).select("gram"))
    temporary = [pieces, kinds, crowded]
    if not crowded.isEmpty():
        single = stash(_single_windows(pieces.join(crowded, "gram", "left_semi"), length))
        pieces = pieces.join(crowded, "gram", "left_anti").unionByName(single)
        kinds = stash(kinds.join(crowded, "gram", "left_anti").unionByName(kind(single)))
        temporary += [single, kinds]
    words = F.size(F.split(F.col("piece").cast("string"), " "))
    shards = max(1, (kinds.agg(F.sum(words)).first()[0] or 0) // shard_words)
    shard = F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard")
    busy = stash(kinds.groupBy(shard).agg(F.ceil(F.sum("n") / stream_rows).cast("int").alias("tasks")).where("tasks > 1"))
    spread = F.coalesce("tasks", F.lit(1))
    dealt = pieces.select(shard, "key", "version", "start", "piece").join(busy, "shard", "left")
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("key", "version", "start"), spread).cast("int")).drop("tasks")
    reference = kinds.select(shard, "piece", "key").join(busy, "shard", "left")
    reference = reference.select("shard", "piece", "key", F.explode(F.sequence(F.lit(0), spread - 1)).alias("task"))
    schema = pa.schema([("key", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def stream(pieces: pa.Table, reference: pa.Table) -> pa.Table:
        if not pieces.num_rows:
            return schema.empty_table()
        made = Automaton.build(reference.column("piece").to_pylist(), reference.column("key").to_pylist())
        at, start, end = [], [], []
        for i, (key, first, piece) in enumerate(zip(*(pieces.column(c).to_pylist() for c in ("key", "start", "piece")))):
            for a, b in made.spans(piece, key, length):
                at.append(i)
                start.append(first + a)
                end.append(first + b)
        rows = pa.array(at, pa.int64())
        return pa.table([pieces.column("key").take(rows), pieces.column("version").take(rows), pa.array(start, pa.int32()), pa.array(end, pa.int32())], schema=schema)

    found = dealt.groupBy("shard", "task").cogroup(reference.groupBy("shard", "task")).applyInArrow(stream, "key long, version long, start int, end int")
    found._temporary = (*temporary, busy)
    return found


def without_repeated_spans(docs: DataFrame, length: int = 13, gram: int = 5, **limits: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 for every document; words are separated by ASCII white space.

    A word is removed if a window of ``length`` words that covers it also starts in a document with a smaller id. Null text has no
    words. A null id comes after all others, and documents with the same id do not count against each other. Of documents
    with the same text only those with the smallest id are cut; the others go as a whole, if they hold a window at all. Rows
    that repeat id and text get the same result. An empty table gives an empty result; other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key")
    rows = docs.select(key, F.xxhash64("text").alias("version"), "text").where("text is not null")
    marks = rows.select("key", "version", F.md5(F.col("text").cast("binary")).alias("same"))
    firsts = marks.groupBy("same").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    copies = stash(marks.join(firsts, "same").where(F.col("key") > F.col("first")).select("key", "version").distinct())
    found = repeated_spans(rows, copies, length, gram, **limits)
    spans = stash(found.groupBy("key", "version").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    drop_stash(*found._temporary)
    decided = spans.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).withColumn("whole", F.lit(True)))
    joined = docs.select("doc_id", key, F.xxhash64("text").alias("version"), "text").join(decided, ["key", "version"], "left")
    names = ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in names[1:]]
            for text, spans, whole in zip(batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3).to_pylist()):
                raw = text.as_py() or b""
                begin, end = word_places(raw)
                n = len(begin)
                drop = np.zeros(n + 1, np.int64)
                if whole and n >= length:
                    drop[0], drop[n] = 1, -1
                elif spans.is_valid:
                    np.add.at(drop, spans.values.field("start").to_numpy(), 1)
                    np.add.at(drop, spans.values.field("end").to_numpy(), -1)
                out = np.cumsum(drop)[:n] > 0
                edge = np.nonzero(np.diff(np.concatenate([[True], out, [True]])))[0]
                stretches = [raw[begin[a] : end[b - 1]] for a, b in zip(edge[0::2], edge[1::2])]
                kept = b" ".join(b" ".join(s.split()) for s in stretches)
                for col, value in zip(cols, (n, int(out.sum()), kept.decode(), hashlib.sha256(kept).hexdigest())):
                    col.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)

        return step

    return joined.select(F.col("doc_id").cast("long"), "text", "spans", "whole").mapInArrow(per_batch(make), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def op13_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_spans(table(spark, sf_dir, "documents")).drop("kept_text")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
least_ AS (SELECT t, min(doc_id) AS m FROM windows GROUP BY t),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM windows JOIN least_ USING (t) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
