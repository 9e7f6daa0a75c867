"""Exact removal of repeated byte strings by difference-cover suffix sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sessionloom.llm.base import drop_stash, per_batch, stash, table

_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 16
_LAST = np.uint64(0xFFFFFFFF)
_SLICE = 1 << 20  # bytes of a batch that a task works on at a time
_COVER = (1, 2, 4)  # a difference cover modulo 7
_AHEAD = np.array([1, 0, 0, 1, 0, 3, 2])  # from each residue to the next covered one
_PART = np.array([-1, 0, 1, -1, 2, -1, -1])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _STEP), _powers(pow(_BASE, -1, 1 << 64), _STEP)
_UP_STEP, _DOWN_STEP = (pow(b, _STEP, 1 << 64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _power(table: np.ndarray, step: int, n: int) -> np.ndarray:
    if n <= _STEP:
        return table[:n]
    return (_powers(step, -(-n // _STEP))[:, None] * table[None, :]).ravel()[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _runs_of(text: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows, in no text across two of the joined texts of these sizes: text number, gram hash, content hash, first window, windows, place of the gram."""
    n = len(text)
    none = np.empty(0, np.int64)
    if n < length:
        return (none,) * 6
    up, down = _power(_UP, _UP_STEP, n + 1), _power(_DOWN, _DOWN_STEP, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    place = _LAST - np.arange(n - gram + 1, dtype=np.uint64)  # half of the hash, and the place, so that the last of equals is least
    hit = (_LAST - (_window_min(h & ~_LAST | place, length - gram + 1) & _LAST)).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.nonzero(owner[: n - length + 1] == owner[length - 1 :])[0]
    if not len(inside):
        return (none,) * 6
    hit = hit[inside]
    heads = np.nonzero(np.append(True, hit[1:] != hit[:-1]))[0]
    counts = np.diff(np.append(heads, len(hit)))
    starts, hit = inside[heads], hit[heads]
    ends = starts + counts - 1 + length
    content = _mixed((sums[ends] - sums[starts]) * down[starts] + counts.astype(np.uint64))
    which = owner[starts]
    return which, h[hit].view(np.int64), content.view(np.int64), starts - (np.cumsum(sizes) - sizes)[which], counts, hit - starts


def anchors(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``length`` bytes that share their least gram: gram hash, content hash of the run's bytes, first window, windows.

    The least gram by the upper half of its hash (the last of equals) depends on a window's bytes alone, so equal windows
    anywhere have the same gram at the same place in them.
    """
    return _runs_of(text, np.array([len(text)]), length, gram)[1:5]


def suffix_ranks(s: np.ndarray, need: int | None = None) -> np.ndarray:
    """Ranks of all suffixes of a sequence of positive integers, by the difference cover {1, 2} modulo 3.

    Triples at the covered positions are sorted and named; if names repeat, their sequence is ranked the same way.
    The remaining suffixes are sorted by their first symbol and the rank behind it, and both are merged.
    With ``need``, suffixes whose first ``need`` symbols agree may come in any order.
    """
    n = len(s)
    if n < 8:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(n)
        return out
    s = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    p = np.concatenate([s, [0, 0, 0]])
    one, two, rest = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    covered = np.concatenate([one, two])
    wide = int(p.max()) + 1
    pair = p[covered] * wide + p[covered + 1]
    if wide > 1 << 20:  # names of pairs first, so that a triple fits 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    names = np.unique(pair * wide + p[covered + 2], return_inverse=True)[1].astype(np.int64) + 1
    if int(names.max()) < len(names) and (need is None or need > 3):
        names = suffix_ranks(names, need and -(-need // 3)) + 1
    rank = np.zeros(n + 3, np.int64)
    rank[covered] = names
    n1 = len(names) + 1
    key = p[rest] * n1 + rank[rest + 1]
    order = np.argsort(key, kind="stable")
    sorted_key, by_rest = key[order], rest[order]
    before_one = np.searchsorted(sorted_key, p[one] * n1 + rank[one + 1])
    second = np.unique(np.concatenate([p[rest] * wide + p[rest + 1], p[two] * wide + p[two + 1]]), return_inverse=True)[1].astype(np.int64)
    before_two = np.searchsorted((second[: len(rest)] * n1 + rank[rest + 2])[order], second[len(rest) :] * n1 + rank[two + 2])
    real = covered < n
    by_name = np.argsort(names[real])
    at = np.maximum.accumulate(np.concatenate([before_one, before_two])[real][by_name]) + np.arange(len(by_name))
    out = np.empty(n, np.int64)
    out[covered[real][by_name]] = at
    free = np.ones(n, bool)
    free[at] = False
    out[by_rest] = np.nonzero(free)[0]
    return out


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as little-endian integers, without a copy."""
    return np.ndarray((len(text) - 7,), "<u8", text.data, strides=(1,))


def window_order(text: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """``windows``, places in ``text``, sorted by place modulo 7 and then by their first ``length`` bytes at least, by the difference cover {1, 2, 4} modulo 7.

    Eight bytes at each covered place are sorted and named and the suffixes of the names ranked. A window is sorted by its
    bytes before the next covered place and the rank there. Zeros follow the text.
    """
    n = -(-(len(text) + length + 16) // 7) * 7
    padded = np.zeros(n + 8, np.uint8)
    padded[: len(text)] = text
    words = _words(padded)[:n]
    eight = np.concatenate([words[d::7] for d in _COVER]).byteswap()
    names = np.unique(eight, return_inverse=True)[1].astype(np.int64) + 1
    rank = suffix_ranks(names, -(-length // 7) + 1)
    residue = windows % 7
    ahead = _AHEAD[residue]
    at = windows + ahead
    bytes3 = padded[windows].astype(np.int64) << 16 | padded[windows + 1].astype(np.int64) << 8 | padded[windows + 2]
    key = (residue << 24 | bytes3 >> 8 * (3 - ahead)) << 32 | rank[_PART[at % 7] * (n // 7) + at // 7]
    return windows[np.argsort(key)]


def repeated_windows(text: np.ndarray, sizes: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, end) of bytes in windows that also start earlier: smaller ``doc``, or equal and smaller place.

    ``text`` has the pieces of these sizes joined. They are laid out so that their grams, at ``place`` in each, stand at
    multiples of seven: windows that are equal have the gram at the same place, so they meet in one class of the
    difference cover. Neighbours in suffix order whose first ``length`` bytes agree are the copies of one window.
    """
    gap = (np.append(0, place[:-1] - sizes[:-1]) - place) % 7  # zeros before each piece
    at = np.cumsum(sizes + gap) - sizes
    flat = np.zeros(int(sizes.sum() + gap.sum()) + 8, np.uint8)
    flat[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(text))] = text
    owner = np.repeat(np.arange(len(sizes)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    of = np.zeros(len(flat), np.int32)
    of[at[owner] + offset] = owner
    windows = window_order(flat, at[owner] + offset, length)
    owner = of[windows]
    offset = windows - at[owner]
    same = np.ones(len(windows) - 1, bool)
    words = _words(flat)
    for step in [*range(0, length - 8, 8), length - 8]:
        todo = np.nonzero(same)[0]
        same[todo] = words[windows[todo] + step] == words[windows[todo + 1] + step]
    heads = np.nonzero(np.append(True, ~same))[0]
    key = doc[owner] << 32 | first[owner] + offset
    least = np.repeat(np.minimum.reduceat(key, heads), np.diff(np.append(heads, len(windows))))
    again = np.sort(windows[key != least])
    if not len(again):
        none = np.empty(0, np.int64)
        return none, none, none
    cut = np.append(True, np.diff(again) != 1)
    begin, last = again[cut], again[np.append(cut[1:], True)]
    piece = of[begin]
    return piece, first[piece] + begin - at[piece], first[piece] + last - at[piece] + length


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per run of windows; ``shape`` is the number of windows, and the gram's place in the run above 16 bits."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            found, a = [], 0
            while a < len(texts):  # as many texts together as the tables of powers reach
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _STEP - 1, "right")))
                which, *rest = _runs_of(np.frombuffer(b"".join(texts[a:b]), np.uint8), np.array([len(t) for t in texts[a:b]]), length, gram)
                found.append((which + a, *rest))
                a = b
            which, hashes, content, start, count, place = (np.concatenate(c) for c in zip(*found))
            at = pa.array(which, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(hashes), pa.array(content), batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(place << 16 | count, pa.int32())],
                ["gram", "content", "doc_id", "version", "start", "shape"],
            )

        return step

    return docs.mapInArrow(per_batch(make, _SLICE), "gram long, content long, doc_id long, version long, start int, shape int")


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = 36, task_bytes: int = 1 << 18, crowd: int = 20_000) -> DataFrame:
    """(doc_id, version, start, end): bytes covered by a string of ``length`` bytes that also starts earlier; spans may overlap.

    ``docs`` has (doc_id long, version long, text). Every window of ``length`` bytes belongs to its least gram, so copies of a
    window meet under one gram; a gram found once has no copies. Runs of windows under a gram that are equal
    as a whole are told apart from the earliest one by a hash alone. Of the different ones, the earliest of each is fetched; the runs
    of many grams make one task's text of about ``task_bytes``, whose suffixes are sorted by difference cover. The windows of a
    gram with more than ``crowd`` different runs are told apart by a 128-bit hash of their bytes, aggregated to the earliest
    place of each; one piece of each distinct window is all that would be left to sort, and those have no copies.
    """
    rows = _anchor_rows(docs, length, gram)
    often = stash(rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))  # on its own, so that a crowded gram's rows can be split
    runs = stash(rows.join(often, "gram", "left_semi"))
    drop_stash(often)
    place = F.struct("doc_id", "version", "start")
    kinds = stash(runs.groupBy("gram", "content").agg(F.min(place).alias("first"), F.first("shape").alias("shape"), F.count("*").alias("n")))
    windows = F.col("shape").bitwiseAND(0xFFFF)
    copies = runs.join(kinds.where("n > 1").select("gram", "content", "first"), ["gram", "content"]).where(place != F.col("first"))
    copies = stash(copies.select("doc_id", "version", "start", (F.col("start") + windows - 1 + length).alias("end")))
    drop_stash(runs)  # before the pieces are cut, so that both are never kept at once

    counted = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum(windows).alias("all")).where("kinds > 1")
    mixed = stash(counted)  # on its own, so that a crowded gram's rows can be split
    size = F.when(F.col("kinds") <= crowd, F.col("all") + F.col("kinds") * (length - 1))
    total, most = mixed.agg(F.sum(size), F.max("kinds")).first()
    tasks = max(1, (total or 0) // task_bytes)
    wanted = kinds.join(mixed.drop("all"), "gram").select("gram", "kinds", "first.*", "shape")
    per_doc = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct("gram", "kinds", "start", "shape")).alias("runs"))
    sliced = docs.join(per_doc, (docs["doc_id"].eqNullSafe(per_doc["doc_id"])) & (docs["version"] == per_doc["version"])).select(docs["doc_id"], docs["version"], "text", "runs")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, runs = batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3)
            sizes = np.array([len(t) for t in texts])
            row = np.repeat(np.arange(len(texts)), np.diff(runs.offsets.to_numpy()))
            g, kinds, start, shape = (f.to_numpy().astype(np.int64) for f in runs.flatten().flatten())
            few = kinds <= crowd
            size = (shape[few] & 0xFFFF) - 1 + length
            source = ((np.cumsum(sizes) - sizes)[row] + start)[few]
            joined = b"".join(texts)
            piece = pa.array([joined[a:b] for a, b in zip(source.tolist(), (source + size).tolist())], pa.binary())
            task, row_of, first, kept = g[few] % tasks, row[few], start[few], shape[few]
            if not few.all():  # a hash in place of the window
                many = ~few
                each = [(i, s) for i, a, n in zip(row[many].tolist(), start[many].tolist(), (shape[many] & 0xFFFF).tolist()) for s in range(a, a + n)]
                hashed = pa.array([hashlib.blake2b(texts[i][s : s + length], digest_size=16).digest() for i, s in each], pa.binary())
                piece = pa.concat_arrays([piece, hashed])
                i, s = np.array(each, np.int64).T
                task, row_of, first, kept = (np.append(x, y) for x, y in ((task, np.full(len(i), -1)), (row_of, i), (first, s), (kept, np.ones(len(i), np.int64))))
            at = pa.array(row_of, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(task, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32()), pa.array(kept, pa.int32()), piece],
                ["task", "doc_id", "version", "start", "shape", "piece"],
            )

        return step

    pieces = sliced.mapInArrow(per_batch(make, _SLICE), "task long, doc_id long, version long, start int, shape int, piece binary")
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def sort_suffixes(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").combine_chunks()
        number = ids.fill_null(-(1 << 63)).to_numpy()
        version = group.column("version").to_numpy()
        order = np.lexsort((version, number))
        new = np.append(True, (np.diff(number[order]) != 0) | (np.diff(version[order]) != 0))
        doc = np.empty(len(order), np.int64)
        doc[order] = np.cumsum(new) - 1
        first, shape = (group.column(c).to_numpy().astype(np.int64) for c in ("start", "shape"))
        pieces = group.column("piece").to_pylist()
        text, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        piece, start, end = repeated_windows(text, sizes, doc, first, shape & 0xFFFF, shape >> 16, length)
        at = pa.array(piece, pa.int64())
        return pa.table([ids.take(at), group.column("version").take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32())], schema=schema)

    temporary = [copies, kinds, mixed]
    if (most or 0) > crowd:
        pieces = stash(pieces)
        single = pieces.where("task < 0").select("piece", "doc_id", "version", "start")
        earliest = stash(single.groupBy("piece").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("piece", "first"))
        again = single.join(earliest, "piece").where(place != F.col("first"))
        copies = copies.unionByName(again.select("doc_id", "version", "start", (F.col("start") + length).alias("end")))
        temporary += [pieces, earliest]
    sorted_runs = pieces.where("task >= 0").groupBy("task").applyInArrow(sort_suffixes, "doc_id long, version long, start int, end int")
    out = copies.unionByName(sorted_runs)
    out._temporary = tuple(temporary)
    return out


def _marked(docs: DataFrame, length: int, keep: list[str]) -> DataFrame:
    """``keep``, __text and __spans (removed places, in any order, overlapping) for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeated_spans(rows, length)
    spans = stash(found)
    drop_stash(*found._temporary)
    per_doc = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "__id", "version": "__version"})
    wide = docs.select(*keep, F.col("doc_id").cast("long").alias("__row"), F.xxhash64("text").alias("__hash"), F.col("text").alias("__text"))
    return wide.join(per_doc, F.col("__row").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__version")), "left").select(*keep, "__text", "__spans")


def _runs(spans: pa.ListScalar) -> list[tuple[int, int]]:
    """Maximal removed runs, in order."""
    if not spans.is_valid:
        return []
    start, end = (spans.values.field(k).to_numpy() for k in ("start", "end"))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    return list(zip(start[new].tolist(), reach[np.append(new[1:], True)].tolist()))


def _without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in runs)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in runs), len(raw)]))


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_text (without letters cut in half), kept_sha256 (of all remaining bytes) for every document.

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id or
    earlier in its own. Null text counts as empty and stays empty. A null id comes before all others. Rows with the same id are ordered by a
    hash of their text; if that is equal too they are one document and get the same result. An empty table gives an
    empty result; other columns are ignored.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in names[1:]]
            for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                raw, runs = text.as_py() or b"", _runs(spans)
                kept = _without(raw, runs)
                for col, value in zip(cols, (len(raw), len(raw) - len(kept), len(runs), kept.decode("utf-8", "ignore"), hashlib.sha256(kept).hexdigest())):
                    col.append(value)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], names)

        return step

    return _marked(docs, length, ["doc_id"]).mapInArrow(per_batch(make, _SLICE), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text string, kept_sha256 string")


def cut_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """The rows of ``docs`` with all their columns, the text without repeats as in ``without_repeats``; a letter cut in half goes as well.

    No row is dropped: one that is covered as a whole keeps an empty text. Null text stays null. The cut is
    by id and text, so rows that repeat an id keep their own texts.
    """
    rest = [c for c in docs.columns if c != "text"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            *others, texts, spans = batch.columns
            if spans.null_count < len(spans):
                raw = texts.cast(pa.binary())
                texts = pa.array([_without(t.as_py(), _runs(s)).decode("utf-8", "ignore") if s.is_valid else same.as_py() for t, same, s in zip(raw, texts, spans)], pa.string())
            return pa.RecordBatch.from_arrays([*others, texts.cast(pa.string())], [*rest, "text"])

        return step

    marked = _marked(docs, length, rest)
    schema = StructType([*marked.schema.fields[:-2], StructField("text", StringType())])
    return marked.mapInArrow(per_batch(make, _SLICE), schema).select(*docs.columns)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
