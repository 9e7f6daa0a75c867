"""Centroid clusters, source divergence and word-span removal against brute force, with nulls, ties and repeated rows."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import automata, base, catalog, divergence, extraction, vafile

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, version double, term string, value int, spans int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "k", 0.5, "t", 3, 1) for i, t, lang, s in rows], DOCS).repartition(3)


# Clusters ---------------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3):
    """rows: (id, integer vector); plain rounds over all distances."""
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in rows:
            members[nearest(v)[1]].append(v)
        for c, vectors in members.items():
            centres[c] = [sum(x) // len(vectors) for x in zip(*vectors)]
    last = [(i, *reversed(nearest(v))) for i, v in rows]
    inertia = Counter()
    for _, c, d in last:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((repr(i), c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in last)


def got_clusters(df):
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("n, bits", [(700, 6), (300, 3), (9, 6)])
def test_clusters_equal_plain_rounds(spark, n, bits):
    rng = np.random.default_rng(n)
    centres = rng.normal(0, 12, (20, 8))
    x = np.floor(centres[rng.integers(0, 20, n)] + rng.normal(0, 3, (n, 8))).astype(int)
    x[: n // 4] = x[0]  # ties
    x[-1] = 5000  # far beyond every inner cell
    rows = [(None if i % 97 == 5 else i // 2 if i % 50 == 1 else i, v.tolist()) for i, v in enumerate(x)]  # null and repeated ids
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, v array<long>, cells string, cluster int").repartition(4)
    assert got_clusters(vafile.centroid_clusters(df, dims=8, bits=bits)) == brute_clusters(rows)


def test_intervals_hold_every_distance_and_settle_most_vectors():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 8, (500, 10))).astype(np.int64)
    cells = vafile.Cells(x.min(0), x.max(0), x.mean(0), x.std(0))
    import pyarrow as pa

    code = cells.decode(pa.array(cells.encode(x), pa.binary()))
    lower, upper = cells.tables(x[:16])
    exact = ((x[:, None] - x[None, :16]) ** 2).sum(2)
    low = sum(lower[d][code[:, d]] for d in range(10))
    high = sum(upper[d][code[:, d]] for d in range(10))
    assert (low <= exact).all() and (exact <= high).all()
    open_ = vafile.candidates(code, lower, upper)
    assert open_[np.arange(500), exact.argmin(1)].all() and (open_.sum(1) == 1).mean() > 0.5


def test_only_whole_vectors_are_clustered(spark, tmp_path):
    good = [0.5] * 64
    rows = [(1, good, 1), (2, good[:63], 1), (3, None, 1), (4, [*good[:63], None], 1), (5, [*good[:63], float("nan")], 1), (6, [*good[:63], float("inf")], 2), (None, [-0.01] * 64, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [(r.vec_id, r.cluster, r.distance) for r in vafile.op11_va_clusters(spark, str(tmp_path)).orderBy("vec_id").collect()] == [(None, 1, 0), (1, 0, 0)]
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vafile.op11_va_clusters(spark, f"{tmp_path}/none").count() == 0


# Divergence ---------------------------------------------------------------------------


def brute_divergence(rows, top=200):
    found, among, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        found[lang, source].update(words)
        among[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in among[lang].items() if n >= 3]
        whole = Counter()
        for s in sources:
            whole.update({t: found[lang, s][t] for t in kept})

        def p(counts, term):
            return 1 + 10**9 * (counts[term] + 1) // (sum(counts[t] for t in kept) + len(kept))

        f = lambda a, b, t: (p(a, t) - p(b, t)) ** 2 // p(b, t)
        for s in sources:
            own = found[lang, s]
            pair = [(o, sum(f(own, found[lang, o], t) for t in kept)) for o in sources if o != s]
            term = [(t, f(own, whole, t)) for t in kept if own[t] and p(own, t) > p(whole, t)]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("top", [200, 3])
def test_divergence_equals_plain_counts(spark, top):
    rng = random.Random(5)
    words = ["a", "B", "é", "Éa", "straße", "🙂", "x1y", "don't", "AAA", "aaa", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40])))
    rows = [(i if i % 9 else None, text(), rng.choice(["en", "fr", None, ""]), rng.choice(["s", "T", "ü", None])) for i in range(150)]
    rows += [(1, None, "en", "empty"), (2, "", "lonely", "s"), (3, "only here", "lonely", "t"), (4, "\x00\x7f 12", "en", "s")] + rows[:20]
    rows += [(9, "a b " * 30_000 + "tail", "en", "s")]
    got = divergence.source_divergence(table(spark, rows), top=top).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows, top)


def test_terms_are_counted_alike_in_slices_and_flushes(spark):
    text = ("Ünder the SEA, " * 50).encode()
    whole = [w for part in divergence.terms(text) for w in part]
    assert [w for part in divergence.terms(text, 7) for w in part] == whole
    rows = [(i, f"t{'x' * (i % 5)} u", "en", "s") for i in range(50)]
    add = lambda df: sorted(map(tuple, df.groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()))
    assert add(divergence.term_counts(table(spark, rows), flush=2)) == add(divergence.term_counts(table(spark, rows)))
    assert divergence.source_divergence(table(spark, rows).limit(0)).count() == 0


# Word spans ---------------------------------------------------------------------------


def brute_spans(rows, length=13):
    """Windows that also start under a smaller id, row by row; a null id is larger than all."""
    least = {}
    split = [(float("inf") if i is None else i, i, (t or "").encode().split()) for i, t, *_ in rows]
    for key, _, words in split:
        for p in range(len(words) - length + 1):
            window = tuple(words[p : p + length])
            least[window] = min(least.get(window, float("inf")), key)
    out = []
    for key, i, words in split:
        drop = [False] * len(words)
        for p in range(len(words) - length + 1):
            if least[tuple(words[p : p + length])] < key:
                drop[p : p + length] = [True] * length
        kept = b" ".join(w for w, d in zip(words, drop) if not d)
        out.append((repr(i), len(words), sum(drop), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got_spans(df):
    return sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def passages(seed, n):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([12, 13, 14, 40]))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(f"{rng.choice('xyz')}{rng.randrange(9)}" for _ in range(rng.randrange(30))) for _ in range(rng.randrange(5))]
        rows.append((i // 2 if i % 10 == 3 else None if i % 31 == 4 else i, rng.choice([" ", "\n", "\t \x0b"]).join(parts), "en", "s"))
    return rows


HARD = [
    (0, None, "en", "s"), (1, "", "en", "s"), (None, " \t ", "en", "s"), (2, "one two", "en", "s"),
    (3, "a " * 40, "en", "s"), (4, "a " * 40, "en", "s"), (5, "a " * 13, "en", "s"), (6, "a " * 12, "en", "s"), (6, "a " * 12, "en", "s"),
    (7, "long word " * 30_000, "en", "s"), (8, "word long " * 30_000, "en", "s"), (None, "word long " * 20, "en", "s"), (None, "word long " * 20, "en", "s"),
    (9, "é ü 🙂  " + "q " * 20, "en", "s"), (9, "é ü 🙂  " + "q " * 19, "en", "s"), (-1, "q " * 15, "en", "s"),
]


@pytest.mark.parametrize("limits", [{}, {"crowd": 2, "shard_words": 60, "stream_rows": 5}])
def test_spans_equal_a_scan_of_all_windows(spark, limits):
    rows = passages(1, 250) + HARD
    assert got_spans(automata.without_repeated_spans(table(spark, rows), **limits)) == brute_spans(rows)


def test_spans_of_the_query_and_of_no_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got_spans(catalog.QUERIES["op13_automata"](spark, SF)) == brute_spans(rows)
    assert automata.without_repeated_spans(table(spark, HARD).limit(0)).count() == 0


def test_automaton_finds_matches_by_itself():
    """Matching statistics over the automaton, without the grams before it."""
    rng = random.Random(2)
    pieces = [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 25))).encode() for _ in range(60)]
    docs = [rng.randrange(9) for _ in pieces]
    made = automata.Automaton.build(pieces, docs)
    for piece in pieces:
        words = piece.split()
        for doc in range(10):
            drop = [False] * len(words)
            for p in range(len(words) - 3):
                window = b" ".join(words[p : p + 4])
                if any(d < doc and b" " + window + b" " in b" " + other + b" " for other, d in zip(pieces, docs)):
                    drop[p : p + 4] = [True] * 4
            covered = [False] * len(words)
            for a, b in made.spans(piece, doc, 4):
                covered[a:b] = [True] * (b - a)
            assert covered == drop


def test_hashes_and_anchors_do_not_depend_on_slices():
    text = ("one  two\nthree\x0bfour " * 40).encode()
    assert automata.word_hashes(text, 5).tolist() == automata.word_hashes(text).tolist()
    begin, end = automata.word_places(text)
    assert [text[a:b] for a, b in zip(begin, end)] == text.split()


# Earlier operators: markup in linear time, samples of any share, the shared folder -----------


MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)


def test_markup_is_what_one_expression_finds():
    rng = random.Random(1)
    parts = ["<", ">", '"', "'", "<a ", '<div class="x>y">', "</div>", "<!--", "-->", "<script", "</script >", "</SCRIPT>", "<style>", "x", "=", "/", "<!DOCTYPE", "<?", "<p>", "svg", "<svg:r ", "-", " ", "<1", "é"]
    for _ in range(20_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        want = [(m.start(), m.end(), m[2] or "", m[3], m[4] or "") for m in MARKUP.finditer(page)]
        assert list(extraction.markup(page)) == want, page


@pytest.mark.parametrize("part", ["<a ", "<script ", '<a " ', "<a ' \" ", "<", "<!--", "<!x ", "<ul>"])
def test_markup_that_never_ends_takes_seconds(part):
    page = part * 300_000 + "</ol>" * 100_000 * (part == "<ul>")
    start = time.process_time()
    extraction.blocks(page)
    assert time.process_time() - start < 20


def test_samples_draw_rows_at_any_share(spark):
    rows = spark.range(20_000_000)
    assert rows.where(base.drawn("id", 5e-7)).count() in range(1, 40)  # 24,000 of 5 * 10**10 rows
    assert abs(rows.where(base.drawn("id", 0.01)).count() - 200_000) < 3_000
    assert rows.limit(100).where(base.drawn("id", 1.0)).count() == 100 and rows.limit(100).where(base.drawn("id", 0.0)).count() == 0
