"""The training-data operators against DuckDB, brute force and small hand-made tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import regex
import xxhash
from compare import compare, connect
from pyspark.sql import functions as F

from sessionloom.llm import base, catalog, extraction, hnsw, language, mixing, packing, simhash, suffixes, token_counts, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, extra string"


def docs(spark, texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    sources = ["a"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, 7, "x") for i, t, s in zip(ids, texts, sources)], DOCS).repartition(3)


HARD = [None, "", " ", "one", "ONE", "one two three four", "one two three four", "é🙂 x" * 40, "long " * 20000, "\x00�<|endoftext|>"]


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_duckdb(spark, name):
    ok, detail = compare(spark, connect(SF), SF, name, catalog.QUERIES[name], catalog.SQL[name])
    assert ok, detail


def test_every_operator_takes_empty_and_hard_tables(spark):
    """Nulls, empty and very long texts, repeated rows and clashing columns; then no rows at all."""
    hard = docs(spark, HARD + HARD[:3], [0, None, 2, 3, 4, 5, 5, 7, 8, 9, 0, None, 2])
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for table in (hard, hard.limit(0)):
        n = table.count()
        assert simhash.simhash_components(table).count() == n
        assert suffixes.without_repeats(table).count() == n
        assert mixing.fair_mix(table).count() == n
        assert token_counts.counts_after_edits(table, packing.public_tokenizer("byte_bpe_50k.json")).count() == n
        assert language.identify(table, language.prototypes(table)).count() == n
        assert toxicity.score(table, toxicity.train(table, labels)).count() == n
        assert packing.pack_documents(table, packing.public_tokenizer()).where("start = 0").count() == n
        pages = table.select(F.col("doc_id").alias("page_id"), F.col("extra").alias("url"), F.col("text").alias("html"), "score")
        assert extraction.main_text(pages).count() == n
    vectors = spark.createDataFrame([(1, 1, None), (2, 1, []), (3, 1, [0.0, 0.0]), (4, None, [1.0, 0.0]), (5, 1, [float("nan"), 1.0]), (6, 1, [1.0, None]), (None, 1, [1.0, 0.0]), (7, 1, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    got = {(r.vec_id, r.n_links, r.component_id) for r in hnsw.near_duplicates(vectors).collect()}
    assert got == {(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 7, None)}
    assert hnsw.near_duplicates(vectors.limit(0)).count() == 0
    whole = vectors.where("vec_id in (4, 7)").select("vec_id", F.transform("embedding", lambda x: x.cast("long")).alias("v"))
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(whole, whole.where("vec_id = 4")).collect()} == {(4, 1, 7, 1)}
    assert topk.top_k(whole.limit(0), whole).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 50)] + [(5, None), (7, 7)]
    random.Random(1).shuffle(chain)
    got = dict(base.connected_components(spark.createDataFrame(chain + star, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}}


def test_hnsw_counts_links_and_crowds(spark):
    rng = np.random.default_rng(3)
    crowd = rng.normal(size=64) + rng.normal(size=(700, 64)) * 0.02
    x = np.concatenate([rng.normal(size=(900, 64)), crowd, crowd[:40]]).astype(np.float32)
    rows = [(i, 1, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), shard_rows=600, query_rows=500).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    assert [got[i][0] for i in range(len(x))] == near.sum(1).tolist()
    assert {got[i][1] for i in range(900, 1640)} == {900} and all(got[i] == (0, i, True) for i in range(900))


def test_hnsw_finds_nodes_that_no_path_reaches():
    """Pairs at places that an audit of evenly spaced queries leaves out; nothing links to them but themselves."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 32))
    audited = np.linspace(0, 1499, 32).astype(int)
    pairs = [(i, i + 3) for i in range(5, 1400, 101) if not np.isin((i, i + 3), audited).any()]
    for a, b in pairs:
        x[b] = x[a] + rng.normal(size=32) * 0.01
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = hnsw.Graph(x)
    island = np.unique(pairs)
    for links in [layer[-1] for layer in graph.layers]:
        if len(links) == len(x):
            links[np.isin(graph.nodes[links], island)] = -1
    found = {(int(i), int(j)) for a, b in hnsw.near(graph, x, 0.98) for i, j in zip(a, b) if i != j}
    assert found == {p for a, b in pairs for p in ((a, b), (b, a))}


def test_hnsw_queries_descend_on_their_own():
    """What a query finds does not depend on the queries beside it, and reaches clusters away from the common entries."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 32))
    x = np.repeat(centres, 20, axis=0) + rng.normal(size=(3000, 32)) * 0.02
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(3000)]
    graph = hnsw.Graph(x)
    together = graph.search(x[:200], 16)[0]
    alone = np.concatenate([graph.search(x[i : i + 1], 16)[0] for i in range(200)])
    assert (np.sort(together, 1) == np.sort(alone, 1)).all()


def test_hnsw_label_of_several_shards(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 24))
    x[2000:3500] = x[:1500] + rng.normal(size=(1500, 24)) * rng.uniform(0.05, 0.3, (1500, 1))  # many pairs around the bar
    x[3500:] = x[7] + rng.normal(size=(500, 24)) * 0.1
    rows = [(i, 1, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), shard_rows=1400, query_rows=1000).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert [got[i] for i in range(len(x))] == ((u @ u.T >= 0.98).sum(1) - 1).tolist()


def test_golay_code_and_keys():
    words = np.arange(1 << 12) << 11
    code = words ^ simhash._syndromes(words)
    assert min(int(w).bit_count() for w in code if w) == 7
    rng = np.random.default_rng(2)
    a = rng.integers(-(1 << 63), 1 << 63, 3000)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1 << int(bit)).view(np.int64)
    index = set(zip(*(c.tolist() for c in simhash.keys(a, False))))
    met = {r for r, k in zip(*(c.tolist() for c in simhash.keys(b, True))) if (r, k) in index}
    assert met == set(range(len(a)))


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base_text = [rng.choice(words) for _ in range(200)]
    texts = [" ".join(w if rng.random() > 0.004 else "Zed" for w in base_text) for _ in range(150)] + [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)] + [None, "A b"]

    def plain(t):
        w = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = [plain(t) for t in texts]
    parent = list(range(len(fps)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {(i, f"{f:016x}", root(i)) for i, f in enumerate(fps)}
    table = docs(spark, texts)
    assert {tuple(r) for r in simhash.simhash_components(table).collect()} == want
    nodes = base.stash(simhash.fingerprints(table).select("fp").distinct())
    few = base.connected_components(simhash.links(nodes)).groupBy("component").count().count()
    crowded = base.connected_components(simhash.links(nodes, bucket=1, part=8)).groupBy("component").count().count()
    assert few == crowded


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_suffixes_against_brute_force(spark, crowd, monkeypatch):
    rng = random.Random(7)
    passage = ["".join(rng.choice("abcd é") for _ in range(rng.randint(90, 260))) for _ in range(4)]
    texts = ["".join(rng.choice([rng.choice(passage), "".join(rng.choice("xyz") for _ in range(rng.randint(0, 120)))]) for _ in range(rng.randint(0, 7))) for _ in range(60)]
    texts += [None, "", "q" * 350, "q" * 99, texts[0]]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[i] = (len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    plain = suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", lambda d, length: plain(d, length, task_bytes=8000, crowd=crowd))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(docs(spark, texts)).collect()}
    assert got == want


def test_suffixes_of_a_crowded_gram_do_not_meet_in_one_task(spark, monkeypatch):
    """One passage in 400 documents with different surroundings: the sort's largest task has no row for each of them."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh") for _ in range(180))
    letters = lambda: "".join(rng.choice("uvwxyz") for _ in range(60))
    largest, plain = [0], PandasGroupedOpsMixin.applyInArrow

    def spy(self, func, schema):
        largest.append(max((r["count"] for r in self._df.groupBy("task").count().collect()), default=0))
        return plain(self, func, schema)

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", spy)
    table = spark.createDataFrame([(i, i, letters() + passage + letters()) for i in range(400)], "doc_id long, version long, text string").repartition(3)
    spans = suffixes.repeated_spans(table, task_bytes=4000, crowd=50).groupBy("doc_id").agg(F.min("start").alias("a"), F.max("end").alias("b")).collect()
    assert {r.doc_id for r in spans if r.a <= 60 and r.b >= 240} == set(range(1, 400)) and all(r.doc_id for r in spans if r.b - r.a >= 180)
    assert max(largest) < 400


def test_suffix_ranks():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.integers(1, int(rng.choice([2, 3, 300])) + 1, int(rng.integers(0, 60)))
        assert np.argsort(suffixes.suffix_ranks(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = base.table(spark, SF, "documents").unionByName(docs(spark, HARD, range(10_000, 10_010)).select("doc_id", "text", "lang", "source", "n_chars"))
    path = packing.public_tokenizer()
    plain, want = Tokenizer.from_file(path), {}
    for r in rows.collect():
        want[r.doc_id] = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
    got, sequences = {}, {}
    for r in packing.pack_documents(rows, path, with_ids=True).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
    assert {k: [i for _, ids in sorted(v) for i in ids] for k, v in got.items()} == want
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2] and at <= 4096 and at & (at - 1) == 0


def test_edit_counts_equal_a_fresh_count():
    from tokenizers import Tokenizer

    path, rng = packing.public_tokenizer("byte_bpe_50k.json"), random.Random(4)
    plain, count = Tokenizer.from_file(path), token_counts.Counter(path)
    plainly = "ab é' \n\ts1.9ßre   "
    added = ["<|endoftext|>", "<|endoftext|>", "<|", "endoftext", "|>", "<", "|", " ", "a", "!", "  ", "<|endof", "text|>"]
    assert token_counts.Tree("a <|endoftext|> b", count).total == 4 and token_counts.Tree("<|endoftext|>", count).total == 1
    for turn in range(3000):
        letters = added if turn % 2 else plainly
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([3, 30, 300]))))
        tree = token_counts.Tree(s, count, fan=rng.choice([2, 4, 64]))
        for _ in range(rng.randint(1, 5)):
            a = rng.randint(0, len(s))
            b = min(len(s), a + rng.choice([0, 1, 5, 60]))
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 0, 1, 5, 40])))
            tree.replace(a, b, new)
            s = s[:a] + new + s[b:]
            assert tree.text() == s and tree.total == len(plain.encode(s, add_special_tokens=False).ids)
    long = "word " * 20_000
    tree = token_counts.Tree(long, count)
    tree.replace(50_000, 50_004, "<EMAIL>")
    assert tree.encoded < 200 and tree.total == len(plain.encode(long[:50_000] + "<EMAIL>" + long[50_004:], add_special_tokens=False).ids)


def test_language_on_held_out_documents(spark):
    got = catalog.QUERIES["op3_language"](spark, SF).join(base.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_toxicity_learns_words_and_leaves_clean_texts(spark):
    rng = random.Random(3)
    clean = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(600)]
    texts = [t if i % 4 else t[:100] + " vile " + t[100:] + " rotten" for i, t in enumerate(clean)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts), toxicity.train(docs(spark, texts), labels)).collect()}
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in range(400, 600)) >= 190


def test_extraction_of_pages(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p>One  <b>two\n</b><br>three<p>Fo&#117;r &lt;x&gt;<script>"</p>"</script><div class="comments"><p>Nice</p></div></article><footer>&copy; F</footer>'
    menu = "<div><p>one two three four five six seven eight nine menu</p></div>"
    bare = [(i, "http://h.example/x", f"<body>{menu}<p>own words of page {i} stand here {i} and nowhere else {i}</p></body>") for i in range(1, 6)]
    rows = spark.createDataFrame([(0, "http://h.example/0", page), (9, None, None), *bare], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extraction.main_text(rows).collect()}
    assert got[0] == "A & B\n\nOne two three\n\nFour <x>" and got[9] == ""
    assert got[3].startswith("own words of page 3") and "menu" not in got[3]


def test_extraction_counts_repeats_over_whole_hosts(spark):
    """A notice on three of a large host's 1,500 pages goes, one on two stays, and the text does not change with other hosts' pages."""
    notice, twice = "<p>notice one two three four five six seven eight</p>", "<p>twice eight seven six five four three two one</p>"
    own = [(i, "http://large.example/x", f"<p>own words of page {i} stand here {i} and nowhere {i}</p>{notice if i in (100, 700, 1400) else ''}{twice if i in (100, 1400) else ''}") for i in range(1500)]
    small = [(5000 + i, "http://small.example/x", f"<p>small words of page {i} stand here {i} and nowhere {i}</p>{notice if i < 2 else ''}<footer><p>{'f ' * 9}</p></footer>") for i in range(3)]
    make = lambda rows: {r.page_id: (r.text, r.n_chars) for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    got = make(own + small + small[:2] * 3)
    want = {i: f"own words of page {i} stand here {i} and nowhere {i}" for i in range(1500)} | {5000 + i: f"small words of page {i} stand here {i} and nowhere {i}" for i in range(3)}
    for i in (100, 1400):
        want[i] += "\n\ntwice eight seven six five four three two one"
    for i in (5000, 5001):
        want[i] += "\n\nnotice one two three four five six seven eight"
    assert got == {i: (t, len(t)) for i, t in want.items()} and make(own) == {i: v for i, v in got.items() if i < 1500}


def test_mix_takes_whole_words_near_the_targets(spark):
    texts = [" ".join(["w"] * (i % 7)) for i in range(600)]
    table = docs(spark, texts, sources=[("a", "b", None)[i % 3] if i % 2 else "a" for i in range(600)])
    rows = mixing.fair_mix(table).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows) and sum(r.taken for r in rows) == int(1.5 * sum(r["size"] for r in rows))
    for source in ("a", "b", None):
        part = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 12
    assert mixing.mixed_documents(table).select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in rows)
