"""Operators on small hand-made tables: odd rows, odd columns, and brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellium.llm import (
    components, decontamination, embedding_dedup, jaccard_join, line_dedup, mixing, pii, scratch, secret_scan, sharding, spans, toxicity, url_filter,
)

LONG = "wort " * 60_000
TEXTS = [None, "", " \n\t", "a", "a", "one two three four five six seven eight nine ten eleven", LONG, "x\ny\nz\nx\ny\nz", "mail me@a.b.org or +1 234 567 8901", "token = abcdef123456"]
ADDED = ("size", "target", "taken", "position", "shard", "slot", "spans", "score", "items", "listed", "n_hit", "clean")
#: Names that operators use inside, or used, and one that needs quotes.
INSIDE = (
    "_rank", "_k", "_keep", "_cell", "_copies", "_key", "_found", "_scored", "_row", "_s", "_n", "_digest", "_group", "_weight", "_t", "my col", "a.b", "row", "said", "found",
    "key", "k", "n", "v", "w", "keep", "root", "starts", "hash", "label", "before", "rank", "at", "copy", "copies", "lines", "doc", "id", "r", "o", "low", "part", "best", "none",
)
CLASHES = (*ADDED, *INSIDE)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, "a", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "mix": lambda d: mixing.mix(d), "shard": lambda d: sharding.assign(d), "secrets": lambda d: secret_scan.scan(d, F.col("lang"), F.col("source")),
    "toxicity": lambda d: toxicity.score(d, toxicity.Model()), "lines": line_dedup.dedup, "pii": pii.scan,
    "join": lambda d: jaccard_join.join(d, jaccard_join.Rule()),
    "benchmark": lambda d: decontamination.scan(d, d.sparkSession.createDataFrame([(1, "one two three"), (1, None), (None, "a")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_and_empty_tables(odd, none, name):
    got = [r.asDict() for r in OPERATORS[name](odd).collect()]
    assert len(got) == odd.count()
    # extra columns keep their values, whatever their names
    assert name == "join" or all(r[c] == "clash" for r in got for c in INSIDE)
    assert OPERATORS[name](none).collect() == []


def test_pages_and_vectors_with_any_columns(spark):
    pages = spark.createDataFrame([(1, "x://a.com/fr/")], "page_id long, url string").withColumns({c: F.lit("clash") for c in INSIDE})
    got = url_filter.judge(pages).first().asDict()
    assert all(got[c] == "clash" for c in INSIDE) and got["rule"] == "com/fr/"
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in (*INSIDE, "label", "c", "e", "m", "least")})
    assert [r["n_links"] for r in embedding_dedup.dedup(vectors).collect()] == [1, 1]


def test_scratch_tables_go(spark, monkeypatch):
    before = set(scratch.LIVE)
    with scratch.scope():
        held = scratch.store(spark.range(3), "x")
        assert held.df.count() == 3
    assert set(scratch.LIVE) == before

    @scratch.tidy
    def fails():
        scratch.store(spark.range(3), "x")
        raise ValueError

    with pytest.raises(ValueError):
        fails()
    assert set(scratch.LIVE) == before

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        scratch.root(Cluster)


def test_filters_keep_the_columns(odd, none):
    rule, bench = jaccard_join.Rule(), odd.sparkSession.createDataFrame([(1, "eight nine ten")], "item_id long, text string")
    whole = " or ".join(f"not (`{c}` <=> 'clash')" for c in CLASHES)
    filters = (jaccard_join.keep_one(odd, rule), decontamination.remove(odd, bench), decontamination.remove(odd, bench, spans=True), mixing.emit(odd), toxicity.remove(odd, toxicity.Model()))
    for kept in filters:
        assert kept.columns == odd.columns and kept.where(whole).isEmpty()
    assert jaccard_join.keep_one(none, rule).isEmpty() and mixing.emit(none).isEmpty()


def test_no_labels_give_no_scores(odd, none):
    labels = none.sparkSession.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert model.weights == {} and all(r["score"] < 1e-6 for r in toxicity.score(odd, model).collect())


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 3000, 7).select(F.concat(F.lit("k"), "id").alias("key")).union(spark.createDataFrame([("other",), (None,)], "key string"))
    cascade = url_filter.build_cascade(url_filter.key_table(universe, listed).df)
    wrong = universe.withColumn("x", cascade.contains(F.col("key"))).where("x <> (cast(substring(key, 2) as int) % 7 = 0)")
    assert len(cascade.levels) > 1 and wrong.isEmpty()


def test_cascades_in_segments_are_exact(spark):
    urls = spark.range(4000).select(F.concat(F.lit("http://sub.k"), "id", F.lit(".net/x")).alias("url"), "id")
    listed = spark.range(0, 4000, 9).select(F.concat(F.lit("k"), "id", F.lit(".net")).alias("key"))
    keys = url_filter.key_table(spark.range(4000).select(F.concat(F.lit("k"), "id", F.lit(".net")).alias("key")), listed)
    assert len(url_filter.cascades(keys.df, 2000)) > 1
    got = url_filter.judge(urls, listed, (), max_bits=2000)
    assert got.where("listed <> (id % 9 = 0)").isEmpty() and got.count() == 4000


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/x?q#f", "x://org", "x://example.org/en/12", "x://example.com/de/", "x://badexample.org/es/", "a://spam-farm.example.net/q", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    for bits in (url_filter.MAX_BITS, 1):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, max_bits=bits).collect()}
        assert got[0] == got[1] == got[2] == ("", "", None, "allow")
        assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
        assert got[4] == ("org", "", None, "allow")
        assert got[5][2:] == ("example.org/en/1", "block") and got[6][2:] == ("com/de/", "block") and got[7][2:] == ("org/", "allow")
        assert got[8][2:] == (None, "block") and got[9][:2] == ("b:", "//c/d")
    assert url_filter.judge(pages.where("false")).isEmpty()


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i % 9 + 1), "big" if i % 10 else f"s{i % 7}") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    per = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(per["target"] - per["taken"]) <= 1).all() and (got["taken"] <= 3 * got["size"]).all()


def test_line_windows(spark):
    docs = spark.createDataFrame([(2, "a\nb\nc\nd\nb\nc\nd"), (1, "z\na\nb\nc"), (3, "\n\n\n\n"), (4, "b\nc")], "doc_id long, text string")
    got = {r["doc_id"]: (list(r["removed"]), r["clean"]) for r in line_dedup.dedup(docs).collect()}
    assert got == {1: ([], "z\na\nb\nc"), 2: ([0, 1, 2, 4, 5, 6], "d"), 3: ([], "\n\n\n\n"), 4: ([], "b\nc")}


def test_spans_of_hard_texts(spark):
    texts = ["a@b.c_x@d.com a.b@c ñ" * 40, "1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111-1111 1111 é 4111111111111111", "+1 (234) 567-8901", "9" * 20_000, "a" * 20_000 + "@"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, p in plain.items():
        found = docs.select("doc_id", spans.find(F.col("text"), pii.PATTERNS[kind]).alias("s")).collect()
        for r in found:
            if r["doc_id"] < 4:
                assert [(x["start"], x["end"]) for x in r["s"]] == [m.span() for m in re.finditer(p, texts[r["doc_id"]])]


def test_ownership_tells_examples_from_live_secrets(spark):
    secret, example = "aB3dE6gH9jK2mN5pQ8sT1vW4", "zY9xW8vU7tS6rQ5pO4nM3lK2"
    rows = [(0, f"see {secret} here", "s0")] + [(i, f"copy {example} there", f"s{i}") for i in range(1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in secret_scan.scan(docs, F.col("source"), F.col("source")).collect()}
    assert got == {0: ["owned"], 1: [], 2: [], 3: [], 4: []}


def test_em_finds_the_reliable_labelers():
    random.seed(3)
    cells = {}
    for _ in range(4000):
        y = random.random() < 0.6
        votes = tuple(int(random.random() < (p if y else 1 - p)) for p in (0.9, 0.8, 0.7, 0.6, 0.55))
        cells["email", votes, 0] = cells.get(("email", votes, 0), 0) + 1
    trust, prior, _ = pii.estimate([(*k, n) for k, n in sorted(cells.items())])
    assert abs(trust["format"][0] - 0.9) < 0.06 and trust["format"][0] > trust["context"][0] > trust["monotony"][0]
    assert abs(prior["email"] - 0.6) < 0.08


def test_benchmark_parts_agree(spark):
    words = [f"w{i}" for i in range(60)]
    random.seed(5)
    items = [(i, " ".join(random.choices(words, k=random.choice([3, 9, 10, 14])))) for i in range(30)]
    docs = [(i, " ".join([*random.choices(words, k=20), items[i % 30][1].upper(), *random.choices(words, k=9)])) for i in range(50)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (sorted(map(str, decontamination.scan(d, b, n).select("doc_id", "n_words", "n_hit", "items").collect())) for n in (1 << 20, 3000))
    assert whole == parts and all("n_hit=0" not in x for x in whole)


def brute_components(texts, rule):
    sets, root = [], list(range(len(texts)))
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        sets.append({tuple(w[i : i + rule.n]) for i in range(len(w) - rule.n + 1)} if len(w) >= rule.n else ({tuple(w)} if w else set()))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and rule.linked(len(a & b), len(a), len(b)):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("rule", "block"), [(jaccard_join.Rule(4, 85, 100), 512), (jaccard_join.Rule(1, 80, 100), 8)])
def test_join_equals_brute_force(spark, monkeypatch, rule, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    random.seed(7)
    words, texts = [f"w{i}" for i in range(50)], []
    for _ in range(60):
        base = random.choices(words, k=random.choice([1, 3, 7, 9, 12, 13, 14, 16, 20, 30, 60, 90]))
        for _ in range(random.randint(1, 6)):
            w = base[:]
            for _ in range(random.randint(0, 2)):
                w[random.randrange(len(w))] = random.choice(words)
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, comp = brute_components(texts, rule)
    low = {}
    for i, c in enumerate(comp):
        low.setdefault(c, i)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs, rule).collect()}
    assert got == {i: (len(s), low[c]) for i, (s, c) in enumerate(zip(sets, comp, strict=True))}


def test_join_of_sets_whose_numbers_clash(spark, monkeypatch):
    plain = jaccard_join.signatures

    def few(tokens, bounds):
        first, second = plain(tokens, bounds)
        return first & np.uint64(7), second

    texts = [f"{a} {b} {c} {d}" for a in "ab" for b in "cde" for c in "fg" for d in "hij"] + ["a c f h"] * 3 + ["a  c f h x"]
    docs = spark.createDataFrame([(f"d{i:02}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    monkeypatch.setattr(jaccard_join, "signatures", few)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs, jaccard_join.Rule(4, 85, 100)).collect()}
    want = {f"d{i:02}": f"d{texts.index(t):02}" for i, t in enumerate(texts)}
    assert got == want and jaccard_join.keep_one(docs, jaccard_join.Rule(4, 85, 100)).count() == len(set(texts))


def test_a_family_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 12)
    random.seed(13)
    words = [f"w{i}" for i in range(400)]
    base = random.choices(words, k=90)
    texts = []
    for _ in range(150):
        w = base[:]
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = random.choice(words)
        texts.append(" ".join(w))
    rule = jaccard_join.Rule(4, 85, 100)
    _, comp = brute_components(texts, rule)
    low = {}
    for i, c in enumerate(comp):
        low.setdefault(c, i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs, rule).collect()}
    assert got == {i: low[c] for i, c in enumerate(comp)}
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one(docs, rule).collect()) == sorted(set(low.values()))


@pytest.mark.parametrize("block", [8])
def test_join_counts_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rule, words = jaccard_join.Rule(4, 85, 100), [f"w{i}" for i in range(50)]
    random.seed(11)
    texts = [None, "", "  "]
    for size, copies in ((60, 30), (200, 12), (14, 9), (3, 4)):
        base = random.choices(words, k=size)
        for _ in range(copies):
            w = base[:]
            for _ in range(random.randint(0, 2)):
                w[random.randrange(len(w))] = random.choice(words)
            texts.append(" ".join(w))
    texts += texts[3:9]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    sets, _ = brute_components([*texts, texts[3]], rule)
    want = [sum(i != j and bool(a and b) and rule.linked(len(a & b), len(a), len(b)) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = jaccard_join.join(docs, rule, count=True).select("doc_id", "n_links").collect()
    assert max(want) > 2 and sorted(map(tuple, got)) == sorted(zip([*range(len(texts)), 3], want, strict=True))


def test_shared_shingles_by_pairs_and_by_products(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 90, 40).astype(np.uint64)) for _ in range(20)]
    i, j = np.tril_indices(20, -1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    monkeypatch.setattr(jaccard_join, "COLUMNS", 7)
    for cost in (0, 1 << 40):
        monkeypatch.setattr(jaccard_join, "PAIR_COST", cost)
        assert jaccard_join._common(sets, i, j).tolist() == want


def test_links_of_the_table(spark, sf):
    from trellium.llm import queries

    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rule = jaccard_join.Rule(4, 85, 100)
    sets, comp = brute_components([t for _, t in texts], rule)
    low, want = {}, []
    for (i, _), c in zip(texts, comp, strict=True):
        low.setdefault(c, i)
    for k, a in enumerate(sets):
        n = sum(k != x and bool(a and b) and rule.linked(len(a & b), len(a), len(b)) for x, b in enumerate(sets))
        want.append((texts[k][0], len(a), n, low[comp[k]]))
    got = queries.op10_jaccard_links(spark, sf).select("doc_id", "n_shingles", "n_links", "component_id").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_embeddings_against_brute_force(spark, shard_rows):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base + s * rng.normal(size=base.shape) for s in (0, 0.05, 0.1, 0.15)] + [base[:5], base[:1] * 2])
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 0), (904, x[0].tolist(), None), (905, [1.0], 0), (906, [], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.dedup(df, shard_rows=shard_rows).collect()}
    n = np.sqrt((x * x).sum(1))
    link = (x @ x.T / np.outer(n, n) >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.9 * link.sum() and all(got[i]["n_links"] <= link[i].sum() for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 907))
    assert embedding_dedup.dedup(df.where("false")).isEmpty()


def test_cosines_of_vectors_of_any_size(spark):
    rows = [(i, [x, 0.0], 1) for i, x in enumerate((1e-200, 2e-200, 1e200, 2e200))] + [(4, [0.0, 5e-324], 1), (5, [1e-300, 1e308], 1), (6, [-1e200, 0.0], 1)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1, 6: 0}


def test_long_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 768))
    x = np.concatenate([base, *[base[:200] + s * rng.normal(size=(200, 768)) for s in (0.05, 0.1, 0.19, 0.22)]])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    n = np.sqrt((x * x).sum(1))
    link = x @ x.T / np.outer(n, n) >= 0.98
    np.fill_diagonal(link, False)
    for shard_rows in (300, 1 << 14):
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.dedup(df, shard_rows=shard_rows).collect()}
        assert sum(got.values()) >= 0.97 * link.sum() and all(got[i] <= link[i].sum() for i in got)


def test_repeated_vectors(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (1, [-2.0, 1.0], 0), (None, [1.0, 2.0], 0), (5, [2.0, 4.0], 0), (7, [1.0, 2.0], None), (None, [5.0, 5.1], 1), (None, [5.1, 5.0], 1)]
    got = embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = [(1, 0, 1), (1, 3, 1), (1, 3, 1), (5, 3, 1), (7, 0, 7), (None, 1, None), (None, 1, None), (None, 3, 1)]
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=str) == want


@pytest.mark.parametrize("n", [300, 1500])
def test_all_points_linked(n):
    rng = np.random.default_rng(4)
    x = rng.normal(size=16) * 30 + rng.normal(size=(n, 16))
    ids = np.arange(n) * 7919 + 1
    a = embedding_dedup.Shard(ids, ids, np.ones(n, np.int64), x)
    a.ef = embedding_dedup._beam(a, a, embedding_dedup.BEAM, 0.98)
    got = embedding_dedup._links(a, a, 0.98)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    link = unit @ unit.T >= 0.98
    np.fill_diagonal(link, False)
    degree = got[got["n"] > 0].set_index("c")["n"].to_dict()
    assert link.sum() > n * n / 2 and sum(degree.values()) >= 0.99 * link.sum()
    assert all(degree.get(c, 0) <= k for c, k in zip(ids.tolist(), link.sum(1).tolist(), strict=True))


@pytest.mark.parametrize("hub", [200_000, 3])
def test_components_of_chains_and_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {201: 200}
    assert {r["u"]: r["root"] for r in found.df.collect()} == want
    more = components.extended(found, spark.createDataFrame([(139, 201), (300, 40), (400, 401), (5, 5)], "u long, v long"))
    want |= {200: 100, 201: 100, 300: 0, 401: 400}
    assert {r["u"]: r["root"] for r in more.df.collect()} == want


def test_toxicity_finds_the_sentence():
    random.seed(2)
    clean = [f"w{i}" for i in range(80)]
    texts, labels = [], []
    for k in range(300):
        s = [" ".join(random.choices(clean, k=6)) for _ in range(random.randint(1, 8))]
        bad = k % 3 == 0
        if bad:
            s[random.randrange(len(s))] += " vile"
        texts.append(". ".join(s))
        labels.append(int(bad))
    model = toxicity.fit(texts, labels)
    cache = toxicity.weight_cache(model)
    score, offending = toxicity.score_text("w1 w2 w3. w4 VILE w5. w6 w7", model.bias, cache)
    assert score >= 0.5 and [(a, b) for a, b, _ in offending] == [(9, 20)]
    assert toxicity.score_text("w1 w2. w3 w4", model.bias, cache)[0] < 0.5 and toxicity.score_text("", model.bias, cache) == (0.0, [])


def test_sentences_are_places_in_the_text_as_given():
    model = toxicity.Model(-3.0, {toxicity.features("vile")[0]: 9.0})
    text = "\u0130\u0130\u0130\u0130 ok. Vile x."
    _, offending = toxicity.score_text(text, model.bias, toxicity.weight_cache(model))
    assert [text[a:b] for a, b, _ in offending] == [" Vile x"]


def test_long_items_and_shared_windows(monkeypatch, spark):
    monkeypatch.setattr(decontamination, "PIECE", 7)
    words = [f"w{i}" for i in range(300)]
    random.seed(8)
    long_item = random.choices(words, k=120)
    items = [("long", " ".join(long_item)), ("same", " ".join(long_item[20:45])), ("b", "W1, w2"), ("b2", "w1 w2")]
    texts = [" ".join(long_item[k : k + 14]) for k in range(0, 106, 5)] + ["x w1 w2 y", "w1 x w2", " ".join(long_item[:9])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())

    want = []
    for i, t in enumerate(texts):
        w, hit, names = split(t), set(), set()
        for name, item in items:
            x = split(item)
            size = min(10, len(x))
            runs = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)}
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in runs:
                    hit |= set(range(k, k + size))
                    names.add(name)
        want.append((i, len(w), len(hit), sorted(names)))
    for limit in (1 << 20, 1500):
        got = decontamination.scan(docs, bench, max_bytes=limit).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got) == want


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontamination.texts, "gram_hashes", lambda words, n: np.zeros(max(0, len(words) - n + 1), np.uint64))
    import pyarrow as pa

    known = decontamination.gram_set(["a", "b", "a"], np.array([2, 2, 2]), pa.array(["x y z", "y z q", "y z"], pa.large_string()))
    counts, hits, names, spots = decontamination._scan_slice(pa.array(["o y z p", "z q", "q z", "X,Y"]), known)
    assert (counts, hits) == ([4, 2, 2, 2], [2, 2, 0, 2]) and names == [["a", "b"], ["b"], [], ["a"]] and spots[0] == [1, 2]


def test_decontamination_in_parts_equals_one_scan(spark):
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(words[k * 5 : k * 5 + 12])) for k in range(6)] + [(9, "only three words"), (None, "w1"), (10, None)]
    texts = [" ".join(words[:30]), " ".join(words[7:19]) + " x " + " ".join(words[:11]), "Only THREE, words", "", None, "clean text"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found(limit):
        got = decontamination.scan(docs, bench, max_bytes=limit).collect()
        return sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_hit, list(r["items"]), sorted(r._spots)) for r in got)

    parts = found(400)
    assert parts == found(1 << 20)
    assert sum(x[2] > 0 for x in parts) == 5
