"""Every query against its SQL, or against brute force where SQL cannot express it."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import assert_matches

from trellium.llm import oracles, queries, sharding, toxicity

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    assert_matches(spark, sf, queries.queries()[name], SQL[name])


def test_shards_are_minimax(spark, sf):
    rows = queries.op3_sharding(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    groups, shard_of, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        key = hashlib.sha256(raw).hexdigest()
        groups[key] += r["size"]
        shard_of[key].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    low = least_capacity([groups[k] for k in sorted(groups)])
    sizes = defaultdict(int)
    for k, w in groups.items():
        sizes[next(iter(shard_of[k]))] += w
    assert max(sizes.values()) == low


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op5_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) > 0.95


def luhn(t):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(t))) % 10 == 0


def bare(m):
    return re.sub("[^0-9]", "", m[0])


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(bare(m)) <= 19 and luhn(bare(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(bare(m)) <= 15),
)


def listing(text, kinds):
    found = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_pii_base_spans(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op9_pii(spark, sf).collect():
        base = listing(texts[r["doc_id"]], PII)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert all(x in r["spans"].split(",") for x in base.split(",") if x)


def near_sets(text, n):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def kept_by_score(rows, model):
    """The noisy-or of the sentences' logistic scores, word for word."""

    def rejected(text):
        left = 1.0
        for sentence in re.findall(r"[^.!?\n]+", text or ""):
            words = set(re.findall(r"[^\W\d_]+", sentence.lower()))
            if words:
                z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w))
                left *= 1 - 1 / (1 + math.exp(-z))
        return 1 - left >= 0.5

    return {i for i, t in rows.items() if not rejected(t)}


def kept_of_families(rows):
    sets = {i: near_sets(t or "", 5) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i in ids if find(i) == i}


def kept_clean(rows, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = set()
    for x in map(words, items):
        size = min(10, len(x))
        windows |= {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if size else set()
    lengths = {len(w) for w in windows}
    return {i for i, t in rows.items() for w in [words(t)] if not any(tuple(w[k : k + n]) in windows for n in lengths for k in range(len(w) - n + 1))}


def copies_of_mix(rows, sources):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows.items()}
    names = sorted({s for s in sources.values() if s is not None}) + ([None] if None in sources.values() else [])
    total = {n: sum(size[i] for i in rows if sources[i] == n) for n in names}
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    target, open_, left = {}, set(names), sum(total.values())
    while True:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > 3 * total[n]}
        if not over:
            target |= share
            break
        for n in over:
            target[n] = 3 * total[n]
            left -= 3 * total[n]
        open_ -= over
    out = {}
    for n in names:
        before, passes = 0, int(target[n] // total[n]) if total[n] else 0
        part = math.floor(target[n] - passes * total[n] + 0.5)
        for i in sorted((i for i in rows if sources[i] == n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            taken = passes * size[i] + max(0, min(size[i], part - before))
            before += size[i]
            if taken > 0 and (c := taken // size[i] + (2 * (taken % size[i]) >= size[i])):
                out[i] = c
    return out


def test_every_stage_against_brute_force(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").where(queries.fold() != 0)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "sharding"] and corpus_pipeline.ORACLE_SQL is None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs.collect()
        rows, sources = {r["doc_id"]: r["text"] for r in given}, {r["doc_id"]: r["source"] for r in given}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        if name == "toxicity":
            want = kept_by_score(rows, toxicity.train(spark.createDataFrame(given, docs.schema), labels))
        elif name == "near_copies":
            want = kept_of_families(rows)
        elif name == "decontamination":
            want = kept_clean(rows, items)
        elif name == "mixing":
            assert Counter(r["doc_id"] for r in got) == copies_of_mix(rows, sources)
            continue
        else:
            assert len(got) == len(given) and docs.columns == [*columns, "size", "shard", "slot"]
            groups, shard_of = defaultdict(int), {}
            for r in got:
                raw = (r["text"] or "").encode()
                assert r["size"] == len(raw) + 1
                groups[hashlib.sha256(raw).hexdigest()] += r["size"]
                assert shard_of.setdefault(hashlib.sha256(raw).hexdigest(), r["shard"]) == r["shard"]
            sizes = defaultdict(int)
            for g, w in groups.items():
                sizes[shard_of[g]] += w
            order = [shard_of[g] for g in sorted(groups)]
            assert order == sorted(order) and max(sizes.values()) == least_capacity([groups[g] for g in sorted(groups)])
            continue
        assert sorted(r["doc_id"] for r in got) == sorted(want), name
        assert k < 3 and docs.columns == columns and all(rows[r["doc_id"]] == r["text"] for r in got)


def least_capacity(order):
    def shards(capacity):
        n, held = 1, 0
        for w in order:
            n, held = (n + 1, w) if held + w > capacity else (n, held + w)
        return n

    low, high = max(order), sum(order)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if shards(mid) <= sharding.SHARDS else (mid + 1, high)
    return low


def test_pipeline_runs_its_stages(spark, sf, monkeypatch):
    import corpus_pipeline
    from trellium.llm import scratch

    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[2:])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = set(scratch.LIVE)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "size", "shard", "slot"] and 0 < out.select("doc_id").distinct().count() <= docs.count()
    # nothing stays but the last stage's table
    assert len(set(scratch.LIVE) - before) == 1


def test_scores_are_noisy_or(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").where(queries.fold() != 0)
    model = toxicity.train(docs, labels)
    assert model.weights
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, sf).collect()}
    assert set(got) == set(rows) and {i for i, r in got.items() if not r["predicted"]} == kept_by_score(rows, model)
    assert all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_added_spans_are_what_the_classifier_takes(spark):
    from trellium.llm import pii

    said = ["call me: (212) 555-0187 now", "order 212 555 0187", "ssn 078-05-1120", "IBAN DE89 3704 0044 0532 0130 00", "mail a@b.org", "+1 212 555 0187"] * 4
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    patterns = {k: re.compile(pii.PATTERNS[k]) for k in pii.KINDS[len(pii.BASE) :]}
    found = {(r["doc_id"], x["kind"], x["start"], x["end"]) for r in pii.candidates(docs.select("doc_id", "text")).select("row.doc_id", "found").collect() for x in r["found"]}
    for i, t in enumerate(said):
        base = [(a, b) for d, k, a, b in found if d == i and k in pii.BASE]
        for kind, p in patterns.items():
            want = {m.span() for m in p.finditer(t) if not any(a < m.end() and m.start() < b for a, b in base)}
            assert {(a, b) for d, k, a, b in found if d == i and k == kind} == want
    kept = {(r["doc_id"], x["kind"], x["start"], x["end"]): x["score"] for r in pii.scan(docs).collect() for x in r["spans"]}
    assert set(kept) <= found and all(k in pii.BASE or s >= pii.ADD for (_, k, _, _), s in kept.items()) and {x for x in found if x[1] in pii.BASE} <= set(kept)
