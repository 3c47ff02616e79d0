import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from colprobe.llm import near_dedup as nd


def bag(text):
    words = (text or "").split()
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def groups(texts):
    """Smallest id of each row's group, all pairs compared."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = {i: bag(t) for i, t in texts.items()}
    for a, b in combinations(sorted(texts), 2):
        if bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= 0.8:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_registers_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(80):
        hashes = rng.integers(0, 2**63, 60).astype(np.uint64)
        a = rng.integers(0, 7, 60)
        b = np.where(rng.random(60) < 0.6, a, rng.integers(0, 7, 60))
        owner = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        found = nd.sketch(owner, np.r_[hashes[a > 0], hashes[b > 0]], np.r_[a[a > 0], b[b > 0]], 2)
        errors.append((found[0] == found[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_sketch_does_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 300).astype(np.uint64)
    counts = rng.integers(1, 40, 300)
    alone = nd.sketch(np.zeros(300, int), hashes, counts, 1)
    both = nd.sketch(np.r_[np.zeros(5, int), np.ones(300, int)], np.r_[hashes[:5], hashes], np.r_[counts[:5], counts], 2)
    assert (alone[0] == both[1]).all()


def test_overlap_is_that_of_the_bags():
    rng = random.Random(3)
    shingler = nd.Shingler()
    for _ in range(200):
        texts = [" ".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(2)]
        raw = []
        for text in texts:
            shingles, counts = shingler.shingles(text)
            raw.append(np.sort(np.repeat((shingles >> np.uint64(32)).astype("<u4"), counts)).tobytes())
        assert nd.overlap(*raw) == pytest.approx(jaccard(*map(bag, texts)))


def planted(seed=5):
    """Chains of edited copies, exact copies, a shared passage and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(4000)]
    passage = rng.choices(vocabulary, k=60)
    texts, ident = {}, 0
    for family in range(25):
        words = rng.choices(vocabulary, k=rng.choice([12, 60, 200, 400]))
        if family % 2:
            words += passage
        for _ in range(rng.randint(1, 9)):
            texts[ident] = " ".join(words)
            ident += 1
            if rng.random() < 0.7:  # edits add up, so that ends of a chain differ
                words = list(words)
                for _ in range(max(1, len(words) // 60)):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
    order = list(texts.values())
    rng.shuffle(order)
    return dict(enumerate(order))


@pytest.mark.parametrize("bucket", [64, 2])
def test_groups_are_those_of_all_pairs(make_docs, monkeypatch, bucket):
    monkeypatch.setattr(nd, "BUCKET", bucket)
    texts = planted()
    expected = groups(texts)
    size = Counter(expected.values())
    rows = nd.near_duplicates(make_docs(list(texts.items()))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["keep_id"] == expected[r["doc_id"]]
        assert r["group_size"] == size[expected[r["doc_id"]]]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def template(seed=7):
    """Variants of one text, mostly less than 0.8 alike, and pairs at 0.8 that share nothing else."""
    rng = random.Random(seed)
    base = [f"w{n}" for n in range(100)]
    texts, fresh = [], iter(range(10**9))

    def variant(*places):
        words = list(base)
        for place in places:
            words[place : place + 5] = [f"own{next(fresh)}" for _ in range(5)]
        texts.append(" ".join(words))

    for place in range(5, 95, 15):
        variant(place)
        variant(place)
    for _ in range(400):
        variant(*rng.sample(range(4, 92), 2))
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_links_within_a_large_bucket(make_docs, monkeypatch):
    """All texts share one bucket, so that no other one can help."""
    real, one = nd.sketches, F.array(F.lit(1).cast("bigint"))
    monkeypatch.setattr(nd, "sketches", lambda docs: real(docs).withColumn("bands", one))
    texts = template()
    expected = groups(texts)
    assert len(texts) - len(set(expected.values())) >= 6
    rows = nd.near_duplicates(make_docs(list(texts.items()))).collect()
    assert {r["doc_id"]: r["keep_id"] for r in rows} == expected


@pytest.mark.parametrize("block", [1024, 3])
def test_prefixes_lose_no_pair(spark, monkeypatch, block):
    """Random bags with repeated and frequent shingles: candidates hold all near pairs."""
    monkeypatch.setattr(nd, "PREFIX_BLOCK", block)
    monkeypatch.setattr(nd, "BUCKET", 1)
    rng = np.random.default_rng(8)
    bags = []
    for _ in range(12):
        core = rng.zipf(1.6, rng.integers(3, 60)) % 200
        bags += [np.r_[core, rng.zipf(1.6, rng.integers(0, 9)) % 200] for _ in range(8)]
    bags = [np.sort(b).astype("<u4") for b in bags]
    near = {
        (a, b)
        for a, b in combinations(range(len(bags)), 2)
        if nd.overlap(bags[a].tobytes(), bags[b].tobytes()) >= nd.SIMILARITY
    }
    rows = [(0, n, len(b), len(bags), n) for n, b in enumerate(bags)]
    mixed = spark.createDataFrame(rows, "key bigint, node bigint, weight bigint, size bigint, `group` bigint")
    frame = spark.createDataFrame([(n, b.tobytes()) for n, b in enumerate(bags)], "node bigint, bag binary")
    found = {(r["a"], r["b"]) for r in nd.large_bucket_pairs(mixed, frame).collect()}
    assert len(near) > 50 and near <= found and len(found) < 96 * 95 / 2


def test_components_of_a_long_chain(spark):
    chain = [(n, n + 1) for n in range(300)]
    random.Random(1).shuffle(chain)
    links = spark.createDataFrame([*chain, (902, 901)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in nd.components(links).collect()}
    assert len(found) == 301 and found.pop(902) == 901
    assert set(found.values()) == {0}


def test_odd_rows(odd_docs, no_docs):
    rows = nd.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by_id[n]["kept"] and by_id[n]["group_size"] == 1 for n in (1, 2, 3, 6, 7, 8))
    assert by_id[5]["keep_id"] == 4 and by_id[5]["group_size"] == 3 and not by_id[5]["kept"]
    assert all(r["kept"] for r in rows if r["doc_id"] is None)
    assert nd.near_duplicates(no_docs).count() == 0


def test_rows_are_known_by_id_and_text(make_docs):
    """An id with a near copy of another text and a text of its own keeps the latter."""
    rng = random.Random(11)
    one = [f"w{rng.randrange(900)}" for _ in range(80)]
    near = [*one[:-1], "other"]
    own = " ".join(f"v{n}" for n in range(40))
    rows = [(1, " ".join(one)), (5, " ".join(near)), (5, own), (5, own), (6, " ".join(near)), (None, own), (7, None)]
    docs = make_docs(rows)
    kept = nd.first_of_groups(docs)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted([rows[0], rows[2], rows[3], rows[5], rows[6]], key=str)


def test_slots_count_all_tokens(spark):
    rng = np.random.default_rng(3)
    bags = [np.sort(rng.zipf(1.5, 50) % 300).astype("<u4") for _ in range(40)]
    frame = spark.createDataFrame([(b.tobytes(),) for b in bags], "bag binary").repartition(7)
    tokens = np.concatenate([nd._tokens(b.tobytes()) for b in bags])
    assert (nd._token_counts(frame) == np.bincount(nd._slots(tokens), minlength=nd.SLOTS)).all()
    assert len(set(nd._tokens(bags[0].tobytes()).tolist())) == len(bags[0])
