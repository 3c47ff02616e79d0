import hashlib
import random
import re
from collections import Counter, defaultdict

from colprobe.llm import exact_dedup as ed


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_normalised_bytes_match_the_pattern():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(" \t\n\r\x0b\x0c\x1c\x85　ab") for _ in range(rng.randint(0, 12)))
        assert ed._normalised(text) == norm(text).encode()


def test_trie_owners_with_and_without_spills():
    rng = random.Random(5)
    rows = [
        (b"pre" * rng.randint(0, 3) + bytes(rng.choices(b"ab", k=rng.randint(0, 6))), rng.randint(0, 99))
        for _ in range(4000)
    ]
    expected = {}
    for key, ident in rows:
        own = (ident, 1, 1)
        expected[key] = ed._merge(expected[key], own) if key in expected else own
    for limit in (10**9, 60, 1):
        trie = ed.PatriciaTrie(limit)
        for key, ident in rows:
            trie.insert(key, (ident, 1, 1))
        found = list(trie.items())
        assert len(found) == len(expected)
        assert dict(found) == expected


def test_null_owner_gives_way():
    assert ed._merge((None, 2, 2), (7, 1, 1)) == (7, 1, 3)
    assert ed._merge((7, 1, 1), (None, 2, 2)) == (7, 1, 3)
    assert ed._merge((None, 1, 1), (None, 1, 1)) == (None, 2, 2)


def test_odd_rows(odd_docs, no_docs):
    rows = [r.asDict() for r in ed.exact_duplicates(odd_docs).collect()]
    texts = odd_docs.select("doc_id", "text").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in texts)
    ids = defaultdict(list)
    for r in texts:
        ids[hashlib.sha256(norm(r["text"]).encode()).hexdigest()].append(r["doc_id"])
    for r in rows:
        own = [i for i in ids[r["text_sha256"]] if i is not None]
        assert r["keep_id"] == (min(own) if own else None)
        assert r["group_size"] == len(ids[r["text_sha256"]])
    kept = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert kept == Counter(ids.keys())  # one row of every group, also of repeated rows
    assert ed.exact_duplicates(no_docs).count() == 0


def test_first_copies_keep_columns(odd_docs, no_docs, make_docs):
    kept = ed.first_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(norm(r["text"]) for r in kept.collect()) == Counter(
        {norm(r["text"]) for r in odd_docs.collect()}
    )
    assert ed.first_copies(no_docs).count() == 0
    plain = make_docs([(n, f"text {n % 3}") for n in range(9)])
    assert sorted(r["doc_id"] for r in ed.first_copies(plain).collect()) == [0, 1, 2]
