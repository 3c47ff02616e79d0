import random
import zlib

from colprobe.llm.sharding import shard_by_bytes


def test_contiguous_and_balanced(make_docs):
    rng = random.Random(4)
    texts = {n: "é" * rng.randint(0, 300) for n in rng.sample(range(10_000), 1000)}
    rows = shard_by_bytes(make_docs(list(texts.items())), 24).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == sorted(texts)
    total = sum(len(t.encode()) + 8 for t in texts.values())
    ahead, slots, held = 0, {}, {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        assert r["shard"] == ahead * 24 // total and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["slot"] == slots.get(r["shard"], 0)
        slots[r["shard"]] = r["slot"] + 1
        held[r["shard"]] = held.get(r["shard"], 0) + r["size"]
        ahead += r["size"]
    assert set(slots) == set(range(24))
    assert max(held.values()) - min(held.values()) <= 2 * max(r["size"] for r in rows)


def test_odd_rows(odd_docs, no_docs):
    rows = shard_by_bytes(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count() and {r["shard"] for r in rows} <= {0, 1, 2}
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert shard_by_bytes(no_docs, 3).count() == 0
