import random
import zlib
from collections import defaultdict

from icekeel.llm import sharding


def test_least_capacity_by_brute_force():
    r = random.Random(1)

    def needed(sizes, c):
        n, free = 0, 0
        for s in sizes:
            if s > free:
                n, free = n + 1, c
            free -= s
        return n

    for _ in range(50):
        sizes, k = [r.randint(1, 30) for _ in range(r.randint(1, 25))], r.randint(1, 6)
        want = next(c for c in range(max(sizes), sum(sizes) + 1) if needed(sizes, c) <= k)
        assert sharding.least_capacity(sizes, k) == want


def test_cut_keys_is_exact(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "MORE_BITS", 4)
    r = random.Random(2)
    for n, k in ((0, 3), (1, 3), (40, 7), (600, 9), (5, 8)):
        rows = sorted({r.randint(-(1 << 63), (1 << 63) - 1): r.choice([1, 5, 90, 1000]) for _ in range(n)}.items())
        groups = spark.createDataFrame(rows, "key long, bytes long")
        capacity, cuts = sharding.cut_keys(groups, k)
        sums = defaultdict(int)
        for key, size in rows:
            sums[sum(c <= key for c in cuts)] += size
        best = sharding.least_capacity([s for _, s in rows], k)
        assert len(cuts) < k
        assert max(sums.values(), default=0) <= best
        if n:
            assert capacity == best


def test_rows_and_slots(spark):
    texts = [None, "", "a", "hot", "hot", "é" * 50] + ["hot"] * 20 + [f"t{i}" * (i % 9) for i in range(60)]
    docs = spark.createDataFrame([(i if i != 9 else None, t, 1, 2) for i, t in enumerate(texts)] + [(3, "hot", 1, 2)], "doc_id long, text string, size int, shard int")
    got = sharding.shard(docs, 5).collect()
    assert len(got) == len(texts) + 1
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            t = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "bytes", None)
            by_text[t].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(5))


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 40).collect() == []
