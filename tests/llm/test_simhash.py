import random

import numpy as np
import xxhash

from panelwise.llm.queries import op4_simhash
from panelwise.llm.simhash import components, fingerprint, near_pairs, simhash_groups

SMALL = "/root/testdata/sf0.001"


def plain(text: str) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: dict[int, int], bits: int = 3) -> dict[int, int]:
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in prints}


def test_fingerprint():
    for text in ("", "A b", "One TWO three", "É one\x0btwo x three four five one two three", "a " * 70_000, "x y z x y z x"):
        assert fingerprint(text.encode()) == plain(text)


def test_query_against_brute_force(spark, small):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash(spark, SMALL).collect()}
    prints = {r.doc_id: plain(r.text or "") for r in small.collect()}
    found = groups(prints)
    assert got == {i: (f"{p:016x}", found[i]) for i, p in prints.items()}


def test_every_pair_is_found(spark):
    draw = random.Random(5)
    values = {draw.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(6):
            w = v
            for _ in range(draw.randint(1, 5)):
                w ^= 1 << draw.randrange(64)
            values.add(w)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    got = {frozenset((r.a, r.b)) for r in near_pairs(spark.createDataFrame([(v,) for v in signed], "print long")).collect()}
    mask = (1 << 64) - 1
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert got == want


def test_components(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(draw.randrange(200, 300),) * 2 for _ in range(3)]
    edges += [(draw.randrange(400, 500), draw.randrange(400, 500)) for _ in range(60)]
    draw.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame([(b, a) for a, b in edges], "a long, b long")).collect()}
    root: dict[int, int] = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in list(root)}


def test_odd_documents(odd, none):
    rows = simhash_groups(odd).collect()
    assert len(rows) == odd.count()
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in rows if r.doc_id is not None}
    assert found[1] == found[2] == found[3] == ("0" * 16, 1)
    assert found[5] == found[6] and found[5][1] == 5 and found[4][1] == 4
    assert [r.component_id for r in rows if r.doc_id is None and r.text is None] == [1]
    assert [r.component_id for r in rows if r.doc_id is None and r.text] == [None]
    assert simhash_groups(none).count() == 0
