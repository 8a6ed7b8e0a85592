import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelwise.llm import minhash
from panelwise.llm.minhash import band_keys, minhash_groups, shingle_set, sketches
from panelwise.llm.queries import op11_minhash
from panelwise.sources.stages import stage

SMALL = "/root/testdata/sf0.001"


def plain(text: str | None) -> set[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in lowered).split(" ") if w]
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    sets = {i: plain(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def got(df) -> dict[int, tuple[int, int, bool]]:
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_shingles_are_those_of_the_text():
    for text in ("", " \n", "A b", "One TWO three", "É one\x0btwo x one\ttwo x one two x", "a " * 5_000):
        assert len(shingle_set(text.encode())) == len(plain(text))
    assert (shingle_set(b"A B c d") == shingle_set(b" a\nb C D")).all()


def test_sketches_fill_and_estimate():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 2, 7, 300, 20_000)]
    found = sketches(sets, 128)
    assert (found != minhash.EMPTY).all()
    assert (sketches(sets[3:4], 128) == found[3]).all()  # alone as among others
    base = draw.integers(0, 1 << 62, 1000).astype(np.uint64)
    other = np.concatenate([base[:800], draw.integers(0, 1 << 62, 200).astype(np.uint64)])
    a, b = sketches([base, other], 4096)
    assert abs((a == b).mean() - 800 / 1200) < 0.04
    assert len(np.unique(band_keys(found, 16, 5))) > 16


def test_a_batch_of_long_texts_is_not_held_whole(spark, monkeypatch):
    """Texts become objects and sets a run at a time, and runs change no answer."""
    texts = [None, "", "one", *(" ".join(f"t{i}w{j}" for j in range(500)) for i in range(400)), " \n"]
    batch = pa.array(texts)
    whole = next(minhash._sketched(3, 32, 5).func(iter([batch]))).to_pylist()
    sets = [shingle_set((t or "").encode()).view(np.int64).tolist() for t in texts]
    monkeypatch.setattr(minhash, "CELLS", 4096)
    sketched = minhash._sketched(3, 32, 5).func
    tracemalloc.start()
    got_runs = next(sketched(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got_runs.to_pylist() == whole and [r["n"] for r in whole] == list(map(len, sets))
    assert [s for part in minhash._sets(3).func(iter([batch])) for s in part.to_pylist()] == sets
    assert most < batch.nbytes


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got(op11_minhash(spark, SMALL)) == brute(docs)


def variants(seed: int, base: int, copies: int) -> list[tuple[int, str]]:
    """Groups around a base text, with texts on both sides of the threshold, chains and a common passage."""
    draw = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(30))
    out: list[str] = []
    for g in range(base):
        words = [f"g{g}w{draw.randrange(400)}" for _ in range(draw.randrange(35, 60))]
        for _ in range(copies):
            w = list(words)
            for _ in range(draw.randrange(0, 5)):
                spot = draw.randrange(len(w))
                w[spot : spot + draw.randrange(2)] = [f"x{draw.randrange(30)}"] * draw.randrange(0, 2)
            out.append(" ".join(w))
        chain = list(words)
        for _ in range(6):
            chain = chain[1:] + [f"c{draw.randrange(1000)}"]
            out.append(" ".join(chain))
    out += [f"{passage} " + " ".join(f"own{draw.randrange(10**6)}" for _ in range(draw.randrange(2, 25))) for _ in range(copies)]
    out += [out[0]] * 20 + [out[0].upper() + " \n"]
    draw.shuffle(out)
    return list(enumerate(out))


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)
    docs = variants(7, 2, 50)
    log: list[dict] = []
    frame = stage(spark.createDataFrame(docs, "doc_id long, text string"), "variants")
    assert got(minhash_groups(frame, log=log)) == brute(docs)
    assert len(log) > 1 and log[0]["to_center"] > 0


def test_one_bucket_for_all_is_still_exact(spark, monkeypatch):
    """Verification alone: everything shares a bucket, only the rounds of centers can find the links."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    docs = variants(11, 1, 30)
    sets = {s.tobytes(): (i, s) for i, t in docs if len(s := shingle_set(t.encode()))}
    rows = [(i, len(s), s.view(np.int64).tolist()) for i, s in sets.values()]
    table = stage(spark.createDataFrame(rows, "node long, n long, set array<long>"), "all-sets")
    one = F.struct(F.lit(0).cast("long").alias("group"), F.lit(1).cast("long").alias("shingle")).alias("bucket")
    entries = stage(table.select(one, "node", "n", F.lit(True).alias("far")), "all-entries")
    roots = {r.node: r.root for r in minhash.components(minhash.class_links(entries, table, 85)).collect()}
    want = brute([(i, next(t for j, t in docs if j == i)) for i, _, _ in rows])
    assert {i: roots.get(i, i) for i, _, _ in rows} == {i: c for i, (_, c, _) in want.items()}


def test_odd_documents(odd, none):
    rows = minhash_groups(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[4] == (1, 4, True) and by[5] == (7, 5, True) and by[6] == (7, 5, False)
    assert by[7][1:] == (7, True)
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None) == [(0, None, True), (7, None, True)]
    assert "own 4" in {r["print"] for r in rows}
    assert minhash_groups(none).count() == 0
