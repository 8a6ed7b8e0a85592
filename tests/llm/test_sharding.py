from collections import defaultdict

from panelwise.llm.sharding import shard_documents


def shards_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.shard].append(r)
    for members in out.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    return out


def test_bytes_are_near_equal(small):
    rows = shard_documents(small, shards=10).collect()
    assert len(rows) == small.count()
    assert all(r["size"] == len(r.text.encode()) + 16 for r in rows)
    sizes = [sum(r["size"] for r in m) for m in shards_of(rows).values()]
    assert max(abs(s - sum(sizes) / 10) for s in sizes) <= max(r["size"] for r in rows)


def test_large_group_of_equal_texts_is_split(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'one very common text', concat('text number ', id)) AS text")
    shards = shards_of(shard_documents(docs, shards=8).collect())
    sizes = [sum(r["size"] for r in m) for m in shards.values()]
    assert len(shards) == 8 and max(sizes) / min(sizes) < 1.06
    whole = shards_of(shard_documents(docs.where("id % 3 > 0 OR id < 9"), shards=8).collect())
    assert sum(any(r.text == "one very common text" for r in m) for m in whole.values()) == 1


def test_odd_documents(odd, none, spark):
    rows = shard_documents(odd, shards=3).collect()
    assert len(rows) == odd.count()
    shards_of(rows)
    assert {r.doc_id: r["size"] for r in rows if r.doc_id in (1, 2)} == {1: 16, 2: 16}
    assert shard_documents(none).count() == 0
    same = shard_documents(spark.sql("SELECT 1L AS doc_id, 'x' AS text FROM range(50)"), shards=4).collect()
    assert len(shards_of(same)) == 1  # rows equal in id and text stay together
    assert {r.shard for r in shard_documents(odd, shards=1).collect()} == {0}
