"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP1 = rf"""
WITH sized AS (
  SELECT doc_id, source, {WORDS}::BIGINT AS size, md5('mix' || coalesce('|' || doc_id, '')) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source
), filling AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][nth % 3 + 1] AS weight, 3.0::DOUBLE * words AS most FROM sources
), levels AS (
  SELECT *, (sum(words) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filling
), targets AS (
  SELECT source, words, least(most, weight * (SELECT first(level ORDER BY most / weight, nth) FROM levels WHERE level <= most / weight)) AS target FROM levels
), quotas AS (
  SELECT *, ceil(target / greatest(1.0::DOUBLE, ceil((SELECT sum(target) FROM targets) / 2048)))::BIGINT AS quota FROM targets
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM sized
)
SELECT doc_id, size, words AS source_size, target::DOUBLE AS target,
  (size * CASE WHEN quota = 0 THEN 0 ELSE len(list_filter([0, 1, 2],
    lambda e: floor((e * words + start + size / 2.0::DOUBLE)::DOUBLE / (target / quota)) < quota)) END)::BIGINT AS taken
FROM placed JOIN quotas ON placed.source IS NOT DISTINCT FROM quotas.source
"""

# One round of the search: the edges around each open splitter, and whether one is near enough.
_ROUND = """
r{n} AS (
  SELECT *, below + bytes - goal AS up, goal - below AS down,
    least(goal - below, below + bytes - goal) <= near OR (lo_t = hi_t AND lo_i = hi_i) AS done
  FROM (
    SELECT number, goal, near, min(k.text_key) AS lo_t, max(k.text_key) AS hi_t, min(k.id_key) AS lo_i, max(k.id_key) AS hi_i,
      sum(k.size) AS bytes, min(k.before) AS below, {piece} AS piece
    FROM (SELECT * FROM {last} WHERE NOT done) open
    JOIN ordered k ON {inside}
    GROUP BY number, goal, near, {piece}
  ) WHERE below <= goal AND goal < below + bytes
)"""


def _op3(shards: int = 40) -> str:
    rounds, last = [], "r0"
    for n in range(1, 11):
        shift = 60 - 12 * (n if n <= 5 else n - 5)
        key = "k.text_key" if n <= 5 else "k.id_key"
        inside = "true" if n == 1 else "k.text_key BETWEEN open.lo_t AND open.hi_t" + (" AND k.id_key BETWEEN open.lo_i AND open.hi_i" if n > 6 else "")
        rounds.append(_ROUND.format(n=n, piece=f"({key} >> {shift})", last=last, inside=inside))
        last = f"r{n}"
    done = " UNION ALL ".join(
        f"SELECT {n} AS n, number, CASE WHEN down <= up THEN below ELSE below + bytes END AS edge FROM r{n} WHERE done" for n in range(1, 11)
    )
    return rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT + 16 AS size,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS text_key,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS id_key
  FROM documents
), ordered AS (
  SELECT *, sum(size) OVER (ORDER BY text_key, id_key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before,
    sum(size) OVER () AS total
  FROM keyed
), r0 AS (
  SELECT i AS number, total * i // {shards} AS goal, 0.025 * total / {shards} AS near, false AS done
  FROM (SELECT max(total) AS total FROM ordered), (SELECT unnest(range(1, {shards})) AS i)
), {", ".join(rounds)}, edges AS ({done}
), dealt AS (
  SELECT *, (SELECT count(*) FROM edges WHERE edge <= before)::INTEGER AS shard FROM ordered
), crcs AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM keyed), crc_table
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY id_key, text_key, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM dealt JOIN crcs USING (doc_id)
"""


_CONTROL = r"([<\[])(\\*)(/?(?:INST|ROLE|NOROLE)\]|/?s>|</?SYS>>|turn>)"
OP5 = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), seen AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS nth,
    length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g')) AS escaped
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + CASE
    WHEN nth > 1 AND role IS NOT DISTINCT FROM before THEN 6
    WHEN role IS NULL THEN 21 WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 9 WHEN role = 'system' THEN 17
    ELSE 23 + length(regexp_replace(role, '{_CONTROL}', '\1\\\2\3', 'g')) END)::BIGINT AS formatted_chars
FROM seen GROUP BY conv_id
"""


_SHINGLES = r"""
SELECT DISTINCT {id} AS id, text, array_to_string(w[i:i + 4], ' ') AS shingle FROM (
  SELECT {id}, text, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
  FROM (SELECT {id}, text, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {table})
  WHERE len(w) > 0
)"""
OP8 = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT id, text, count(*) AS n FROM b GROUP BY id, text)
SELECT DISTINCT d.id AS doc_id, b.id AS item_id, count(*) AS shared, n.n AS item_shingles, count(*) / n.n AS containment
FROM d JOIN b USING (shingle) JOIN n ON n.id IS NOT DISTINCT FROM b.id AND n.text = b.text
GROUP BY d.id, d.text, b.id, b.text, n.n HAVING count(*) >= 0.8 * n.n
"""


OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
    row_number() OVER () AS nth
  FROM documents
), occurring AS (SELECT DISTINCT lang, source FROM d
), words AS (SELECT nth, lang, source, unnest(terms) AS term FROM d
), kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT nth) >= 10
), size AS (SELECT lang, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v FROM (SELECT DISTINCT lang FROM occurring) g
), counted AS (
  SELECT o.lang, o.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM occurring o JOIN kept k USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c ON c.lang = o.lang AND c.source = o.source AND c.term = k.term
), own AS (
  SELECT *, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 2 * v) AS p FROM counted JOIN size USING (lang)
), whole AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 2 * v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM counted GROUP BY ALL) JOIN size USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM own x JOIN own y USING (lang, term)
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source
), best AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _op12(k: int = 8, rounds: int = 10) -> str:
    floor = "(s - ((s % n) + n) % n) // n"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT row, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT v.row, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM cells v JOIN mid{r} m USING (i) GROUP BY v.row, m.c) GROUP BY row
)""")
        if r < rounds:
            steps.append(f"""
mid{r + 1} AS MATERIALIZED (
  SELECT m.c, m.i, coalesce(g.x, m.x) AS x FROM mid{r} m LEFT JOIN (
    SELECT cluster AS c, i, ({floor})::BIGINT AS x FROM (
      SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM cells JOIN near{r} USING (row) GROUP BY cluster, i)) g USING (c, i)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, embedding, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, embedding) AS row FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), cells AS MATERIALIZED (
  SELECT row, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS x FROM kept
), mid0 AS MATERIALIZED (SELECT row - 1 AS c, i, x FROM cells WHERE row <= {k}
), {",".join(steps)}, sums AS (
  SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM near{rounds} GROUP BY cluster
), digests AS (
  SELECT c AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM mid{rounds} GROUP BY c
)
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance, cluster_inertia,
  (SELECT sum(cluster_inertia) FROM sums)::BIGINT AS inertia, centroid_sha256
FROM kept JOIN near{rounds} USING (row) JOIN sums USING (cluster) JOIN digests USING (cluster)
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_centroids": _op12(), "op13_divergence": OP13, "op1_mixing": OP1, "op3_sharding": _op3(), "op5_chat": OP5, "op7_top_k": OP7, "op8_decontamination": OP8}
