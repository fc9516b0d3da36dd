"""DuckDB SQL of the operators that SQL can express (others are tested against
brute force)."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def unit(e: str) -> str:
    """60 seeded bits of a string."""
    return f"CAST('0x' || substring(md5({e}), 1, 15) AS BIGINT)"


SKEY = "coalesce('s' || source, 'n')"

# CRC-32 byte by byte, with the table made from its polynomial.
OP1 = f"""WITH RECURSIVE step AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (
  SELECT doc_id, source, {SKEY} AS skey, {unit("'0:' || doc_id")} AS rnd,
         octet_length(encode(coalesce(text, ''))) + 16 AS size,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                                           lambda h: CAST('0x' || h AS BIGINT))),
           lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]))) AS crc
  FROM documents, crc_table),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY skey ORDER BY rnd, doc_id, size, crc) - 1
             + {unit("'source0:' || skey")} / 1152921504606846976.0::DOUBLE) / count(*) OVER (PARTITION BY skey) AS f
  FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY f, skey, rnd, doc_id, size, crc) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(pos * 40 // total AS INTEGER) AS shard,
       CAST(pos - ((pos * 40 // total) * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p"""

# The highest quotients are found by ranking all seats.
OP7 = f"""WITH d AS (
  SELECT doc_id, source, {SKEY} AS skey, {unit("'mix0:' || doc_id")} AS rnd, len({WORDS}) AS size FROM documents),
s0 AS (SELECT skey, min(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
s1 AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 3.0 * source_size AS cap FROM s0),
s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1),
lv AS (SELECT arg_min(level, (cap / weight, skey)) AS lvl FROM s2 WHERE NOT cap < level * weight),
t AS (SELECT skey, source_size, least(cap, coalesce(lvl * weight, cap)) AS target FROM s2, lv),
seats AS (
  SELECT skey, i, row_number() OVER (ORDER BY (i + 0.5::DOUBLE) / target, skey) AS rank
  FROM (SELECT skey, target, unnest(generate_series(0, CAST(ceil(target / 64) AS BIGINT) + 64)) AS i FROM t WHERE target > 0)),
q AS (
  SELECT skey, shard, count(*) FILTER (rank <= round(total * (shard + 1) / (64 * 16))) AS n
  FROM seats, (SELECT sum(target) AS total FROM t), range(16) r(shard) GROUP BY skey, shard),
dealt AS (
  SELECT t.*, shard, least(coalesce(q.n, 0), 3 * CAST(ceil(source_size / 64) AS BIGINT)) AS upto
  FROM t LEFT JOIN q USING (skey)),
plan AS (
  SELECT skey, source_size, target, max(upto) AS blocks, source_size // 64 AS n FROM dealt GROUP BY ALL),
plan2 AS (
  SELECT *, least(blocks * 64, 3 * source_size) AS words,
         CASE WHEN source_size > 0 THEN least(blocks * 64, 3 * source_size) // source_size ELSE 0 END AS passes FROM plan),
plan3 AS (
  SELECT *, least(n, CAST(round((words - passes * source_size) / 64) AS BIGINT)) AS rest,
         CASE WHEN n > 0 THEN {unit("'phase0:' || skey")} % n ELSE 0 END AS phase FROM plan2),
placed AS (
  SELECT d.doc_id, d.size, d.source, p.*,
         sum(size) OVER (PARTITION BY d.skey ORDER BY rnd, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS hi
  FROM d JOIN plan3 p USING (skey)),
cov AS (
  SELECT *, unnest(['hi', 'lo']) AS side, unnest([hi, hi - size]) AS x FROM placed),
cov2 AS (
  SELECT *, x // 64 AS b FROM cov),
cov3 AS (
  SELECT *, CASE WHEN rest = 0 THEN 0 WHEN b >= n THEN rest * 64
                 ELSE (b * rest + phase) // n * 64 + (((b + 1) * rest + phase) // n - (b * rest + phase) // n) * (x - b * 64) END AS c
  FROM cov2),
mixed AS (
  SELECT doc_id, CAST(any_value(size) AS BIGINT) AS size, CAST(any_value(source_size) AS BIGINT) AS source_size, any_value(target) AS target,
         CAST(any_value(passes * size) + sum(CASE side WHEN 'hi' THEN c ELSE -c END) AS BIGINT) AS taken,
         any_value(source) AS source, CAST(any_value(blocks) AS BIGINT) AS blocks,
         any_value(skey) AS skey, any_value(passes) AS passes, any_value(hi) AS hi, sum(CASE side WHEN 'hi' THEN c END) AS c_hi,
         any_value(passes * source_size + rest * 64) AS total
  FROM cov3 GROUP BY doc_id),
-- every run of words that a document gives, in the words taken of its source
runs AS (
  SELECT doc_id, skey, total, (p - 1) * source_size + hi - size AS a, (p - 1) * source_size + hi AS e
  FROM (SELECT *, unnest(generate_series(1, CAST(passes AS BIGINT))) AS p FROM mixed)
  UNION ALL
  SELECT doc_id, skey, total, passes * source_size + c_hi - (taken - passes * size), passes * source_size + c_hi FROM mixed),
ends AS (
  SELECT skey, shard, upto * 64 AS e, coalesce(lag(upto) OVER (PARTITION BY skey ORDER BY shard), 0) * 64 AS a FROM dealt WHERE shard IS NOT NULL),
parts AS (
  SELECT doc_id, shard, CAST(sum(greatest(0, least(r.e, CASE shard WHEN 15 THEN total ELSE s.e END) - greatest(r.a, s.a))) AS BIGINT) AS words
  FROM runs r JOIN ends s USING (skey) GROUP BY doc_id, shard)
SELECT doc_id, size, source_size, target, taken, source, blocks,
       coalesce((SELECT string_agg(shard || ':' || words, ' ' ORDER BY shard) FROM parts WHERE parts.doc_id = mixed.doc_id AND words > 0), '') AS shards
FROM mixed"""

OP9 = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

OP10 = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
owner AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM win JOIN owner USING (h) WHERE first < doc_id),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d) x
  LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p WHERE g.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)"""

OP11 = r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h
  FROM documents),
e AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (
  SELECT *, array_to_string(u[1:p], '') AS pre, array_to_string(u[p + 1:q], '') AS mid, array_to_string(u[q + 1:], '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CAST(CASE WHEN form <> 'plain' THEN length(pre) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(mid) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(pre || mid || suf) AS restored_sha256
FROM g"""

OP13 = r"""WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (
  SELECT lang, 1 AS m, ws[i] AS phrase FROM t
  UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM t WHERE i + 1 <= len(ws)
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM t WHERE i + 2 <= len(ws)),
c AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE m = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE m > 1 AND f >= 10),
cut AS (SELECT lang, phrase, f AS a, ws, unnest(range(1, m)) AS k FROM cand),
scored AS (
  SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN c x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:k], ' ')
           JOIN c y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS phrase, f FROM cand WHERE m = 3
    UNION ALL SELECT lang, ws[2] || ' ' || ws[3], f FROM cand WHERE m = 3) GROUP BY ALL),
kept AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 50 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
       CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) WHERE rank <= 2000"""

ORACLE_SQL = {"op1_stratified_shards": OP1, "op7_sainte_lague_mix": OP7, "op9_ball_tree_top5": OP9, "op10_window_dedup": OP10,
              "op11_piece_table_fim": OP11, "op13_stripe_collocations": OP13}
