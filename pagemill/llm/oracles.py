"""DuckDB SQL for the queries that SQL can express, written from the
operators' definitions over the raw tables (no staging, buckets or filters)."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {}

ORACLE["op1_url_reputation"] = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
lv AS (
  SELECT host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM (SELECT DISTINCT host FROM p)),
hs AS (
  SELECT host, l[-1] AS suffix, CASE WHEN len(l) > 1 THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS domain FROM lv),
o AS (
  SELECT p.host, domain, suffix, CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS bad
  FROM p JOIN hs USING (host) JOIN labels ON labels.doc_id = try_cast(regexp_extract(path, '/([0-9]{1,18})[^/]*$', 1) AS BIGINT)),
c AS (SELECT (sum(bad) + 0.5::DOUBLE) / (count(*) + 1::DOUBLE) AS p, count(*) + 1::DOUBLE AS st FROM o),
s1 AS (SELECT suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k, any_value(c.p) AS p FROM o, c GROUP BY suffix),
sm AS (SELECT 1 / least(greatest(coalesce((sum(n*(k/n-p)*(k/n-p)) - v*(count(*)-1)) / nullif(v*(sum(n)-sum(n*n)/sum(n)-(count(*)-1)), 0), 0), 1e-6), 0.5) - 1 AS m
       FROM s1, (SELECT sum(n*p*(1-p))/sum(n) AS v FROM s1) GROUP BY v),
s2 AS (SELECT suffix, (k + m*p)/(n + m) AS rate, n + m AS st FROM s1, sm),
d1 AS (SELECT domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k, any_value(s2.rate) AS p FROM o JOIN s2 USING (suffix) GROUP BY domain, suffix),
dm AS (SELECT 1 / least(greatest(coalesce((sum(n*(k/n-p)*(k/n-p)) - v*(count(*)-1)) / nullif(v*(sum(n)-sum(n*n)/sum(n)-(count(*)-1)), 0), 0), 1e-6), 0.5) - 1 AS m
       FROM d1, (SELECT sum(n*p*(1-p))/sum(n) AS v FROM d1) GROUP BY v),
d2 AS (SELECT domain, (k + m*p)/(n + m) AS rate, n + m AS st FROM d1, dm),
h1 AS (SELECT host, domain, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k, any_value(d2.rate) AS p FROM o JOIN d2 USING (domain) GROUP BY host, domain),
hm AS (SELECT 1 / least(greatest(coalesce((sum(n*(k/n-p)*(k/n-p)) - v*(count(*)-1)) / nullif(v*(sum(n)-sum(n*n)/sum(n)-(count(*)-1)), 0), 0), 1e-6), 0.5) - 1 AS m
       FROM h1, (SELECT sum(n*p*(1-p))/sum(n) AS v FROM h1) GROUP BY v),
h2 AS (SELECT host, (k + m*p)/(n + m) AS rate, n + m AS st FROM h1, hm),
b AS (
  SELECT hs.host, coalesce(h2.rate, d2.rate, s2.rate, c.p) AS r, coalesce(h2.st, d2.st, s2.st, c.st) AS st
  FROM hs LEFT JOIN h2 USING (host) LEFT JOIN d2 USING (domain) LEFT JOIN s2 USING (suffix) LEFT JOIN c ON true),
ru AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, ru.host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN r - 1.645 * sqrt(r * (1 - r) / (st + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ru JOIN b ON b.host = ru.host
"""

ORACLE["op2_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

_TRIM = "trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
ORACLE["op3_line_dedup"] = f"""
WITH e AS (SELECT doc_id, source, text, i, string_split(text, chr(10))[i] AS l
           FROM documents, range(1, 1 + len(string_split(text, chr(10)))) r(i) WHERE text IS NOT NULL),
x AS (SELECT source, {_TRIM} AS l, count(DISTINCT doc_id) AS n FROM e WHERE {_TRIM} <> '' GROUP BY 1, 2),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY 1),
b AS (SELECT x.source, x.l FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source WHERE n >= 3 AND n > total * 0.1::DOUBLE),
m AS (SELECT e.*, b.l IS NOT NULL AS gone FROM e LEFT JOIN b ON b.source IS NOT DISTINCT FROM e.source AND b.l = {_TRIM.replace('trim(l', 'trim(e.l')})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

ORACLE["op5_source_mix"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT source, n, [5, 2, 1][1 + (i - 1) % 3]::DOUBLE AS w, (SELECT 1.5 * sum(n) FROM s)::DOUBLE AS total FROM s),
-- a source is full while its share at the running unit is above twice its size; take them in order of size per weight
o AS (SELECT *, row_number() OVER (ORDER BY n / w, source) AS r,
             total - coalesce(sum(2.0 * n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum FROM w),
f AS (SELECT coalesce(min(r), (SELECT count(*) + 1 FROM o)) AS r FROM o WHERE w * rest / wsum <= 2.0 * n),
t AS (SELECT source, n, CASE WHEN o.r < f.r THEN 2.0 * n ELSE w * (SELECT rest / wsum FROM o o2 WHERE o2.r = f.r) END::DOUBLE AS target FROM o, f),
q AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE round_even(target, 0)::BIGINT // n END AS passes,
             CASE WHEN n = 0 THEN 0 ELSE round_even(target, 0)::BIGINT % n END AS need FROM t),
c AS (SELECT d.*, q.n, q.target, q.passes, q.need FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source),
-- one row a step, behind lo: the largest document that fits if it fills half of what is open, or a
-- round that takes documents of the order until one would overrun it: those between a and b up to lim
r(source, j, lo, need, picks, a, b, lim) AS (
  SELECT source, 0, '', need, []::VARCHAR[], '', '', 0::BIGINT FROM q WHERE need > 0
  UNION ALL
  (WITH x AS (SELECT r.*, c.h, c.size, sum(c.size) OVER (PARTITION BY r.source ORDER BY c.h) AS run
              FROM r JOIN c ON c.source IS NOT DISTINCT FROM r.source AND c.h > r.lo AND c.size BETWEEN 1 AND r.need
              WHERE NOT list_contains(r.picks, c.h)),
        y AS (SELECT source, j, lo, need, picks, max(size) AS big, min(struct_pack(s := -size, h := h)).h AS one,
                     coalesce(min(h) FILTER (WHERE run > need), '~') AS hi, coalesce(max(run) FILTER (WHERE run <= need), 0) AS got
              FROM x GROUP BY source, j, lo, need, picks)
   SELECT source, j + 1, CASE WHEN p THEN lo ELSE hi END, (need - CASE WHEN p THEN big ELSE got END)::BIGINT,
          CASE WHEN p THEN list_append(picks, one) ELSE picks END,
          CASE WHEN p THEN '' ELSE lo END, CASE WHEN p THEN '' ELSE hi END, need
   FROM (SELECT *, j > 0 AND 2 * big >= need AS p FROM y))),
i AS (SELECT *, max(j) OVER (PARTITION BY source) AS top FROM r),
g AS (SELECT c.source, c.h, c.size, k.j, k.need AS open,
             EXISTS (SELECT 1 FROM i WHERE i.source IS NOT DISTINCT FROM c.source AND i.j <= k.j AND (list_contains(i.picks, c.h)
                     OR c.h > i.a AND c.h < i.b AND c.size BETWEEN 1 AND i.lim)) AS got
      FROM c JOIN i k ON k.source IS NOT DISTINCT FROM c.source AND (k.j <= 1 OR k.j = k.top)),
e AS (SELECT source, j, any_value(open) AS open, min(struct_pack(g := abs(size - open), h := h)) FILTER (
        WHERE NOT got AND size > 0 AND abs(size - open) < open) AS x FROM g GROUP BY source, j),
b AS (SELECT source, min(struct_pack(d := coalesce(x.g, open), j := j, h := x.h)) AS m FROM e GROUP BY source)
SELECT c.doc_id, c.size, c.n AS source_size, c.target,
       (c.size * (c.passes + CASE WHEN coalesce(g.got, false) OR coalesce(c.h = b.m.h, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN b ON b.source IS NOT DISTINCT FROM c.source
LEFT JOIN g ON g.source IS NOT DISTINCT FROM c.source AND g.h = c.h AND g.j = b.m.j
"""

# every pair that shares a shingle, its exact similarity, then components
ORACLE["op4_minhash"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y)
SELECT n.doc_id, n AS n_shingles, min(y) AS component_id, n.doc_id = min(y) AS kept
FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n
"""

# crc32 bit by bit: DuckDB has no function for it
_CRC = ("xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), c -> ascii(c)::BIGINT), lambda a, b: "
        "list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), "
        "4294967295::BIGINT)").replace("c -> ascii(c)", "lambda c: ascii(c)")


def _fields(n_chars: str) -> str:
    one = "coalesce(strlen({0}) || ':' || {0}, '-')"
    return " || ".join(one.format(f"({c})::VARCHAR") for c in ("doc_id", "source", "lang", n_chars, "text"))


ORACLE["op12_merkle"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256({_fields('n_chars')}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC.format('doc_id::VARCHAR')} % 7 = 0 THEN sha256({_fields('n_chars + 1')}) END AS tampered
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
nodes(g, lvl, pos, h) AS (
  SELECT g, 0, pos, leaf FROM r
  UNION ALL
  (SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
   FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM nodes) WHERE c > 1 GROUP BY g, lvl, pos // 2)),
sub AS (SELECT g, arg_max(h, lvl) AS subroot, max(lvl) AS top FROM nodes GROUP BY g),
tops(lvl, pos, h) AS (
  SELECT 0, row_number() OVER (ORDER BY g) - 1, subroot FROM sub
  UNION ALL
  (SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
   FROM (SELECT *, count(*) OVER () AS c FROM tops) WHERE c > 1 GROUP BY lvl, pos // 2)),
gp AS (SELECT g, subroot, top, row_number() OVER (ORDER BY g) - 1 AS gpos FROM sub),
rt AS (SELECT max(lvl) AS deep, arg_max(h, lvl) AS root FROM tops),
steps AS (
  SELECT r.g, r.pos, lv.lvl AS step, s.h, (r.pos >> lv.lvl) & 1 AS right_
  FROM r JOIN gp USING (g), range(0, 64) lv(lvl) LEFT JOIN nodes s ON s.g = r.g AND s.lvl = lv.lvl AND s.pos = xor(r.pos >> lv.lvl, 1)
  WHERE lv.lvl < top
  UNION ALL
  SELECT r.g, r.pos, top + lv.lvl, s.h, (gpos >> lv.lvl) & 1
  FROM r JOIN gp USING (g), rt, range(0, 64) lv(lvl) LEFT JOIN tops s ON s.lvl = lv.lvl AND s.pos = xor(gpos >> lv.lvl, 1)
  WHERE lv.lvl < deep),
fold(g, pos, step, h) AS (
  SELECT g, pos, 0, coalesce(tampered, leaf) FROM r
  UNION ALL
  SELECT f.g, f.pos, f.step + 1, sha256(CASE WHEN s.right_ = 1 THEN coalesce(s.h, '') || f.h ELSE f.h || coalesce(s.h, '') END)
  FROM fold f JOIN steps s ON s.g = f.g AND s.pos = f.pos AND s.step = f.step),
ends AS (SELECT g, pos, arg_max(h, step) AS folded_root FROM fold GROUP BY g, pos),
proofs AS (SELECT g, pos, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY g, pos)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM r JOIN gp USING (g) JOIN ends USING (g, pos) LEFT JOIN proofs USING (g, pos), rt
"""
