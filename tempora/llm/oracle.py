"""SQL counterparts of the registered queries, where SQL can express them.

Each reaches its result by a plainer way than the query: windows compared with
windows, all pairs of sets that share a shingle, ranks over whole tables.
"""

from __future__ import annotations

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"
FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({FOLD}, '{WORD}') AS w FROM benchmark
), pane AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all({FOLD}, '{WORD}') AS w FROM documents
), place AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, (SELECT DISTINCT n FROM pane) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, s, place.n, item FROM place JOIN pane ON place.words = pane.words AND place.n = pane.n
), covered AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS word FROM hit) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered ON doc.doc_id = covered.doc_id LEFT JOIN found ON doc.doc_id = found.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({FOLD}, '{SPACED}') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + least(5, len(w)) - 1], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM doc WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingle x JOIN shingle y ON x.words = y.words AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id
), link AS (
  SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
  WHERE 100 * k >= 85 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id, doc_id AS other FROM doc
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a
), component AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, component_id, doc.doc_id = component_id AS kept
FROM doc JOIN component ON doc.doc_id = component.doc_id LEFT JOIN size ON doc.doc_id = size.doc_id
"""

TOPK = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 10
"""


# crc32 by its rule: a table of 256 entries, then one step a byte.
CRC_STEP = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
CRC_TABLE = "WITH t0 AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c FROM range(256) r(i))" + "".join(
    f", t{k + 1} AS (SELECT i, {CRC_STEP.format(c='c')} AS c FROM t{k})" for k in range(8)
)

SHARDING = f"""
{CRC_TABLE}, crc AS (SELECT list(c ORDER BY i) AS t FROM t8), doc AS (
  SELECT doc_id, source, text, coalesce('s' || source, '') AS stratum, octet_length(encode(coalesce(text, ''))) + 16 AS size,
         hex(encode(coalesce(text, ''))) AS bytes, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY digest) - 1 AS r, count(*) OVER (PARTITION BY stratum) AS n FROM doc
), placed AS (
  SELECT *, row_number() OVER (ORDER BY CAST(2 * r + 1 AS DOUBLE) / (2 * n), stratum, r) - 1 AS g, count(*) OVER () AS total FROM ranked
), cut AS (SELECT *, (g * 40) // total AS shard FROM placed)
SELECT doc_id, source, CAST(size AS BIGINT) AS size,
       xor(list_reduce(list_transform(range(0, size - 16), lambda i: CAST('0x' || bytes[2 * i + 1:2 * i + 2] AS BIGINT)),
                       lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) AS text_crc32,
       'rows' AS law, CAST(shard AS INTEGER) AS shard, g - (shard * total + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut, crc
"""

# Letters of scripts without blanks, and what counts as white space.
SLOW = r"\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}\x{200B}\x{2060}\x{FEFF}]"

LINE_DEDUP = rf"""
WITH RECURSIVE doc AS (
  SELECT *, string_split(text, chr(10)) AS parts FROM documents
), line AS (
  SELECT doc_id, i - 1 AS line, trim(regexp_replace(regexp_replace(parts[i], '([\p{{Han}}{SLOW}])', ' \1 ', 'g'), '{SPACE}+', ' ', 'g'), ' ') AS bare
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM doc)
), sized AS (
  SELECT doc_id, line, regexp_replace(bare, '[0-9]+', '0', 'g') AS masked, len(string_split(bare, ' ')) AS n, length(regexp_replace(bare, '[^{SLOW}]', '', 'g')) AS slow
  FROM line WHERE bare <> ''
), parsed AS (
  SELECT doc_id, line, masked, n, n - slow + CAST(ceil(slow / 4.0) AS BIGINT) < 8 AS short, string_split(masked, ' ') AS tokens,
         n || ':' || array_to_string(string_split(masked, ' ')[1:3], ' ') AS leaf
  FROM sized
), template AS (
  SELECT DISTINCT leaf, masked, n, tokens FROM parsed WHERE NOT short
), several AS (
  SELECT leaf, count(*) AS m FROM template GROUP BY leaf HAVING count(*) > 1
), token AS (
  SELECT leaf, masked, n, m, i, tokens[i] AS token
  FROM (SELECT t.*, m, unnest(range(1, n + 1)) AS i FROM template t JOIN several ON t.leaf = several.leaf)
), constant AS (
  SELECT leaf, i, token FROM token GROUP BY leaf, i, token, m HAVING 2 * count(*) > m
), alike AS (
  SELECT token.leaf, masked FROM token JOIN constant c ON token.leaf = c.leaf AND token.i = c.i AND token.token = c.token
  GROUP BY token.leaf, masked, n HAVING 5 * count(*) >= 4 * n
), rest AS (
  SELECT t.leaf, t.masked, t.n, t.tokens, n // 5 + 1 AS blocks FROM template t JOIN several ON t.leaf = several.leaf
  WHERE NOT EXISTS (SELECT 1 FROM alike a WHERE a.leaf = t.leaf AND a.masked = t.masked)
), cut AS (
  SELECT *, 3 + (i * (n - 3)) // blocks AS low, 3 + ((i + 1) * (n - 3)) // blocks AS high FROM (SELECT *, unnest(range(blocks)) AS i FROM rest)
), bucket AS (
  SELECT leaf || ' / ' || i || ' / ' || array_to_string(tokens[low + 1:high], ' ') AS bucket, masked, n, tokens FROM cut
), shared AS (
  SELECT bucket, count(*) AS m FROM bucket GROUP BY bucket HAVING count(*) > 1
), word AS (
  SELECT bucket, masked, n, m, i, tokens[i] AS token
  FROM (SELECT b.*, m, unnest(range(1, n + 1)) AS i FROM bucket b JOIN shared ON b.bucket = shared.bucket)
), fixed AS (
  SELECT bucket, i, token FROM word GROUP BY bucket, i, token, m HAVING 2 * count(*) > m
), link AS (
  SELECT word.bucket, masked FROM word JOIN fixed f ON word.bucket = f.bucket AND word.i = f.i AND word.token = f.token
  GROUP BY word.bucket, masked, n HAVING 5 * count(*) >= 4 * n
), reach AS (
  SELECT DISTINCT masked, masked AS other FROM link
  UNION
  SELECT reach.masked, y.masked FROM reach JOIN link x ON reach.other = x.masked JOIN link y ON x.bucket = y.bucket
), component AS (
  SELECT masked, 'b' || min(other) AS grp FROM reach GROUP BY masked
), member AS (
  SELECT DISTINCT p.doc_id, p.line, p.short, coalesce('l' || a.leaf, c.grp, 't' || p.masked) AS grp
  FROM parsed p LEFT JOIN alike a ON p.masked = a.masked AND p.leaf = a.leaf LEFT JOIN component c ON p.masked = c.masked
), spread AS (
  SELECT grp, min(doc_id) AS first FROM member GROUP BY grp, short HAVING count(DISTINCT doc_id) >= CASE WHEN short THEN 10 ELSE 2 END
), dropped AS (
  SELECT doc_id, list(line) AS drops FROM member JOIN spread ON member.grp = spread.grp AND doc_id <> first GROUP BY doc_id
), kept AS (
  SELECT doc.*, drops, array_to_string(list_transform(list_filter(range(len(parts)), lambda i: NOT list_contains(drops, i)), lambda i: parts[i + 1]), chr(10)) AS rest
  FROM doc LEFT JOIN dropped ON doc.doc_id = dropped.doc_id
)
SELECT doc_id, CASE WHEN drops IS NULL THEN text ELSE rest END AS text, lang, source,
       CASE WHEN drops IS NULL THEN n_chars ELSE CAST(length(rest) AS BIGINT) END AS n_chars,
       CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(drops), 0) AS BIGINT) AS n_dropped
FROM kept
"""


def _model(order: int) -> str:
    """Probabilities of one more character of context, after the ``order - 1`` model."""
    sides = "".join(
        f", CASE WHEN n_{s} >= 2 THEN (k_{s} + t_{s} * p_{s}) / (n_{s} + t_{s}) ELSE p_{s} END AS p_{s}" for s in ("good", "bad")
    )
    return f""", seen{order} AS (
  SELECT right(gram, {order + 1}) AS key, sum(good) AS k_good, sum(bad) AS k_bad FROM counts GROUP BY 1
), context{order} AS (
  SELECT left(key, {order}) AS context, count(*) FILTER (k_good > 0) AS t_good, count(*) FILTER (k_bad > 0) AS t_bad,
         sum(k_good) AS n_good, sum(k_bad) AS n_bad
  FROM seen{order} GROUP BY 1
), model{order + 1} AS (
  SELECT gram{sides}
  FROM model{order} JOIN seen{order} ON key = right(gram, {order + 1}) JOIN context{order} ON context = left(right(gram, {order + 1}), {order})
)"""


URL_FILTER = (
    """
WITH page AS (
  SELECT page_id, coalesce(url, '') AS url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM page
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'block example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'block example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'allow com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'block com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'allow org/' END AS decided
  FROM part
), listed AS (
  SELECT *, len(list_filter(string_split(replace(host, '-', '.'), '.'),
    lambda x: x IN ('ads', 'bets', 'casino', 'pills', 'porn', 'spam', 'track', 'viagra', 'warez', 'win'))) > 0 AS named
  FROM ruled
), urls AS (
  SELECT DISTINCT url, CAST(coalesce(starts_with(decided, 'allow'), false) AND NOT named AS INTEGER) AS good,
         CAST(coalesce(starts_with(decided, 'block'), false) OR named AS INTEGER) AS bad,
         CAST('0x' || substr(md5(url), 1, 4) AS INTEGER) % 5 = 0 AS kept_out,
         '^^^' || translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') || '$' AS padded
  FROM listed
), grams AS (
  SELECT url, good, bad, kept_out, substr(padded, i, 4) AS gram
  FROM (SELECT *, unnest(range(1, length(padded) - 2)) AS i FROM urls)
), counts AS (
  SELECT gram, sum(CASE WHEN kept_out THEN 0 ELSE good END) AS good, sum(CASE WHEN kept_out THEN 0 ELSE bad END) AS bad
  FROM grams GROUP BY gram
), model0 AS (
  SELECT gram, CAST(1 AS DOUBLE) / 128 AS p_good, CAST(1 AS DOUBLE) / 128 AS p_bad FROM counts
)"""
    + "".join(_model(order) for order in range(4))
    + """, scores AS (
  SELECT url, good, bad, kept_out, CAST(sum(CAST(round((ln(p_good) - ln(p_bad)) * 1000000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000000 AS score
  FROM grams JOIN model4 ON grams.gram = model4.gram GROUP BY url, good, bad, kept_out
), bins AS (
  SELECT greatest(-1000, least(1000, CAST(floor(score * 100) AS INTEGER))) AS step, sum(good) AS good, sum(bad) AS bad
  FROM scores WHERE kept_out GROUP BY 1
), above AS (
  SELECT step, lag(step) OVER (ORDER BY step) AS prev, sum(good) OVER up AS good, sum(bad) OVER up AS bad, sum(good) OVER () AS all_good, sum(bad) OVER () AS all_bad
  FROM bins WINDOW up AS (ORDER BY step DESC)
), best AS (
  SELECT CAST(floor((step + coalesce(prev + 1, step)) / 2.0) AS INTEGER) AS step FROM above WHERE all_good > 0 AND all_bad > 0
  ORDER BY CAST(good AS DOUBLE) / all_good - CAST(bad AS DOUBLE) / all_bad DESC, above.step LIMIT 1
)
SELECT page_id, host, path, substr(decided, strpos(decided, ' ') + 1) AS rule,
       coalesce(substr(decided, 1, strpos(decided, ' ') - 1),
                CASE WHEN floor(score * 100) >= coalesce((SELECT step FROM best), -1001) THEN 'allow' ELSE 'block' END) AS verdict
FROM listed JOIN scores ON listed.url = scores.url
"""
)


CHAT_FORMAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER own AS place, lag(role) OVER own AS before, lead(role) OVER own AS after
  FROM said WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *,
    length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + length(regexp_extract_all(text, '</?s>|<</?SYS>>|\[/?INST\]|\[/?ROLE\]|\[SAYS\]|\[NEXT\]')) AS body,
    length(role) + length(regexp_replace(role, '[^\\]', '', 'g')) + length(regexp_extract_all(role, '</?s>|<</?SYS>>|\[/?INST\]|\[/?ROLE\]|\[SAYS\]|\[NEXT\]')) AS name,
    before IS NOT DISTINCT FROM role AS goes_on, after IS NOT DISTINCT FROM role AS continues
  FROM placed
), piece AS (
  SELECT *, body + CASE WHEN goes_on THEN 8 ELSE 0 END
    + CASE WHEN goes_on THEN 0 WHEN role = 'system' THEN 8 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 4 ELSE 7 + name + 8 END
    + CASE WHEN continues THEN 0 WHEN role = 'system' THEN 9 WHEN role = 'user' THEN 8 WHEN role = 'assistant' THEN 5 ELSE 8 END AS chars
  FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM piece GROUP BY conv_id
"""


COLLOCATIONS = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({FOLD}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), gram AS (
  SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM piece, range(1, 6) t(s) WHERE len(w) >= s)
), counted AS (
  SELECT lang, s, phrase, count(*) AS f FROM gram GROUP BY lang, s, phrase
), total AS (
  SELECT lang, sum(f) AS n FROM counted WHERE s = 1 GROUP BY lang
), candidate AS (
  SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE s > 1 AND f >= 100
), inner_one AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, k, unnest(range(1, s - k + 2)) AS i FROM (SELECT *, unnest(range(2, s)) AS k FROM candidate)) GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidate c LEFT JOIN inner_one i ON c.lang = i.lang AND c.phrase = i.phrase WHERE longer IS NULL OR 100 * longer < 100 * a
), cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:s], ' ') AS right_part FROM (SELECT *, unnest(range(1, s)) AS k FROM kept)
), scored AS (
  SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cut JOIN counted x ON x.lang = cut.lang AND x.phrase = left_part JOIN counted y ON y.lang = cut.lang AND y.phrase = right_part JOIN total ON total.lang = cut.lang
), least AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": DECONTAMINATION,
        "op2_url_filter": URL_FILTER,
        "op4_sharding": SHARDING,
        "op5_line_dedup": LINE_DEDUP,
        "op6_near_duplicates": NEAR_DUPLICATES,
        "op9_topk_search": TOPK,
        "op11_collocations": COLLOCATIONS,
        "op12_chat_format": CHAT_FORMAT,
    }
