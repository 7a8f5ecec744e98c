"""DuckDB text of the operators that SQL can express, as CTEs over any relation of
documents, so that the pipeline's text is the stages' one after another.

The texts follow the definitions (exact strings, all pairs that share a shingle), not
the operators' ways."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SEP, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
_LINES = "string_split(coalesce(text, ''), chr(10))"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UP}', '{_LOW}')"


def line_dedup(src: str, p: str, min_chars: int = 10) -> str:
    """``{p}out``: doc_id, n_lines, n_dropped, kept (the text)."""
    return f"""
{p}l AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS pos FROM {src}),
{p}k AS (SELECT *, {_lower(f"trim(line, {_SPACES})")} AS key FROM {p}l),
{p}f AS (SELECT key, min(doc_id) AS first_id FROM {p}k WHERE length(key) >= {min_chars} GROUP BY key),
{p}m AS (SELECT k.*, coalesce(length(k.key) >= {min_chars} AND f.first_id <> k.doc_id, false) AS gone FROM {p}k k LEFT JOIN {p}f f USING (key)),
{p}out AS (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM {p}m GROUP BY doc_id)"""


def quality_rules(src: str, p: str, max_docs: int, min_words: int, left_percent: int, repeat_percent: int) -> str:
    """``{p}out``: the statistics and verdict of each document; ``{p}text``: doc_id and
    ``clean``, the texts of the kept ones less the lines that more than ``max_docs``
    different texts of their host hold."""
    return f"""
{p}w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words, list_filter({_LINES}, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS full_lines FROM {src}),
{p}win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS v FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM {p}w)),
{p}rep AS (SELECT doc_id, count(DISTINCT ix) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS ix FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, v) AS c FROM {p}win) WHERE c > 1) GROUP BY doc_id),
{p}base AS (SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_SEP}', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM {p}w w LEFT JOIN {p}rep r USING (doc_id)),
{p}ln AS (SELECT doc_id, source, unnest(full_lines) AS line, generate_subscripts(full_lines, 1) AS pos FROM {p}w),
{p}nl AS (SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS nw, regexp_replace(regexp_replace({_lower(f"trim(line, {_SPACES})")}, '{_SEP}', ' ', 'g'), '[0-9]+', '0', 'g') AS h FROM {p}ln),
{p}dl AS (SELECT DISTINCT n.source, n.h, w.text FROM {p}nl n JOIN {p}w w USING (doc_id)),
{p}com AS (SELECT source, h FROM {p}dl GROUP BY source, h HAVING count(*) > {max_docs}),
{p}cut AS (SELECT n.doc_id, sum(n.nw) AS removed, list(n.line) AS lines FROM {p}nl n JOIN {p}com c ON c.h = n.h AND c.source IS NOT DISTINCT FROM n.source GROUP BY n.doc_id),
{p}st AS (SELECT b.*, c.removed, n_words < {min_words} OR 100*n_repeat_words > {repeat_percent}*n_words AS base_failed FROM {p}base b LEFT JOIN {p}cut c USING (doc_id)),
{p}out AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(n_words - removed < {min_words} OR 100*(n_words - removed) < {left_percent}*n_words, false) AS kept FROM {p}st),
{p}text AS (SELECT doc_id, CASE WHEN c.lines IS NULL THEN w.text ELSE array_to_string(list_filter(string_split(w.text, chr(10)), lambda x: NOT list_contains(c.lines, x)), chr(10)) END AS clean FROM {p}w w JOIN {p}out o USING (doc_id) LEFT JOIN {p}cut c USING (doc_id) WHERE o.kept)"""


def near_duplicates(src: str, p: str, width: int = 5, percent: int = 75) -> str:
    """``{p}out``: doc_id, n_shingles, component_id, kept. Needs WITH RECURSIVE."""
    return f"""
{p}w AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORD}') AS w FROM {src}),
{p}s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+{width - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM {p}w WHERE len(w) > 0)),
{p}n AS (SELECT doc_id, count(*) AS n FROM {p}s GROUP BY doc_id),
{p}both AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM {p}s a JOIN {p}s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
{p}links AS (SELECT a, b FROM {p}both JOIN {p}n x ON x.doc_id = a JOIN {p}n y ON y.doc_id = b WHERE 100*c >= {percent}*(x.n + y.n - c)),
{p}reach AS (SELECT doc_id, doc_id AS r FROM {src} UNION SELECT q.doc_id, l.b FROM {p}reach q JOIN {p}links l ON l.a = q.r),
{p}comp AS (SELECT doc_id, min(r) AS component_id FROM {p}reach GROUP BY doc_id),
{p}out AS (SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM {p}comp c LEFT JOIN {p}n n USING (doc_id))"""


def contaminated(src: str, p: str, window: int, misses: int, min_substituted: int) -> str:
    """``{p}out``: doc_id, item_id, item_tokens, matched_tokens, start. Items of
    under ``min_substituted`` tokens must match token for token."""
    tokens = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
{p}d AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS ix FROM (SELECT doc_id, {tokens} AS t FROM {src})),
{p}b AS (SELECT item_id, len(t) AS n, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS j FROM (SELECT item_id, {tokens} AS t FROM benchmark)),
{p}m AS (SELECT d.doc_id, b.item_id, b.n, d.ix - b.j AS shift, b.j FROM {p}d d JOIN {p}b b ON b.tok = d.tok),
{p}v AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS c, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS total FROM {p}m),
{p}ok AS (SELECT DISTINCT doc_id, item_id, n, shift, total FROM {p}v WHERE c >= least({window}, n) - CASE WHEN n < {min_substituted} THEN 0 ELSE floor(least({window}, n)*{misses}/{window}) END),
{p}out AS (SELECT doc_id, item_id, n::BIGINT AS item_tokens, total::BIGINT AS matched_tokens, shift::BIGINT AS start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY total DESC, shift) AS r FROM {p}ok) WHERE r = 1)"""


def mixing(src: str, p: str, weights, cap: int, chunks: int, seed: str) -> str:
    """``{p}out``: doc_id, size, source_size, target, copies."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % " + str(len(weights)) + " " + " ".join(f"WHEN {k} THEN {w}.0" for k, w in enumerate(weights)) + " END"
    return f"""
{p}d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS tie FROM {src}),
{p}c AS (SELECT *, length(bin(size))*16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class, ('0x' || substr(tie, 1, 8))::BIGINT % {chunks} AS chunk FROM {p}d),
{p}s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM {p}d GROUP BY source),
{p}s1 AS (SELECT *, ({weight})::DOUBLE AS w, (source_size*{cap})::DOUBLE AS cap FROM {p}s0),
{p}s2 AS (SELECT *, ((SELECT sum(source_size) FROM {p}s0) - coalesce(sum(cap) OVER (ORDER BY cap/w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))/sum(w) OVER (ORDER BY cap/w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {p}s1),
{p}s3 AS (SELECT source, source_size, CASE WHEN level*w >= cap THEN cap ELSE max(CASE WHEN level*w < cap THEN level END) OVER ()*w END AS target FROM {p}s2),
{p}r AS (SELECT c.*, row_number() OVER (PARTITION BY source ORDER BY class, chunk, size, doc_id, tie)::DOUBLE AS place FROM {p}c c),
{p}t AS (SELECT r.*, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN s.target/s.source_size ELSE 0.0 END AS rate, (('0x' || substr(md5('{seed}|' || coalesce(r.source, '')), 1, 5))::BIGINT::DOUBLE + 0.5)/1048576.0 AS off FROM {p}r r JOIN {p}s3 s ON s.source IS NOT DISTINCT FROM r.source),
{p}out AS (SELECT doc_id, size, source_size, target, least(floor(rate*place + off) - floor(rate*(place - 1) + off), {cap})::BIGINT AS copies FROM {p}t)"""


def archives() -> str:
    return """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS m, strlen(h) >= 1000 AS large FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN large AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN large AND page_id <> m THEN m END AS refers_to FROM q"""


def filter_audit(min_words: int, distinct_percent: int, upper_percent: int) -> str:
    """Counts of each part, order and step, straight from the definitions."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
firsts AS (SELECT t, min(doc_id) AS lo FROM w GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) = 1 AS good, max((toxic = 1)::INT) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(words) < {min_words} AS a, 100*len(list_distinct(words)) < {distinct_percent}*len(words) AS b, 100*len(regexp_extract_all(t, '[A-Z]')) > {upper_percent}*length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(doc_id, 9223372036854775807) > coalesce(lo, 9223372036854775807) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
p AS (SELECT '' AS o UNION ALL SELECT o || l FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)),
x AS (SELECT part, good, toxic, a::INT + b::INT + c::INT + d::INT + e::INT AS n, o AS filter_order, list_transform(string_split(o, ''), lambda l: CASE l WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails FROM f, p WHERE length(o) = 5),
y AS (SELECT *, coalesce(list_position(fails, true), 6) AS first FROM x),
z AS (SELECT *, unnest(range(1, 6)) AS step FROM y),
c AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS l, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (fails[step] AND first < step) AS redundant,
  count(*) FILTER (fails[step] AND n = 1) AS unique_fails, count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost FROM z GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM c"""


def spelling(min_length: int, min_count: int, ratio: int, damaged: int) -> str:
    """Near words by what is left when a letter is dropped; the CRC-32 by its table."""
    return f"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_lower("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {min_length} GROUP BY ALL),
keyed AS (SELECT run, k, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS bytes FROM runs),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, octet_length(bytes)), lambda j: ('0x' || substr(hex(bytes), (2*j + 1)::BIGINT, 2))::UBIGINT)), lambda x, y: xor(x // 256, t[(xor(x % 256, y) + 1)::BIGINT])), 4294967295::UBIGINT) AS h FROM keyed, tab),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % {damaged} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM hashed) WHERE length(word) >= {min_length} GROUP BY word HAVING sum(k) >= {min_count}),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS left_over FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT * FROM (SELECT x.word, y.word AS other FROM less x JOIN less y ON x.i = y.i AND x.left_over = y.left_over AND x.word <> y.word
  UNION ALL SELECT x.word, w.word FROM less x JOIN words w ON w.word = x.left_over UNION ALL SELECT w.word, x.word FROM less x JOIN words w ON w.word = x.left_over)),
best AS (SELECT e.word, count(*)::BIGINT AS n_near, arg_min(w.word, (-w.n, w.word)) AS top, max(w.n) AS top_n FROM near e JOIN words w ON w.word = e.other GROUP BY e.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= {ratio}*w.n THEN top END AS form, CASE WHEN top_n >= {ratio}*w.n THEN top_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT k.word, k.next, f.form FROM walk k JOIN f ON f.word = k.next)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk k ON k.word = f.word AND k.next IS NULL"""
