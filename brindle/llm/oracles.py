"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from brindle.llm import decontaminate
from brindle.llm import line_frequency as lines
from brindle.llm.queries import LISTED_DIGITS, LISTED_DOMAINS, PROBE_TEXT, RULES

WORD = r"[^\x20\x09-\x0D]+"


def quality_rules() -> str:
    k = lines.REPEAT_WINDOW
    return rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '{WORD}') as w from d),
g as (select r, unnest(range(1, len(w) - {k - 2})) as i, w from w where len(w) >= {k}),
h as (select r, i, hash(array_to_string(w[i : i + {k - 1}], ' ')) as g from g),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as c from h) where c > 1),
cover as (select r, count(distinct p) as n from (select r, unnest(range(i, i + {k})) as p from again) group by r),
l as (select r, source, unnest(string_split(t, chr(10))) as raw from d),
norm as (select r, source, raw,
    trim(regexp_replace(translate(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '123456789', '000000000'),
      '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as line from l),
dup as (select r, count(*) - count(distinct raw) as n from norm where regexp_matches(raw, '{WORD}') group by r),
sized as (select n.r, n.source, line, length(line) - length(replace(line, ' ', '')) + 1 as words, d.doc_id, d.t from norm n join d using (r) where line <> ''),
docs as (select source, count(*) as n from (select distinct source, doc_id, t from d) group by source),
held as (select source, line, count(*) as n from (select distinct source, line, doc_id, t from sized) group by source, line),
common as (select h.source, line from held h join docs on h.source is not distinct from docs.source where h.n > greatest({lines.LEAST_DOCS}, docs.n * {lines.MAX_SHARE})),
gone as (select s.r, sum(words) as n from sized s join common c on s.source is not distinct from c.source and s.line = c.line group by s.r),
s as (select d.r, d.doc_id, len(w.w)::bigint as n_words, length(array_to_string(w.w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
    coalesce(cover.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as n_removed
    from d join w using (r) left join dup using (r) left join cover using (r) left join gone using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_words - n_removed >= n_words * {lines.MIN_LEFT} as kept
from s"""


def url_filter() -> str:
    fits = "\n".join(
        f"    when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.text}'"
        for r in sorted(RULES, key=lambda r: -len(r.text))
    )
    told = " ".join(f"when '{r.text}' then '{r.verdict}'" for r in RULES)
    named = ", ".join(f"('{d}')" for d in LISTED_DOMAINS)
    return rf"""
with u as (select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
listed as (select host as key from u where host <> '' and contains('{LISTED_DIGITS}', md5(host)[1]) union values {named}),
bad as (select distinct h.host from (select distinct host from u) h join listed l on h.host = l.key or ends_with(h.host, '.' || l.key)),
f as (select *, case
{fits}
    end as rule from u)
select page_id, f.host, path, rule, coalesce(case rule {told} end, case when bad.host is not null then 'block' else 'allow' end) as verdict
from f left join bad on f.host = bad.host"""


def chat_format() -> str:
    return rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '{PROBE_TEXT}'), (-1, 1, 'assistant', '{PROBE_TEXT}')),
e as (select *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') as safe,
    replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\', '\\'), chr(10), '\n') as safe_role from c)
select conv_id, count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(length('<|im_start|>') + length(safe_role) + 1 + length(safe) + length('<|im_end|>') + 1)::bigint as formatted_chars
from e group by conv_id"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def decontamination() -> str:
    n = decontaminate.SPAN
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    text = _LOWER.format("coalesce(text, '')")
    return rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({text}, '{word}') as w from documents),
b as (select item_id, regexp_extract_all({text}, '{word}') as w from benchmark),
items as (select item_id, least(len(w), {n}) as k, w, unnest(range(1, len(w) - least(len(w), {n}) + 2)) as i from b where len(w) > 0),
win as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as t from items),
spot as (select r, k, w, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from win) where len(w) >= k),
hit as (select r, i, p.k, item_id from (select r, i, k, array_to_string(w[i : i + k - 1], ' ') as t from spot) p join win on p.k = win.k and p.t = win.t),
words as (select r, count(distinct p) as n from (select r, unnest(range(i, i + k)) as p from hit) group by r),
ids as (select r, count(*) as n, string_agg(i, ',' order by i) as ids from (select distinct r, item_id::varchar as i from hit) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(words.n, 0)::bigint as n_hit, coalesce(ids.n, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words using (r) left join ids using (r)"""


def near_dedup() -> str:
    text = _LOWER.format("coalesce(text, '')")
    return rf"""
with recursive d as (select doc_id, regexp_extract_all({text}, '{WORD}') as w from documents),
s as (select distinct doc_id, x from (
    select doc_id, array_to_string(w[i : i + 2], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
    union all select doc_id, len(w) || ':' || array_to_string(w, ' ') from d where len(w) between 1 and 2)),
n as (select doc_id, count(*) as n from s group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach as (select doc_id as a, doc_id as b from d union select reach.a, edge.b from reach join edge on reach.b = edge.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(reach.b) as component_id, min(reach.b) = d.doc_id as kept
from d left join n using (doc_id) join reach on reach.a = d.doc_id group by d.doc_id, n.n"""


def hard_negatives() -> str:
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5"""


def spelling_variants() -> str:
    return """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents
), own AS (
  SELECT doc_id, w, count(*) AS n, string_split(doc_id || ':' || w, '') AS chars FROM runs WHERE length(w) >= 7 GROUP BY doc_id, w
), hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295,
    flatten(list_transform(chars, lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 + (ord(c) >> 6))::BIGINT, (128 + (ord(c) & 63))::BIGINT] END))),
    lambda c, b: xor(c >> 8, step[1 + (xor(c, b) & 255)]))) AS h
  FROM own, crc
), noisy AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed
), vocab AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS MATERIALIZED (
  SELECT word, n, length(word) AS len, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM vocab)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less AS a JOIN less AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less AS a JOIN vocab AS b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less AS a JOIN vocab AS b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, min_by(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM near GROUP BY word
), formed AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n
  FROM vocab AS v LEFT JOIN best AS b ON v.word = b.word
), walk AS (
  SELECT word, word AS at, 0 AS steps FROM formed
  UNION ALL SELECT w.word, f.form, w.steps + 1 FROM walk AS w JOIN formed AS f ON w.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, max_by(w.at, w.steps) AS root, any_value(f.n) AS n, any_value(f.n_near) AS n_near, any_value(f.form_n) AS form_n
FROM formed AS f JOIN walk AS w ON f.word = w.word GROUP BY f.word, f.form"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination(),
        "op6_quality_rules": quality_rules(),
        "op7_near_dedup": near_dedup(),
        "op8_url_filter": url_filter(),
        "op9_chat_format": chat_format(),
        "op11_hard_negatives": hard_negatives(),
        "op13_spelling_variants": spelling_variants(),
    }
