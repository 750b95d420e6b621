"""DuckDB SQL for the registered queries, built from the same parts as they are."""

from __future__ import annotations

from collections.abc import Callable

from lakeloom.functions import display, normalize as N

DOCS = """items AS (
  SELECT lang AS scope, doc_id AS item_id, md5(text) AS content_id, nullif(split_part(text, chr(10), 1), '') AS name, strlen(text)::BIGINT AS size, n_chars AS duration,
         source AS performer, CASE WHEN len(string_split(text, chr(10))) > 1 THEN nullif(split_part(text, chr(10), 2), '') END AS title
  FROM documents
)"""
PARTS = """items AS (
  SELECT p_brand AS scope, p_partkey AS item_id, md5(p_name || '|' || p_type || '|' || p_size) AS content_id, replace(p_name, ' ', '_') || ' ' || p_size || '.mp3' AS name,
         CASE WHEN p_type <> 'SMALL' THEN floor(p_retailprice)::BIGINT END AS size, p_size::BIGINT AS duration,
         CASE WHEN p_type = 'PROMO' THEN '<unknown>' ELSE nullif(p_type, 'LARGE') END AS performer, CASE WHEN p_type NOT IN ('PROMO', 'LARGE') THEN upper(p_name) END AS title
  FROM part
)"""


def sub(e: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({e}, '{pattern}', '{to}', 'gi')"


def strip(e: str) -> str:
    return sub(e, r"^\s+|\s+$", "")


def clean(e: str) -> str:
    """normalize.clean_name of an SQL expression."""
    bare = sub(e, N.EXTENSION, "")
    uncopied = sub(f"lower({bare})", N.COPY_NUMBER)
    out = sub(sub(sub(uncopied, N.NUMBER_PREFIX), N.BRACKETED_SITE), N.ADDRESS)
    out = strip(sub(sub(out, N.SITE_PREFIX), N.SITE_SUFFIX))
    out = sub(f"translate({out}, '_-', '  ')", N.DOMAIN)
    ids = N.LONG_ID.replace("(?<=[a-zа-яё\\d])", "([a-zа-яё0-9])")
    out = strip(sub(f"trim({sub(out, r'\s+')})", ids, r"\1"))
    pure = f"regexp_matches({strip(uncopied)}, '{N.PURE_ID}')"
    return f"CASE WHEN coalesce({e}, '') = '' THEN '' WHEN {pure} THEN {strip(f"translate({uncopied}, '_-', '  ')")} WHEN {out} <> '' THEN {out} WHEN {strip(bare)} <> '' THEN {strip(bare)} ELSE {e} END"


def searchable(e: str) -> str:
    return rf"coalesce(trim(regexp_replace(lower({e}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '')"


def comparable(e: str) -> str:
    return rf"trim(regexp_replace(lower({e}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def tags(performer: str = "performer", title: str = "title") -> str:
    real = lambda c: f"CASE WHEN {c} <> '' AND NOT regexp_matches({c}, '{N.PLACEHOLDER}', 'i') THEN {c} END"
    return f"concat_ws(' ', {real(performer)}, {real(title)})"


def numbers(e: str) -> str:
    return rf"list_sort(list_distinct(list_transform(regexp_extract_all({e}, '\d+'), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0'))))"


def size_text(e: str) -> str:
    cases = " ".join(f"WHEN abs({e}) >= {1024**p} THEN printf('%.2f {u}', abs({e}) / {float(1024**p)}::DOUBLE)" for p, u in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB")))
    return f"CASE WHEN {e} IS NULL THEN NULL {cases} ELSE abs({e})::BIGINT || ' B' END"


def time_text(e: str) -> str:
    return f"CASE WHEN coalesce({e}, 0) <= 0 THEN '00:00' WHEN {e} >= 3600 THEN printf('%d:%02d:%02d', {e} // 3600, {e} // 60 % 60, {e} % 60) ELSE printf('%02d:%02d', {e} // 60, {e} % 60) END"


def shown(name: str = "name") -> str:
    return f"coalesce(nullif({name}, ''), nullif(concat_ws(' - ', nullif(performer, ''), nullif(title, '')), ''), '(untitled)')"


def link(scope: str, item: str) -> str:
    return f"'https://t.me/c/' || regexp_replace({scope}::VARCHAR, '^-100', '') || '/' || {item}"


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence of a text of up to 62 letters with another, bit-parallel."""
    mask = f"list_sum(list_transform(range(0, length({a})), lambda j: CASE WHEN substr({a}, (j + 1)::INT, 1) = c THEN (1::BIGINT << j::INT) ELSE 0 END))::BIGINT"
    full = f"((1::BIGINT << length({a})::INT) - 1)"
    steps = f"list_prepend({full}, list_transform(string_split({b}, ''), lambda c: {mask}))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count(list_reduce({steps}, lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})) END"


def words(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda w: w <> '')"


def in_order(e: str) -> str:
    return f"array_to_string(list_sort({words(e)}), ' ')"


def indel(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * ({common(a, b)}) / (length({a}) + length({b})) END"


def set_ratio_ctes(source: str) -> str:
    """CTE ``ratio(a, b, r)`` over the distinct pairs (a, b) of a CTE."""
    gone = lambda x, y: f"array_to_string(list_sort(list_distinct(list_filter({words(x)}, lambda v: NOT list_contains({words(y)}, v)))), ' ')"
    return f"""rp AS (SELECT DISTINCT a, b FROM {source}), rw AS (
  SELECT a, b, {gone('a', 'b')} AS x, {gone('b', 'a')} AS y, array_to_string(list_sort(list_distinct(list_filter({words('a')}, lambda v: list_contains({words('b')}, v)))), ' ') AS z FROM rp
), rl AS (
  SELECT a, b, x, y, length(z) AS s, length(x) + length(y) - 2 * ({common('y', 'x')}) AS away, length(z) + (length(z) > 0)::INT + length(x) AS wx, length(z) + (length(z) > 0)::INT + length(y) AS wy FROM rw
), ratio AS (
  SELECT a, b, CASE WHEN trim(a) = '' OR trim(b) = '' THEN 0.0::DOUBLE WHEN s > 0 AND (x = '' OR y = '') THEN 100.0::DOUBLE
    WHEN s = 0 THEN 100 * (1 - away::DOUBLE / (wx + wy))
    ELSE greatest(100 * (1 - away::DOUBLE / (wx + wy)), 100 * (1 - (1 + length(x))::DOUBLE / (s + wx)), 100 * (1 - (1 + length(y))::DOUBLE / (s + wy))) END AS r FROM rl
)"""


def weighted_ctes(source: str) -> str:
    """CTE ``weighted(a, b, r)`` over the distinct pairs (a, b) of a CTE."""
    meet = f"len(list_filter({words('a')}, lambda v: list_contains({words('b')}, v))) > 0"
    return f"""{set_ratio_ctes(source)}, pairs AS (
  SELECT a, b, r, {in_order('a')} AS p, {in_order('b')} AS q, greatest(length(a), length(b))::DOUBLE / least(length(a), length(b)) AS unlike, {meet} AS meet FROM ratio WHERE a <> '' AND b <> ''
), sides AS (
  SELECT u, v, CASE WHEN length(u) <= length(v) THEN u ELSE v END AS short, CASE WHEN length(u) <= length(v) THEN v ELSE u END AS long
  FROM (SELECT a AS u, b AS v FROM pairs WHERE unlike >= 1.5 UNION SELECT p, q FROM pairs WHERE unlike >= 1.5 AND NOT meet)
), stretches AS (
  SELECT u, v, short, substr(long, greatest(i, 0) + 1, i + length(short) - greatest(i, 0)) AS stretch FROM (SELECT *, unnest(range(1 - length(short), length(long))) AS i FROM sides)
), partial AS (SELECT u, v, max({indel('short', 'stretch')}) AS r FROM stretches GROUP BY u, v), weighted AS (
  SELECT a, b, 0.0::DOUBLE AS r FROM ratio WHERE a = '' OR b = '' UNION ALL
  SELECT a, b, greatest({indel('a', 'b')}, 0.95::DOUBLE * ({indel('p', 'q')}), 0.95::DOUBLE * r) FROM pairs WHERE unlike < 1.5 UNION ALL
  SELECT a, b, greatest({indel('b', 'a')}, scale * whole.r, 0.95::DOUBLE * scale * CASE WHEN meet THEN 100 ELSE sorted.r END)
  FROM (SELECT *, CASE WHEN unlike <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS scale FROM pairs WHERE unlike >= 1.5) AS far JOIN partial AS whole ON a = whole.u AND b = whole.v LEFT JOIN partial AS sorted ON p = sorted.u AND q = sorted.v
)"""


READY = f"""ready AS (
  SELECT scope, item_id, content_id, coalesce(duration, 0) AS duration, coalesce(size, 0) AS size, {comparable('n')} AS name_text, {comparable('t')} AS tags_text, {numbers('n')} AS name_numbers, {numbers('t')} AS tags_numbers
  FROM (SELECT *, {clean('name')} AS n, {clean(tags())} AS t FROM items)
), band AS (
  SELECT x, y FROM ready AS x JOIN ready AS y ON x.scope = y.scope AND y.duration BETWEEN x.duration AND x.duration + 3 AND (x.duration < y.duration OR x.item_id < y.item_id)
)"""


def near(c: str, power: float) -> str:
    return f"CASE WHEN x.{c} > 0 AND y.{c} > 0 THEN pow(least(x.{c}, y.{c})::DOUBLE / greatest(x.{c}, y.{c}), {power}::DOUBLE) ELSE 0.0::DOUBLE END"


def limit(theta: float) -> str:
    known = lambda c: f"x.{c} > 0 AND y.{c} > 0"
    return f"{theta}::DOUBLE - CASE WHEN {known('duration')} THEN 0 ELSE {theta}::DOUBLE * 0.3::DOUBLE END - CASE WHEN {known('size')} THEN 0 ELSE {theta}::DOUBLE * 0.2::DOUBLE END"


def penalty(a: str, b: str, jaccard: bool) -> str:
    same, either = f"len(list_intersect({a}, {b}))", f"len(list_distinct(list_concat({a}, {b})))"
    part = f"0.08::DOUBLE * (1 - {same}::DOUBLE / greatest({either}, 1))" if jaccard else "0.08::DOUBLE"
    return f"CASE WHEN {same} = {either} THEN 0.0::DOUBLE ELSE {part} END"


def texts(jaccard: bool) -> str:
    """CTE ``best``: the pair with its best text source."""
    sides = (("name", "name"), ("name", "tags"), ("tags", "name"), ("tags", "tags"))
    asked = " UNION ALL ".join(f"SELECT x.{i}_text AS a, y.{j}_text AS b FROM band" for i, j in sides)
    real = lambda i, j: " AND ".join(["true", *(f"{s}.tags_text <> ''" for s, k in (("x", i), ("y", j)) if k == "tags")])
    four = " UNION ALL ".join(f"SELECT x, y, {k} AS src, x.{i}_text AS a, y.{j}_text AS b, {penalty(f'x.{i}_numbers', f'y.{j}_numbers', jaccard)} AS pen FROM band WHERE {real(i, j)}" for k, (i, j) in enumerate(sides))
    return f"""asked AS ({asked}), {set_ratio_ctes('asked')}, four AS ({four}), rated AS (
  SELECT x, y, src, pen, pow(r / 100, 1.5::DOUBLE) AS ratio FROM four JOIN ratio USING (a, b)
), best AS (
  SELECT x, y, src::INT AS src, ratio, pen FROM rated QUALIFY row_number() OVER (PARTITION BY x.item_id, y.item_id ORDER BY 0.5::DOUBLE * ratio - pen DESC, src) = 1
)"""


def links(theta: float = 0.9, jaccard: bool = False) -> str:
    return f"""{texts(jaccard)}, scored AS (
  SELECT x, y, src, ratio, pen, {near('duration', 4.0)} AS dur, {near('size', 0.9)} AS siz, {limit(theta)} AS thr FROM best WHERE NOT (x.content_id = y.content_id)
), links AS (
  SELECT x.scope AS scope, least(x.item_id, y.item_id) AS a, greatest(x.item_id, y.item_id) AS b, 'fuzzy' AS reason, 0.5::DOUBLE * ratio + (0.3::DOUBLE * dur + 0.2::DOUBLE * siz) - pen AS score,
         ratio AS name_score, dur AS duration_score, siz AS size_score, pen AS penalty, src AS text_source
  FROM scored WHERE 0.5::DOUBLE * ratio + (0.3::DOUBLE * dur + 0.2::DOUBLE * siz) - pen >= thr
)"""


EDGE_COLUMNS = "scope, a, b, reason, round(score, 6) AS score, round(name_score, 6) AS name_score, round(duration_score, 6) AS duration_score, round(size_score, 6) AS size_score, round(penalty, 6) AS penalty, coalesce([' (name-name)', ' (name-tags)', ' (tags-name)', ' (tags-tags)'][text_source + 1], '') AS text_source"
UID = "SELECT p.scope, p.item_id AS a, q.item_id AS b FROM items AS p JOIN items AS q ON p.scope = q.scope AND p.content_id = q.content_id AND p.content_id <> '' AND p.item_id < q.item_id"
META = "SELECT p.scope, p.item_id AS a, q.item_id AS b FROM items AS p JOIN items AS q ON p.scope = q.scope AND p.item_id < q.item_id AND " + " AND ".join(f"p.{c} IS NOT DISTINCT FROM q.{c}" for c in ("name", "size", "duration", "performer", "title"))


def edges(theta: float, jaccard: bool) -> str:
    return f"WITH {PARTS}, {READY}, {links(theta, jaccard)} SELECT {EDGE_COLUMNS} FROM (SELECT scope, a, b, 'uid' AS reason, 1.0::DOUBLE AS score, NULL::DOUBLE AS name_score, NULL::DOUBLE AS duration_score, NULL::DOUBLE AS size_score, 0.0::DOUBLE AS penalty, NULL::INT AS text_source FROM ({UID}) UNION ALL SELECT * FROM links)"


def components(pairs: str) -> str:
    """CTE ``groups(scope, item_id, group_id)`` of the links that a query gives."""
    return f"""ends AS MATERIALIZED (SELECT scope, a, b FROM ({pairs}) UNION SELECT scope, b, a FROM ({pairs})), reach AS (
  SELECT scope, a AS item_id, a AS seen FROM ends UNION SELECT reach.scope, reach.item_id, ends.b FROM reach JOIN ends ON reach.scope = ends.scope AND reach.seen = ends.a
), groups AS (SELECT scope, item_id, min(seen) AS group_id FROM reach GROUP BY scope, item_id)"""


EXACT = components(f"{UID} UNION {META}")
FUZZY = components(f"{UID} UNION SELECT scope, a, b FROM links")
MEMBERS = "members AS (SELECT * FROM items JOIN groups USING (scope, item_id))"
SNAPSHOT = """snap AS (
  SELECT scope, item_id, CASE WHEN quality = 0 THEN 'error' ELSE 'ok' END AS status, content_id, name, size, duration, performer, CASE WHEN toxic = 1 THEN coalesce(title, '') || '!' ELSE title END AS title
  FROM items JOIN labels ON item_id = doc_id
)"""
CHECKED = f"""WITH RECURSIVE {DOCS}, {EXACT}, {MEMBERS}, {SNAPSHOT}, checked AS (
  SELECT m.*, coalesce(s.status, 'missing') AS status, s.content_id AS fresh_id, s.title IS NOT DISTINCT FROM m.title AS same FROM members AS m LEFT JOIN snap AS s USING (scope, item_id)
)"""
CLASSIFIED = f"""{CHECKED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY scope, group_id ORDER BY CASE WHEN size > 0 THEN size END DESC NULLS LAST, item_id) - 1 AS keep_rank, bool_or(status = 'error') OVER (PARTITION BY scope, group_id) AS failed FROM checked
), firsts AS (
  SELECT *, min(CASE WHEN status = 'ok' AND fresh_id IS NOT NULL AND same THEN keep_rank END) OVER (PARTITION BY scope, group_id) AS first FROM ranked
), acts AS (
  SELECT *, CASE WHEN failed THEN 'skipped' WHEN status <> 'ok' OR fresh_id IS NULL THEN 'purge_local' WHEN NOT same THEN 'update_local' WHEN keep_rank = first THEN 'keep' ELSE 'delete_remote' END AS action FROM firsts
)"""
NAMES = f"""{PARTS}, names AS (
  SELECT 'page' AS kind, page_id AS id, url AS name FROM pages UNION ALL SELECT 'part', item_id, name FROM items UNION ALL SELECT 'doc', doc_id, nullif(split_part(text, chr(10), 1), '') FROM documents
)"""
EVENTS = """ev AS (
  SELECT user_id::VARCHAR AS scope, event_id AS item_id, event_type AS name, value FROM events
), stored AS (
  SELECT scope, item_id, name, round(value * 100)::BIGINT AS size FROM ev WHERE name <> 'view'
), batch AS (
  SELECT scope, item_id, name, round((value + 1) * 100)::BIGINT AS size FROM ev WHERE name <> 'click'
)"""
CURSORS = "cur AS (SELECT c_custkey::VARCHAR AS scope, 1 AS is_fully_synced, floor(c_acctbal)::BIGINT AS newest_scanned_id FROM customer)"
BROKEN = "coalesce(content_id, '') = '' OR (name IS NULL AND performer IS NULL AND title IS NULL) OR size IS NULL OR size < 0 OR duration IS NULL OR duration < 0"
DAMAGED = f"{DOCS}, hurt AS (SELECT * REPLACE (CASE WHEN length(title) > 100 THEN -1 ELSE duration END AS duration) FROM items), {SNAPSHOT}, plan AS (SELECT h.scope, h.item_id, CASE WHEN coalesce(s.status, 'missing') = 'error' THEN 'leave' WHEN s.status = 'ok' THEN 'update' ELSE 'delete' END AS step, s.duration AS fresh_duration, s.title AS fresh_title FROM hurt AS h LEFT JOIN snap AS s USING (scope, item_id) WHERE {BROKEN.replace('content_id', 'h.content_id').replace('name IS', 'h.name IS').replace('performer', 'h.performer').replace('title', 'h.title').replace('size', 'h.size').replace('duration', 'h.duration')})"
def found(items: str, asked: str, ctes: Callable[[str], str], ratios: str) -> str:
    """CTE ``hits``: items whose best text reaches the cutoff."""
    variants = ", ".join(comparable(t) for t in (searchable("name"), clean("name"), searchable(tags()), clean(tags())))
    return f"WITH {items}, texts AS (SELECT scope, item_id, unnest(list_distinct([{variants}])) AS a, '{asked}' AS b FROM items), {ctes('texts')}, hits AS (SELECT scope, item_id, round(max(r), 6) AS score FROM texts JOIN {ratios} USING (a, b) WHERE a <> '' GROUP BY scope, item_id HAVING max(r) >= 50)"


FOUND = found(PARTS, "small gizmo", set_ratio_ctes, "ratio")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLAN = """named AS (
  SELECT *, name AS base FROM items
), target AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY scope, lower(base)) > 1 THEN item_id || '_' || base ELSE base END AS file_name FROM named
), files AS (SELECT name, max(size) AS size FROM items WHERE duration > 25 GROUP BY name), plan AS (
  SELECT t.scope, t.item_id, t.file_name, coalesce(t.size, 0) AS size, coalesce(f.size > 0 AND abs(f.size - coalesce(t.size, 0)) < 100, false) AS done FROM target AS t LEFT JOIN files AS f ON t.file_name = f.name
)"""
TEXTS = f"tp AS ({' UNION '.join(f'SELECT x.{i}_text AS a, y.{j}_text AS b FROM band' for i in ('name', 'tags') for j in ('name', 'tags'))})"
SORTED = "CASE WHEN trim(a) = '' OR trim(b) = '' THEN 0.0::DOUBLE ELSE {} END"
REAL = lambda c: f"coalesce(lower(trim({c})) NOT IN ('', '<unknown>', '[unknown]', 'unknown', 'unknown artist'), false)"
QUALITY = f"({REAL('performer')})::INT + ({REAL('title')} AND {clean('title')} <> {clean('name')})::INT"


def width(e: str) -> str:
    """Terminal cells of an SQL expression."""
    combining, wide = display.width_classes()
    return f"coalesce(length(regexp_replace({e}, '[{combining}]', '', 'g')) + length(regexp_replace({e}, '[^{wide}]', '', 'g')), 0)"


def file_name(e: str) -> str:
    """sanitize_filename of an SQL expression."""
    bare = rf"regexp_replace(regexp_replace(regexp_replace(coalesce({e}, ''), '[\x00-\x1F\x7F]', '', 'g'), '[<>:\"/\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g')"
    legal = f"(SELECT CASE WHEN upper(split_part(f, '.', 1)) IN ({', '.join(f"'{r}'" for r in display.RESERVED)}) THEN '_' || f ELSE f END AS f FROM (SELECT {bare} AS f))"
    parts = rf"(SELECT f, CASE WHEN strlen(regexp_extract(f, '\.[^.]*$')) <= {display.EXTENSION_BYTES + 1} THEN regexp_extract(f, '\.[^.]*$') ELSE '' END AS tail FROM {legal})"
    fits = f"list_max(list_filter(range(0, {display.NAME_BYTES + 1}), lambda k: strlen(substr(f, 1, k)) <= {display.NAME_BYTES} - strlen(tail)))"
    return f"(SELECT CASE WHEN f = '' THEN '{display.UNNAMED}' WHEN strlen(f) <= {display.NAME_BYTES} THEN f ELSE substr(f, 1, {fits}) || tail END FROM {parts})"


#: CTE ``turns``: the winner of each group by size within a tenth, duration within a twentieth and id, then that of the rest, and so on.
TURNS = """rests AS (
  SELECT scope, group_id, list({'id': item_id, 's': CASE WHEN size > 0 THEN size::DOUBLE END, 'd': CASE WHEN duration > 0 THEN duration::DOUBLE END}) AS rest FROM members GROUP BY scope, group_id
), turns AS (
  SELECT scope, group_id, -1 AS place, NULL::BIGINT AS id, rest FROM rests UNION ALL
  SELECT scope, group_id, place + 1, win, list_filter(rest, lambda m: m.id <> win) FROM (
    SELECT *, list_min(list_transform(CASE WHEN d IS NULL THEN pool ELSE list_filter(pool, lambda m: coalesce(abs(m.d - d) <= d * 0.05::DOUBLE, false)) END, lambda m: m.id)) AS win FROM (
      SELECT *, list_max(list_transform(pool, lambda m: m.d)) AS d FROM (
        SELECT *, CASE WHEN s IS NULL THEN rest ELSE list_filter(rest, lambda m: coalesce(abs(m.s - s) <= s * 0.1::DOUBLE, false)) END AS pool FROM (
          SELECT *, list_max(list_transform(rest, lambda m: m.s)) AS s FROM turns WHERE len(rest) > 0))))
)"""
ROW = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("content_id", "duration", "item_id", "name", "performer", "scope", "size", "title"))

ORACLE_SQL = {
    "scan_scope_filter": f"WITH {DOCS} SELECT scope, item_id, name, size, duration FROM items WHERE scope = 'de'",
    "broken_rows_count": f"WITH {PARTS} SELECT scope, count(*) FILTER (WHERE {BROKEN}) AS broken, count(*) AS n FROM items GROUP BY scope",
    "validate_tables": f"WITH {PARTS}, {CURSORS} SELECT 'broken_rows' AS \"check\", count(*) FILTER (WHERE {BROKEN}) AS n FROM items UNION ALL SELECT 'negative_cursors', count(*) FILTER (WHERE newest_scanned_id < 0) FROM cur UNION ALL SELECT 'repeated_keys', (SELECT count(*) FROM (SELECT 1 FROM items GROUP BY scope, item_id HAVING count(*) > 1))",
    "reset_cursors": f"WITH {CURSORS} SELECT scope, is_fully_synced, greatest(newest_scanned_id, 0) AS newest_scanned_id FROM cur",
    "clean_name": f"WITH {NAMES} SELECT kind, id, name, {clean('name')} AS cleaned FROM names",
    "clean_for_search": f"WITH {NAMES} SELECT kind, id, name, {searchable('name')} AS cleaned FROM names",
    "process_text": f"WITH {NAMES} SELECT kind, id, name, {comparable('c')} AS comparable FROM (SELECT *, {clean('name')} AS c FROM names)",
    "clean_meta": f"WITH {PARTS} SELECT scope, item_id, {clean('t')} AS cleaned, {searchable('t')} AS searchable FROM (SELECT *, {tags()} AS t FROM items)",
    "number_tokens": f"WITH {NAMES} SELECT kind, id, coalesce(array_to_string({numbers('c')}, ','), '') AS numbers FROM (SELECT *, {clean('name')} AS c FROM names)",
    "format_bytes": f"WITH {DOCS}, b AS (SELECT item_id, size FROM items UNION ALL SELECT o_orderkey, floor(o_totalprice * 100000)::BIGINT FROM orders) SELECT item_id, size, {size_text('size')} AS shown FROM b",
    "format_duration": f"WITH {DOCS} SELECT item_id, duration, {time_text('duration')} AS shown FROM items",
    "message_link": f"SELECT o_orderkey, {link("('-100' || o_custkey)", 'o_orderkey')} AS link FROM orders",
    "display_title": f"WITH {PARTS} SELECT item_id, {shown('(CASE WHEN duration > 10 THEN name END)')} AS shown FROM items",
    "safe_cells": f"WITH {DOCS} SELECT " + ", ".join(f"CASE WHEN regexp_matches(coalesce({c}::VARCHAR, ''), '^[=+@-]') THEN '''' ELSE '' END || coalesce({c}::VARCHAR, '') AS {c}" for c in ("item_id", "name", "title", "duration")) + " FROM items",
    "sanitize_filename": f"WITH {DOCS} SELECT item_id, {file_name('name')} AS file_name FROM items",
    "visual_width": f"WITH {DOCS} SELECT item_id, {width('name')} AS width FROM items",
    "display_widths": f"WITH {DOCS} SELECT " + ", ".join(f"max({width(f'{c}::VARCHAR')}) AS {c}" for c in ("item_id", "name", "title")) + " FROM items",
    "access_rules": "WITH c AS (SELECT c_custkey, list_transform(range(0, 6), lambda k: (c_custkey >> k::INT) % 2 = 1) AS f FROM customer) SELECT c_custkey, f[1] OR (NOT f[2] AND f[3] AND f[4]) OR (f[2] AND (f[4] OR f[5] OR f[6])) AS allowed FROM c",
    "chat_label": "WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS t, concat_ws(' | ', CASE WHEN c_nationkey > 4 THEN '@' || lower(c_name) END, c_custkey::VARCHAR) AS tail FROM customer) SELECT c_custkey, CASE WHEN t IS NULL THEN tail ELSE t || ' [' || tail || ']' END AS label FROM c",
    "resolve_identifiers": "SELECT c_custkey::VARCHAR AS scope, c_custkey AS pos, 1::BIGINT AS times FROM customer WHERE c_nationkey < 15",
    "message_projection": "SELECT user_id::VARCHAR AS scope, event_id AS item_id, props AS content_id, event_type AS name, CASE WHEN event_type = 'click' THEN round(value * 100)::BIGINT ELSE user_id END AS size, 0::BIGINT AS duration, CASE WHEN event_type = 'click' THEN 'p' END AS performer, NULL::VARCHAR AS title FROM events WHERE event_type IN ('click', 'view')",
    "content_id_pairs": f"WITH {DOCS} {UID}",
    "exact_meta_pairs_nullsafe": f"WITH {DOCS} SELECT p.scope, p.item_id AS a, q.item_id AS b FROM items AS p JOIN items AS q ON p.scope = q.scope AND p.item_id < q.item_id AND p.name IS NOT DISTINCT FROM q.name AND CASE WHEN length(p.title) < 60 THEN p.title END IS NOT DISTINCT FROM CASE WHEN length(q.title) < 60 THEN q.title END",
    "exact_edges_with_reason": f"WITH {DOCS.replace('source AS performer', 'NULL::VARCHAR AS performer')} SELECT scope, a, b, CASE WHEN min(k) = 0 THEN 'uid' ELSE 'meta' END AS reason, 1.0::DOUBLE AS score FROM (SELECT *, 0 AS k FROM ({UID}) UNION ALL SELECT *, 1 FROM ({META})) GROUP BY scope, a, b",
    "exact_groups": f"WITH RECURSIVE {DOCS}, {EXACT} SELECT scope, item_id, group_id FROM groups",
    "group_sizes": f"WITH RECURSIVE {DOCS}, {EXACT} SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM groups GROUP BY scope, group_id) GROUP BY n",
    "band_join_pairs": f"WITH {DOCS} SELECT x.scope, x.item_id AS first, y.item_id AS second, y.duration - x.duration AS apart FROM items AS x JOIN items AS y ON x.scope = y.scope AND y.duration BETWEEN x.duration AND x.duration + 3 AND (x.duration < y.duration OR x.item_id < y.item_id)",
    "band_window_counts": f"WITH {DOCS} SELECT x.scope, x.item_id, count(y.item_id) AS candidates FROM items AS x LEFT JOIN items AS y ON x.scope = y.scope AND y.duration BETWEEN x.duration AND x.duration + 3 AND (x.duration < y.duration OR x.item_id < y.item_id) GROUP BY x.scope, x.item_id",
    "pair_numeric_scores": f"WITH {PARTS}, {READY} SELECT x.item_id AS first, y.item_id AS second, round({near('duration', 4.0)}, 6) AS duration_score, round({near('size', 0.9)}, 6) AS size_score FROM band",
    "dynamic_threshold": f"WITH {PARTS}, {READY} SELECT x.item_id AS first, y.item_id AS second, round({limit(0.9)}, 6) AS threshold FROM band",
    "number_penalty_binary": f"WITH {PARTS}, {READY} SELECT x.item_id AS first, y.item_id AS second, round({penalty('x.name_numbers', 'y.name_numbers', False)}, 6) AS penalty FROM band",
    "number_penalty_jaccard": f"WITH {PARTS}, {READY} SELECT x.item_id AS first, y.item_id AS second, round({penalty('x.name_numbers', 'y.name_numbers', True)}, 6) AS penalty FROM band",
    "indel_ratio": f"WITH {PARTS}, {READY}, {TEXTS} SELECT a, b, round({indel('a', 'b')}, 6) AS ratio FROM tp",
    "token_sort_ratio": f"WITH {PARTS}, {READY}, {TEXTS}, so AS (SELECT a, b, {in_order('a')} AS p, {in_order('b')} AS q FROM tp) SELECT a, b, round({SORTED.format(indel('p', 'q'))}, 6) AS ratio FROM so",
    "token_set_ratio": f"WITH {PARTS}, {READY}, {TEXTS}, {set_ratio_ctes('tp')} SELECT a, b, round(r, 6) AS ratio FROM ratio",
    "weighted_ratio": f"WITH {PARTS}, {READY}, {TEXTS}, {weighted_ctes('tp')} SELECT a, b, round(r, 6) AS ratio FROM weighted",
    "best_text_source": f"WITH {PARTS}, {READY}, {texts(False)} SELECT x.item_id AS first, y.item_id AS second, src AS text_source, round(ratio, 6) AS ratio, round(pen, 6) AS penalty FROM best",
    "fuzzy_edges": edges(0.9, False),
    "fuzzy_edges_loose": edges(0.8, True),
    "fuzzy_groups": f"WITH RECURSIVE {PARTS}, {READY}, {links()}, {FUZZY} SELECT scope, item_id, group_id FROM groups",
    "score_distribution": f"WITH {PARTS}, {READY}, {links()} SELECT count(*) AS n, round(min(score), 6) AS least, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS p75, round(max(score), 6) AS most FROM links",
    "match_rate": f"WITH {PARTS}, {READY}, {links()} SELECT (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM band) AS candidates, round((SELECT count(*) FROM links)::DOUBLE / nullif((SELECT count(*) FROM band), 0), 6) AS rate",
    "survivor_winner": f"WITH RECURSIVE {DOCS}, {EXACT}, {MEMBERS}, v AS (SELECT *, CASE WHEN size > 0 THEN size::DOUBLE END AS v FROM members), b AS (SELECT *, max(v) OVER (PARTITION BY scope, group_id) AS best FROM v), n AS (SELECT *, best IS NULL OR coalesce(abs(v - best) <= abs(best) * 0.02::DOUBLE, false) AS alive FROM b) SELECT scope, group_id, item_id, alive AND item_id = min(CASE WHEN alive THEN item_id END) OVER (PARTITION BY scope, group_id) AS keep FROM n",
    "survivor_order": f"WITH RECURSIVE {DOCS}, {EXACT}, {MEMBERS}, q AS (SELECT *, {QUALITY} AS q, nullif(length({clean('name')}), 0) AS l FROM members) SELECT scope, group_id, item_id, (row_number() OVER (PARTITION BY scope, group_id ORDER BY q DESC, CASE WHEN duration > 0 THEN duration END DESC NULLS LAST, l DESC NULLS LAST, item_id) - 1)::INT AS keep_rank FROM q",
    "survivor_order_least": f"WITH RECURSIVE {DOCS}, {EXACT}, {MEMBERS} SELECT scope, group_id, item_id, (row_number() OVER (PARTITION BY scope, group_id ORDER BY CASE WHEN size > 0 THEN size END NULLS LAST, CASE WHEN duration > 0 THEN duration END NULLS LAST, item_id DESC) - 1)::INT AS keep_rank FROM members",
    "survivor_order_tolerant": f"WITH RECURSIVE {PARTS}, {READY}, {links()}, {FUZZY}, {MEMBERS}, {TURNS} SELECT scope, group_id, id AS item_id, place::INT AS keep_rank FROM turns WHERE id IS NOT NULL",
    "best_meta_score": f"WITH {PARTS} SELECT item_id, {QUALITY} AS quality FROM items",
    "verify_status": f"{CHECKED} SELECT scope, status, count(*) AS n FROM checked GROUP BY scope, status",
    "classify_actions": f"{CLASSIFIED} SELECT scope, group_id, item_id, action FROM acts",
    "group_veto": f"{CLASSIFIED} SELECT DISTINCT scope, group_id FROM acts WHERE failed",
    "ignore_list_filter": f"{CLASSIFIED} SELECT scope, item_id, action FROM acts WHERE NOT (action = 'delete_remote' AND scope = 'fr')",
    "regex_protection": f"WITH {DOCS} SELECT scope, item_id FROM items WHERE (scope = 'en' AND (coalesce(regexp_matches(name, '^Th'), false) OR coalesce(regexp_matches(performer, '^Th'), false) OR coalesce(regexp_matches(title, '^Th'), false))) OR coalesce(regexp_matches(name, 'src1$'), false) OR coalesce(regexp_matches(performer, 'src1$'), false) OR coalesce(regexp_matches(title, 'src1$'), false)",
    "delete_batches": f"WITH {DOCS} SELECT scope, item_id, (row_number() OVER (PARTITION BY scope ORDER BY item_id) - 1) // 100 AS batch FROM items",
    "planned_changes": f"{CLASSIFIED} SELECT scope, action, count(*) AS n, min(item_id) AS first_id, max(item_id) AS last_id FROM acts GROUP BY scope, action",
    "insert_or_ignore": f"WITH {EVENTS} SELECT * FROM stored UNION ALL SELECT * FROM batch WHERE (scope, item_id) NOT IN (SELECT scope, item_id FROM stored)",
    "upsert_latest": f"WITH {EVENTS} SELECT * FROM batch UNION ALL SELECT * FROM stored WHERE (scope, item_id) NOT IN (SELECT scope, item_id FROM batch)",
    "upsert_repeated_keys": f"WITH {EVENTS} SELECT scope, item_id, name, size + 7 AS size FROM batch UNION ALL SELECT * FROM stored WHERE (scope, item_id) NOT IN (SELECT scope, item_id FROM batch)",
    "update_repeated_keys": f"WITH {EVENTS} SELECT s.scope, s.item_id, s.name, CASE WHEN b.item_id IS NULL THEN s.size ELSE b.size + 7 END AS size FROM stored AS s LEFT JOIN batch AS b USING (scope, item_id)",
    "forced_refresh": f"WITH {EVENTS} SELECT * FROM batch UNION ALL SELECT * FROM stored WHERE (scope, item_id) NOT IN (SELECT scope, item_id FROM batch)",
    "archive_gate": f"WITH {DOCS}, n AS (SELECT scope, item_id, (row_number() OVER (PARTITION BY scope ORDER BY item_id) - 1) // 20 AS batch, coalesce(toxic, 0) = 0 AS ok FROM items LEFT JOIN labels ON item_id = doc_id) SELECT scope, item_id, batch FROM n QUALIFY bool_and(ok) OVER (PARTITION BY scope, batch)",
    "gone_items": f"WITH {DOCS} SELECT scope, item_id FROM items WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE quality <> 0)",
    "spread_errors": f"WITH {DOCS}, {SNAPSHOT}, n AS (SELECT scope, item_id, status, (row_number() OVER (PARTITION BY scope ORDER BY item_id) - 1) // 25 AS chunk FROM snap) SELECT scope, item_id, CASE WHEN bool_or(status = 'error') OVER (PARTITION BY scope, chunk) THEN 'error' ELSE status END AS status FROM n",
    "delete_by_key": f"WITH {EVENTS} SELECT * FROM stored WHERE (scope, item_id) NOT IN (SELECT scope, item_id FROM batch)",
    "update_by_key": f"WITH {EVENTS} SELECT s.scope, s.item_id, s.name, CASE WHEN b.item_id IS NULL THEN s.size ELSE b.size END AS size FROM stored AS s LEFT JOIN batch AS b USING (scope, item_id)",
    "cursor_high_water": f"WITH {EVENTS} SELECT scope, 1 AS is_fully_synced, max(item_id) AS newest_scanned_id FROM (SELECT scope, item_id FROM stored UNION ALL SELECT scope, item_id FROM batch) GROUP BY scope",
    "incremental_rows": f"WITH {EVENTS}, seen AS (SELECT scope, floor(quantile_cont(item_id, 0.5))::BIGINT AS newest FROM stored GROUP BY scope) SELECT scope, item_id FROM batch LEFT JOIN seen USING (scope) WHERE newest IS NULL OR newest <= 0 OR item_id > newest",
    "repair_plan": f"WITH {DAMAGED} SELECT scope, item_id, step FROM plan",
    "repaired_items": f"WITH {DAMAGED} SELECT h.scope, h.item_id, CASE WHEN step = 'update' THEN fresh_duration ELSE h.duration END AS duration, CASE WHEN step = 'update' THEN fresh_title ELSE h.title END AS title FROM hurt AS h LEFT JOIN plan USING (scope, item_id) WHERE step IS DISTINCT FROM 'delete'",
    "export_filenames": f"WITH {DOCS} SELECT name FROM items WHERE length(name) > 0 ORDER BY name",
    "export_filenames_with_links": f"WITH {PARTS} SELECT name || repeat(' ', greatest(80 - {width('name')}, 1)) || {link('scope', 'item_id')} AS line FROM items WHERE length(name) > 0",
    "snapshot_fingerprint": f"WITH {DOCS} SELECT count(*) AS n, sum(('0x' || substr(md5({ROW}), 1, 15))::BIGINT)::VARCHAR AS hash FROM items",
    "export_cleaned_names": f"WITH {PARTS}, c AS (SELECT name, {clean('name')} AS cleaned FROM items WHERE length(name) > 0) SELECT name, cleaned, {comparable('cleaned')} AS comparable FROM c",
    "export_cleaned_meta": f"WITH {PARTS}, c AS (SELECT performer, title, {clean(tags())} AS cleaned FROM items WHERE performer IS NOT NULL OR title IS NOT NULL) SELECT performer, title, cleaned, {comparable('cleaned')} AS comparable FROM c WHERE cleaned <> ''",
    "report_rows": f"WITH RECURSIVE {DOCS}, {EXACT}, {MEMBERS}, r AS (SELECT *, (row_number() OVER (PARTITION BY scope, group_id ORDER BY CASE WHEN size > 0 THEN size END DESC NULLS LAST, item_id) - 1)::INT AS keep_rank FROM members) SELECT scope, group_id, keep_rank, item_id, CASE WHEN keep_rank = 0 THEN 'KEEP' ELSE '' END AS mark, {shown()} AS shown, {size_text('size')} AS bytes, {time_text('duration')} AS length, {link('scope', 'item_id')} AS link FROM r",
    "report_edges": f"WITH RECURSIVE {PARTS}, {READY}, {links()}, {FUZZY} SELECT links.scope, group_id, a, b, round(score, 6) AS score FROM links JOIN groups ON links.scope = groups.scope AND links.a = groups.item_id",
    "report_text": f"""WITH RECURSIVE {PARTS}, {READY}, {links()}, {FUZZY}, {MEMBERS}, rkept AS (
  SELECT *, row_number() OVER (PARTITION BY scope, group_id ORDER BY CASE WHEN size > 0 THEN size END DESC NULLS LAST, item_id) - 1 AS keep_rank FROM members
), rlines AS (
  SELECT scope, group_id, keep_rank, [CASE WHEN keep_rank = 0 THEN '* [KEEP] ' ELSE '* ' END || name, '  Tags: ' || coalesce(nullif(concat_ws(' - ', nullif(trim(performer), ''), nullif(trim(title), '')), ''), 'none'),
    '  Info: ' || concat_ws(' | ', {size_text('coalesce(size, 0)')}, {time_text('duration')}, 'id ' || item_id, 'content ' || content_id), '  Link: ' || {link('scope', 'item_id')}] AS lines FROM rkept
), redges AS (
  SELECT scope, a, b, 'same content' AS why, 1.0::DOUBLE AS score FROM ({UID}) UNION ALL
  SELECT scope, a, b, printf('score %.3f | text %.2f%s | duration %.2f | size %.2f | penalty -%.2f', score, name_score, [' (name-name)', ' (name-tags)', ' (tags-name)', ' (tags-tags)'][text_source + 1], duration_score, size_score, penalty), score FROM links
), rg AS (SELECT redges.*, group_id, row_number() OVER (PARTITION BY redges.scope, group_id ORDER BY round(score, 9) DESC, a, b) AS place FROM redges JOIN groups ON redges.scope = groups.scope AND redges.a = groups.item_id)
SELECT scope, group_id, 0 AS part, 0::BIGINT AS place, '--- GROUP ' || group_id || ' (items: ' || count(*) || ') ---' AS line FROM groups GROUP BY scope, group_id
UNION ALL SELECT scope, group_id, 1, keep_rank * 4 + i, lines[i + 1] FROM rlines, range(4) AS t(i)
UNION ALL SELECT scope, group_id, 2, 0, '  Links (' || count(*) || '):' FROM rg GROUP BY scope, group_id
UNION ALL SELECT scope, group_id, 3, place, '    ' || a || ' <-> ' || b || ': ' || why FROM rg""",
    "backups_kept": f"WITH {DOCS}, c AS (SELECT 'copy' AS kind, 'copy4' AS stamp, scope FROM items WHERE scope <> 'de' UNION ALL SELECT 'copy', 'copy5', scope FROM items UNION ALL SELECT 'archive', 'copy2', scope FROM items WHERE scope = 'en') SELECT kind, stamp, scope, count(*) AS n FROM c GROUP BY kind, stamp, scope",
    "vacuumed": "SELECT user_id::VARCHAR AS scope, event_id AS item_id, event_type AS name, round(value * 100)::BIGINT AS size FROM events",
    "catalog_columns": f"SELECT table_name AS \"table\", ordinal_position::INT AS position, column_name AS \"column\" FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)})",
    "missing_tables": "SELECT t AS \"table\" FROM (VALUES ('cursors'), ('documents'), ('events'), ('ignored'), ('items')) AS v(t) WHERE t NOT IN (SELECT table_name FROM information_schema.tables)",
    "download_names": """WITH n AS (
  SELECT user_id::VARCHAR AS scope, event_id AS item_id, CASE event_type WHEN 'click' THEN 'click.ogg' WHEN 'view' THEN 'audio_' || event_id || '.mp3' ELSE event_type || '.' || event_type END AS base FROM events
) SELECT scope, item_id, CASE WHEN count(*) OVER (PARTITION BY scope, lower(base)) > 1 THEN item_id || '_' || base ELSE base END AS file_name FROM n""",
    "search_top_k": f"{FOUND} SELECT scope, item_id, score FROM hits ORDER BY score DESC, scope, item_id LIMIT 50",
    "search_all": f"{FOUND} SELECT scope, item_id, score FROM hits",
    "search_wratio": f"{found(PARTS, 'small gizmo', weighted_ctes, 'weighted')} SELECT scope, item_id, score FROM hits",
    "search_listing": f"{found(DOCS, 'theatly there', set_ratio_ctes, 'ratio')} SELECT scope, item_id, score, {shown()} AS shown, {time_text('duration')} AS length, {size_text('size')} AS bytes, {link('scope', 'item_id')} AS link FROM hits JOIN items USING (scope, item_id) ORDER BY score DESC, scope, item_id LIMIT 50",
    "retention_newest_n": "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || lpad(o_orderkey::VARCHAR, 10, '0') AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3 AS keep FROM orders",
    "download_plan": f"WITH {PARTS}, {PLAN} SELECT * FROM plan",
    "download_totals": f"WITH {PARTS}, {PLAN} SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE NOT done) AS files_left, coalesce(sum(size) FILTER (WHERE NOT done), 0)::BIGINT AS bytes_left FROM plan",
    "stream_incremental_ingest": "SELECT user_id::VARCHAR AS scope, event_id AS item_id, event_type AS name, round(value * 100)::BIGINT AS size FROM events",
}
