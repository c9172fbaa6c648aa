"""SQL pieces for the oracles (DuckDB)."""

from __future__ import annotations


def iou(a: str, b: str) -> str:
    w = f"greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    h = f"greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    size = lambda p: f"({p}x2 - {p}x1) * ({p}y2 - {p}y1)"
    return f"({w} * {h} / nullif({size(a)} + {size(b)} - {w} * {h}, 0))"


def inside(px: str, py: str, poly: str = "poly") -> str:
    """Point in polygon: crossing parity or on an edge."""
    a, b = f"{poly}[i]", f"{poly}[i % len({poly}) + 1]"
    cross = f"(({a}.y > {py}) <> ({b}.y > {py})) AND {px} < ({b}.x - {a}.x) * ({py} - {a}.y) / nullif({b}.y - {a}.y, 0) + {a}.x"
    on = f"({b}.x - {a}.x) * ({py} - {a}.y) - ({b}.y - {a}.y) * ({px} - {a}.x) = 0 AND {px} BETWEEN least({a}.x, {b}.x) AND greatest({a}.x, {b}.x) AND {py} BETWEEN least({a}.y, {b}.y) AND greatest({a}.y, {b}.y)"
    return f"(len([1 FOR i IN range(1, len({poly}) + 1) IF {cross}]) % 2 = 1 OR len([1 FOR i IN range(1, len({poly}) + 1) IF {on}]) > 0)"


def scaled(poly: str = "poly", f: float = 1.1) -> str:
    cx, cy = (f"trunc(list_avg([p.{k} FOR p IN {poly}]))" for k in "xy")
    return f"[{{'x': trunc({cx} + (p.x - {cx}) * {f}), 'y': trunc({cy} + (p.y - {cy}) * {f})}} FOR p IN {poly}]"


def state(frame: str = "frame", p: str = "p") -> str:
    c = f"({p}.green + {p}.yellow + {p}.red)"
    return f"CASE WHEN {frame} % {c} < {p}.green THEN 'green' WHEN {frame} % {c} < {p}.green + {p}.yellow THEN 'yellow' ELSE 'red' END"


BARE = "regexp_replace({}, '[^A-Za-z0-9]', '', 'g')"


def letters(t: str) -> str:
    return f"length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))"


def digits(t: str) -> str:
    return f"length(regexp_replace({t}, '[^0-9]', '', 'g'))"


def pattern(t: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({t}, '[^A-Za-z0-9-]', '', 'g'), '[A-Za-z]', 'L', 'g'), '[0-9]', 'N', 'g')"


def similar(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) > 0 AND length({b}) > 0 THEN 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) ELSE 0 END"


def valid(t: str) -> str:
    from ..functions.plates import FORMATS

    return f"(length({t}) >= 5 AND (regexp_full_match({t}, '{FORMATS}') OR regexp_matches({t}, '[A-Z]{{2,3}}.*\\d{{2,3}}')))"


def coherence(t: str) -> str:
    n, l, d = f"length({t})", letters(t), digits(t)
    first = f"list_min([i FOR i IN range(1, {n} + 1) IF regexp_matches({t}[i], '%s')])"
    last = f"list_max([i FOR i IN range(1, {n} + 1) IF regexp_matches({t}[i], '%s')])"
    order = f"CASE WHEN {last % '[A-Za-z]'} < {first % '[0-9]'} THEN 0.3 WHEN {last % '[0-9]'} < {first % '[A-Za-z]'} THEN 0.2 ELSE 0 END"
    size = f"CASE WHEN {n} BETWEEN 6 AND 7 THEN 0.2 WHEN {n} BETWEEN 5 AND 8 THEN 0.1 ELSE 0 END"
    balance = f"CASE WHEN {l} > 0 AND {d} > 0 AND abs({l} - {d}) <= 2 THEN 0.2 ELSE 0 END"
    ratio = f"CASE WHEN {l} = 3 AND {d} = 3 THEN 0.3 WHEN {l} = 2 AND {d} >= 3 THEN 0.2 WHEN {l} = 1 AND {d} >= 4 THEN 0.1 ELSE 0 END"
    return f"(CASE WHEN {n} >= 5 THEN least(1.0, ({order}) + ({size}) + ({balance}) + ({ratio})) ELSE 0 END)::DOUBLE"


def matches(a: str, b: str) -> str:
    return f"len([1 FOR i IN range(1, least(length({a}), length({b})) + 1) IF {a}[i] = {b}[i]])"


def fold(t: str) -> str:
    return f"translate(upper({t}), 'ODQILJZEASGCTBPR', '0001112345667899')"


def run(t: str) -> str:
    """First of the longest runs of digits."""
    r = f"regexp_extract_all({t}, '\\d+')"
    return f"coalesce(list_filter({r}, lambda x: length(x) = list_max([length(y) FOR y IN {r}]))[1], '')"


def format_break(t: str) -> str:
    """Characters before the first change from letter to digit or back, else by rule."""
    turn = f"[i FOR i IN range(2, length({t}) + 1) IF (regexp_matches({t}[i - 1], '[A-Z]') AND regexp_matches({t}[i], '[0-9]')) OR (regexp_matches({t}[i - 1], '[0-9]') AND regexp_matches({t}[i], '[A-Z]'))]"
    digit = f"[i FOR i IN range(1, length({t}) + 1) IF regexp_matches({t}[i], '[0-9]')]"
    mixed = f"{letters(t)} > 0 AND {letters(t)} < length({t})"
    return f"CASE WHEN length({t}) = 0 THEN 0 WHEN len({turn}) > 0 THEN {turn}[1] - 1 WHEN {mixed} AND {letters(t)} <= floor(length({t}) / 2) THEN {letters(t)} WHEN {mixed} AND len({digit}) > 0 THEN {digit}[1] - 1 ELSE floor(length({t}) / 2) END"


def context(view: str) -> str:
    """Look-alikes put right by place; a hyphen before the first two digits that follow letters."""
    from ..functions.plates import FORMATS

    first, second = "'0128564', 'OIZBSGA'", "'OIZBSGATQD', '0128564700'"
    c, before = "t[i + 1]", "(i > 0 AND regexp_matches(t[i], '[%s]'))"
    is_letter, is_digit = f"regexp_matches({c}, '[A-Z]')", f"regexp_matches({c}, '[0-9]')"
    special = f"CASE WHEN i IN (0, 4) AND {is_digit} THEN translate({c}, {first}) WHEN i NOT IN (0, 4) AND {is_letter} THEN translate({c}, {second}) ELSE {c} END"
    plain = f"CASE WHEN i < cut AND {is_digit} AND NOT {before % '0-9'} THEN translate({c}, {first}) WHEN i >= cut AND {is_letter} AND NOT {before % 'A-Z'} THEN translate({c}, {second}) ELSE {c} END"
    turn = "list_min([i FOR i IN range(3, length(u)) IF regexp_matches(u[i - 1], '[A-Z]') AND regexp_matches(u[i], '[0-9]') AND regexp_matches(u[i + 1], '[0-9]')])"
    return f"""WITH t AS (SELECT read_id, regexp_replace(upper(text), '[^A-Z0-9-]', '', 'g') AS t FROM {view}),
k AS (SELECT *, CASE WHEN contains(t, '-') THEN instr(t, '-') - 1 ELSE {format_break('t')} END AS dash FROM t), c AS (SELECT *, CASE WHEN dash > 0 THEN dash ELSE floor(length(t) / 2) END AS cut FROM k),
d AS (SELECT read_id, t, CASE WHEN regexp_full_match(t, '[A-Z][0-9]{{2,4}}[A-Z][0-9]{{1,2}}') THEN array_to_string([{special} FOR i IN range(0, length(t))], '') ELSE array_to_string([{plain} FOR i IN range(0, length(t))], '') END AS u FROM c),
e AS (SELECT *, {turn} AS turn FROM d)
SELECT read_id, CASE WHEN length(t) < 3 THEN t WHEN regexp_full_match(u, '{FORMATS}') OR contains(u, '-') OR turn IS NULL THEN u ELSE u[1:turn - 1] || '-' || substr(u, turn) END AS text FROM e"""


def region(view: str) -> str:
    """Plates of region ES: two parts, look-alikes put right in each, the number of usual length."""
    letter, digit = "'0123456789', 'OIZEASGTBP'", "'ODCQILTZSGEAJYBPR', '00001112563417899'"
    return f"""WITH t AS (SELECT read_id, regexp_replace(upper(trim(text)), '[^A-Z0-9-]', '', 'g') AS t FROM {view}),
p AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS ds, regexp_replace(t, '[0-9]', '', 'g') AS ls, string_split(t, '-') AS sp FROM t),
q AS (SELECT *, CASE WHEN length(t) < 6 THEN NULL WHEN contains(t, '-') THEN CASE WHEN len(sp) = 2 THEN sp END
  WHEN regexp_full_match(t, '[0-9]+[A-Z]+|[A-Z]+[0-9]+') THEN [regexp_extract(t, '^([0-9]+|[A-Z]+)', 1), regexp_extract(t, '([0-9]+|[A-Z]+)$', 1)]
  WHEN length(t) >= 7 AND ds <> '' AND ls <> '' THEN [ds[1:4], ls[1:3]] ELSE [t[1:2], substr(t, 3)] END AS parts FROM p),
r AS (SELECT *, CASE WHEN length(parts[1]) <= 3 THEN translate(parts[1], {letter}) ELSE parts[1] END AS a, translate(parts[2], {digit}) AS b FROM q),
m AS (SELECT *, CASE WHEN parts IS NULL THEN t WHEN a <> '' AND b <> '' THEN a || '-' || b ELSE a || b END AS mid FROM r), z AS (SELECT *, string_split(mid, '-') AS z FROM m),
f AS (SELECT *, CASE WHEN len(z) = 2 THEN CASE WHEN length(z[1]) <= 3 AND NOT regexp_full_match(z[1], '[0-9]+') THEN translate(z[1], {letter}) ELSE z[1] END || '-' || CASE WHEN length(z[2]) > 5 THEN z[2][1:5] WHEN length(z[2]) < 4 AND regexp_full_match(z[2], '[0-9]+') THEN lpad(z[2], 4, '0') ELSE z[2] END ELSE mid END AS last FROM z)
SELECT read_id, CASE WHEN length(replace(t, '-', '')) > 8 OR length(replace(last, '-', '')) > 8 THEN '' ELSE last END AS plate FROM f"""
