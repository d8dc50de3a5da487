"""SQL for DuckDB that computes the queries' rows from the tables, without diff text or our parser."""

from __future__ import annotations

from hunkwise.plans import expected as ex
from hunkwise.plans import queries as q
from hunkwise.sources import corpus

KEY = "diff_id, file_seq, hunk_seq"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def _case(on: str, of: dict[str, str]) -> str:
    return f"case {on} " + " ".join(f"when {text(k)} then {text(v)}" for k, v in of.items()) + " end"


_PATH = f"replace(list_extract({_list(corpus.PATHS)}, ((doc_id + f) % {len(corpus.PATHS)} + 1)::int), '{{}}', (doc_id % 40)::varchar)"
_TEXT = r"regexp_replace(coalesce(text, ''), '[^\n\x20-\x7e]', '', 'g')"

BASE = f"""
d0 as (select doc_id, regexp_split_to_array({_TEXT}, '[.\\n] *') as ls from documents where doc_id is not null),
d1 as (select *, case when len(ls) >= 267 then 300 when len(ls) >= 134 and doc_id % 2 = 0 then 140 when len(ls) >= 54 and doc_id % 2 = 0 then 60 else 24 end as per from d0),
d2 as (select doc_id, per, unnest(range(0, len(ls))) as i, unnest(ls) as x from d1),
d3 as (
  select doc_id, per, i, i // per as k, (i // per) // 2 as f, case i % 4 when 0 then ' ' when 3 then '-' else '+' end as m,
    '  ' || case when (doc_id * 7 + i * 13) % 17 = 0 then list_extract({_list(corpus.SNIPPETS)}, ((doc_id + i) % {len(corpus.SNIPPETS)} + 1)::int) else x end as c
  from d2
), d4 as (
  select doc_id, f, k, any_value(per) as per, string_agg(m || c, chr(10) order by i) as body,
    coalesce(string_agg(c, chr(10) order by i) filter (m = '+'), '') as plus, coalesce(list(c order by i) filter (m = '+'), []) as plus_l, coalesce(list(c order by i) filter (m = '-'), []) as minus_l,
    count(*) filter (m = '+')::int as added, count(*) filter (m = '-')::int as removed, count(*) filter (m = ' ')::int as same
  from d3 group by all
), h0 as (
  select doc_id as diff_id, (f + 1)::int as file_seq, (k - 2 * f + 1)::int as hunk_seq, {_PATH} as file_path,
    case when (doc_id + f) % 10 = 0 then 'added' when (doc_id + f) % 10 = 1 then 'deleted' when doc_id % 11 = 5 then 'modified' when (doc_id + f) % 10 = 2 then 'renamed' when (doc_id + f) % 10 = 3 then 'copied' else 'modified' end as change_type,
    (doc_id + f) % 10 = 4 and doc_id % 11 <> 5 as new_mode, doc_id % 11 = 5 as plain,
    (1 + per * k)::int as new_start, (removed + same)::int as old_lines, (added + same)::int as new_lines,
    case when doc_id % 3 = 0 then ' def handler_' || (doc_id % 50) || '():  ' else '' end as heading, body, plus, plus_l, minus_l, added, removed, added + removed as changed
  from d4
), h as (select *, substr(sha1(file_path || chr(0) || new_start || chr(0) || body), 1, 12) as id from h0),
files as (
  select diff_id, file_seq, any_value(file_path) as path, any_value(change_type) as change_type,
    any_value(case change_type when 'added' then null when 'renamed' then 'old/' || file_path when 'copied' then 'old/' || file_path else file_path end) as old_path,
    any_value(case change_type when 'deleted' then null else file_path end) as new_path,
    any_value(case when plain then null when change_type = 'deleted' or new_mode then '100644' end) as old_mode,
    any_value(case when plain then null when change_type = 'added' then '100644' when new_mode then '100755' end) as new_mode, false as is_binary
  from h group by diff_id, file_seq
  union all
  select diff_id, max(file_seq) + 1, 'img/' || diff_id || '.png', 'added', 'img/' || diff_id || '.png', 'img/' || diff_id || '.png', null, '100644', true
  from h where diff_id % 7 = 3 and not plain group by diff_id
  union all
  select diff_id, max(file_seq) + 1, 'b/caf' || chr(195) || chr(169) || ' ' || diff_id || '.txt', 'modified', 'a/caf' || chr(195) || chr(169) || ' ' || diff_id || '.txt', 'b/caf' || chr(195) || chr(169) || ' ' || diff_id || '.txt', '100644', '100755', false
  from h where diff_id % 7 = 2 and not plain group by diff_id
)
"""


def _size() -> str:
    cases = lambda at: " ".join(f"when changed >= {row[0]} then {row[at] if at == 1 else text(row[at])}" for row in ex.SIZE)
    return f"select {KEY}, 0 as ro, 0 as so, 'size' as rule, case {cases(1)} end as points, case {cases(2)} end || ': ' || changed || ' changed lines (+' || added || '/-' || removed || ')' as reason from h where changed >= {ex.SIZE[-1][0]}"


def _surface(extra=()) -> str:
    return " union all ".join(f"select {KEY}, 1 as ro, {j} as so, 'surface' as rule, {p} as points, {text(r)} as reason from h where regexp_matches(file_path, {text('(?i)' + rx)})" for j, (rx, p, r) in enumerate((*ex.SURFACE, *extra)))


def _matches(of: str, ro: int, so: int, rule: str, pattern: str, points: int, reason: str) -> str:
    n = f"len(regexp_extract_all({of}, {text(pattern)}))"
    return f"select {KEY}, {ro}, {so}, '{rule}', {points}, {text(reason)} || case when {n} > 1 then ' (x' || {n} || ')' else '' end from h where {n} > 0"


def _danger() -> str:
    first = f"""select {KEY}, 2, 0, 'danger', case when change_type = 'deleted' then {ex.DELETED} when removed >= {ex.LARGE_FROM} then {ex.LARGE_DELETION} else {ex.NET_DELETION} end,
    case when change_type = 'deleted' then 'deletes a file' when removed >= {ex.LARGE_FROM} then 'large deletion: -' || removed || ' lines' else 'net deletion (-' || removed || '/+' || added || ')' end
    from h where change_type = 'deleted' or removed >= {ex.LARGE_FROM} or removed > added"""
    return " union all ".join([first, *[_matches("plus", 2, j + 1, "danger", ("(?i)" if i else "") + rx, p, r) for j, (rx, i, p, r) in enumerate(ex.DANGER)]])


_BARE = "list_transform({}, lambda x: regexp_replace(x, '(?s)(?:#|//).*', ''))"
CONTROL = f"""
c0 as (select *, {_BARE.format('plus_l')} as pl, {_BARE.format('minus_l')} as ml from h),
c1 as (select *, array_to_string(list_concat(pl, ml), chr(10)) as code, list_filter({_list(ex.OPERATORS)}, lambda o: len(list_filter(pl, lambda x: contains(x, o))) > 0) as po,
  list_filter({_list(ex.OPERATORS)}, lambda o: len(list_filter(ml, lambda x: contains(x, o))) > 0) as mo,
  len(list_filter(pl, lambda x: regexp_matches(x, '\\bnot\\b'))) > 0 as pn, len(list_filter(ml, lambda x: regexp_matches(x, '\\bnot\\b'))) > 0 as mn,
  len(list_filter(list_concat(pl, ml), lambda x: trim(x) <> '')) > 0 as live from c0),
c as (select *, list_sort(list_filter(mo, lambda o: not list_contains(po, o))) as lost, list_sort(list_filter(po, lambda o: not list_contains(mo, o))) as gained from c1 where live)
"""


def _control() -> str:
    shown = lambda v: f"case when len({v}) = 0 then '·' else array_to_string({v}, '/') end"
    fill = lambda t, v: " || ".join((text(t.split("{}")[0]), v, text(t.split("{}")[1])))
    parts = [
        f"select {KEY}, 3, 0, 'control', {ex.COMPARISON}, {fill(ex.COMPARISON_REASON, '(' + shown('lost') + ') || ' + text(' → ') + ' || (' + shown('gained') + ')')} from c where len(po) > 0 and len(mo) > 0 and len(lost) + len(gained) > 0",
        f"select {KEY}, 3, 1, 'control', {ex.NEGATION}, {fill(ex.NEGATION_REASON, 'case when pn then ' + text('added') + ' else ' + text('removed') + ' end')} from c where pn <> mn",
    ]
    parts += [_matches("code", 3, j + 2, "control", rx, p, r).replace(" from h ", " from c ") for j, (rx, p, r) in enumerate(ex.CONTROL)]
    return " union all ".join(parts)


def _sql(body: str, *ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def _signals(*parts: str, name: str = "sig") -> str:
    return f"{name} as (" + "\nunion all ".join(parts) + ")"


CLI = _signals(_size(), _surface(), _danger())
LIBRARY = _signals(_size(), _surface(), _danger(), _control())


def _scored(sig: str = "sig", name: str = "sc") -> str:
    value = f"case when raw <= 0 then 0 else least(100, greatest(0, round_even(100 * (1 - exp(-raw / {ex.SCALE!r})), 0)))::int end"
    return f"""
{name}0 as (
  select {KEY}, sum(points)::int as raw, string_agg(reason || case when points > 0 then ' (+' || points || ')' else '' end, '; ' order by points desc, ro, so) as why,
    string_agg(reason, '; ' order by points desc, ro, so) as message, arg_min(rule, (-points, ro, so)) as first_rule
  from {sig} group by all
), {name}1 as (select h.*, coalesce(raw, 0) as raw, coalesce(why, '') as why, coalesce(message, '') as message, first_rule from h left join {name}0 using ({KEY})
), {name}2 as (select *, {value} as score from {name}1
), {name} as (select *, case when score >= 60 then 'gulp' when score >= 25 then 'sip' else 'savor' end as tier, row_number() over (partition by diff_id order by score desc, raw desc, id, file_seq, hunk_seq)::int as rank from {name}2)
"""


RANKED = f"select {KEY}, id, file_path, raw, score, tier, rank, why from sc"
SCORED = _scored()


def _long(*parts: str, ctes: tuple[str, ...] = ()) -> str:
    return _sql(f"select {KEY}, row_number() over (partition by {KEY} order by ro, so)::int as ord, rule, points::int as points, reason from sig", BASE, *ctes, _signals(*parts))


def _weights() -> str:
    by = "case rule " + " ".join(f"when '{k}' then {v}" for k, v in corpus.WEIGHTS.items()) + " else 1.0 end"
    return f"wsig as (select * from (select {KEY}, ro, so, rule, greatest(0, round_even(points * ({by})::double, 0))::int as points, reason from sig) where points > 0)"


def _profile(names: list[str]) -> str:
    by: dict[str, float] = {}
    for name in names:
        for c, m in ex.PROFILES[name].items():
            by[c] = by.get(c, 1.0) * m
    label = "+".join(names)
    kind = "case " + f"when reason = {text(ex.FRONTEND_REASON)} then 'frontend' " + " ".join(f"when contains(lower(reason), {text(w.lower())}) then '{c}'" for w, c in ex.CATEGORY_OF) + " end"
    marker = f" union all select {KEY}, 100000, 'surface', {ex.FRONTEND_POINTS}, {text(ex.FRONTEND_REASON)} from h where regexp_matches(file_path, {text('(?i)' + ex.FRONTEND_PATH)})" if "frontend" in by else ""
    factor = "case kind " + " ".join(f"when '{c}' then {m!r}::double" for c, m in by.items()) + " end"
    percent = {c: round((m - 1) * 100) for c, m in by.items()}
    note = "case kind " + " ".join(f"when '{c}' then ' ({'boosted +' if p > 0 else 'eased '}{p}% by profile: {label})'" for c, p in percent.items()) + " end"
    # ties keep the order of the first scoring, in which the marker comes last
    return f"""
p1 as (select {KEY}, row_number() over (partition by {KEY} order by points desc, ro, so) as so, rule, points, reason from sig),
p2 as (select *, {kind} as kind from (select {KEY}, so, rule, points, reason from p1{marker})),
psig as (select * from (select {KEY}, 0 as ro, so, rule, case when kind in ({', '.join(f"'{c}'" for c in by)}) then greatest(0, round_even(points * {factor}, 0))::int else points end as points,
  reason || coalesce({note}, '') as reason from p2) where points > 0)
"""


def _hotspots() -> str:
    hot = lambda at: "case " + " ".join(f"when commits::double / busiest >= {s} and commits >= {f} then {p if at == 2 else text(t)}" for s, f, p, t in ex.HOT) + " end"
    fixed = f"(fixes > 0 and fixes::double / commits >= {ex.FIX_RATIO})"
    return f"""select {KEY}, 5, 0, 'hotspots', {hot(2)} + case when {fixed} then {ex.FIX_POINTS} else 0 end,
  'hotspot: file ' || {hot(3)} || case when {fixed} then {text(ex.FIX_WORDS)} else '' end || ' (' || commits || ' commits' || case when fixes = 0 then '' when fixes = 1 then ', 1 fix' else ', ' || fixes || ' fixes' end || ')'
  from h join churn on file_path = path where {hot(2)} is not null"""


CHURN = f"""
touched as (
  select case when event_id % 20 < 8 then 'src/auth/login.py' when event_id % 20 < 12 then 'package.json' when event_id % 20 < 14 then 'styles/main.css' when event_id % 20 < 15 then 'yarn.lock' else 'src/core/mod' || (event_id % 40) || '.py' end as path,
    event_type = 'error' or (event_id % 20 between 8 and 11 and event_type = 'view') as fix
  from events where event_id is not null
), churn as (select path, count(*) as commits, count(*) filter (fix) as fixes, max(count(*)) over () as busiest from touched group by path)
"""


def _owners() -> str:
    """Who owns each of the corpus' paths, said line by line."""
    fits = (  # the last line that fits counts
        ("file_path like 'docs/guide%' and substr(file_path, 11, 1) <> '1'", ["@guides"]),
        ("file_path like 'src/core/mod%.py' and substr(file_path, 13, 1) between '0' and '3'", ["@core"]),
        ("file_path like 'web/components/Card1%.tsx'", ["@web"]),
        ("starts_with(file_path, 'db/migrations')", ["@dba", "@lead", "@ops"]),
        ("file_path like '%.md'", []),
        ("starts_with(file_path, 'docs/')", ["@docs"]),
        ("file_path = 'src/auth/login.py'", ["@sec", "@lead"]),
        ("starts_with(file_path, 'src/api/')", ["@api"]),
        ("file_path like '%.py'", ["@py-team"]),
    )
    own = "case " + " ".join(f"when {fit} then {_list(o) if o else '[]::varchar[]'}" for fit, o in fits) + " else []::varchar[] end"
    named = "case len(o) when 1 then o[1] when 2 then o[1] || ' and ' || o[2] else o[1] || ', ' || o[2] || ', and ' || o[3] end"
    return f"""select {KEY}, 6, 0, 'owners', case when len(o) = 0 then {ex.UNOWNED} else {ex.OTHER_OWNER} end,
  case when len(o) = 0 then {text(ex.UNOWNED_REASON)} else 'owned by ' || {named} || ', not the author' end
  from (select *, {own} as o from h) where len(list_filter(o, lambda x: lower(x) = {text(corpus.AUTHOR.lower())})) = 0"""


def _owners_index() -> str:
    """As ``corpus.many_codeowners`` lists them, kind by kind."""
    fits = (
        "p = 'src/core/mod' || j || '.py'", "p = 'docs/guide' || j || '.md'", "regexp_extract(p, '[^/]*$') = 'handler' || j || '.py'", "starts_with(p, 'web/components/Card' || j) and p like '%.tsx'",
        "starts_with(p, 'db/migrations/' || j)", "p like '%helper' || j || '.js'", "starts_with(p, 'lib' || j || '/')",
    )
    return f"""select {KEY}, 6, 0, 'owners', case when o is null then {ex.UNOWNED} else {ex.OTHER_OWNER} end, case when o is null then {text(ex.UNOWNED_REASON)} else 'owned by ' || o || ', not the author' end
  from h left join (
    select p, arg_max(case when i = 5000 then '@lib' when i % 50 = 7 then '@api' else '@team' || (i % 50) end, i) as o
    from (select distinct file_path as p from h), (select i, (i // 7) % 60 as j from range(5001) t(i))
    where case when i = 5000 then starts_with(p, 'lib/') else case i % 7 {" ".join(f"when {k} then {fit}" for k, fit in enumerate(fits))} end end group by p
  ) on p = file_path where o is distinct from '@api'"""


_STOP = _list(ex.INTENT_STOPWORDS)


def _keywords(of: str) -> str:
    words = f"regexp_extract_all({of}, '[A-Za-z0-9]+')"
    parts = f"flatten(list_transform({words}, lambda w: regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+')))"
    return f"list_distinct(list_filter(list_transform({parts}, lambda w: lower(w)), lambda w: len(w) >= 3 and not list_contains({_STOP}, w)))"


def _intent() -> str:
    changed = "array_to_string(list_transform(list_filter(string_split(body, chr(10)), lambda x: (starts_with(x, '+') or starts_with(x, '-')) and not starts_with(x, '+++') and not starts_with(x, '---')), lambda x: substr(x, 2)), chr(10))"
    own = _keywords(f"regexp_replace(file_path, '\\.[A-Za-z0-9]+$', '') || chr(10) || {changed}")
    short = corpus.INTENT if len(corpus.INTENT) <= 60 else corpus.INTENT[:59].rstrip() + "…"
    return f"""select {KEY}, 7, 0, 'intent', case when shared = 0 then {ex.NO_OVERLAP} else {ex.WEAK_OVERLAP} end,
  case when shared = 0 then 'touches ' || file_path || {text(f" but the PR is about '{short}' — nothing here matches that story")} else file_path || {text(f" barely relates to the stated PR intent '{short}' — possible scope creep")} end
  from (select *, len(list_intersect(own, {_keywords(text(corpus.INTENT))})) as shared from (select *, {own} as own from h)) where len(own) > 0 and shared / len(own) < {ex.WEAK_RATIO}"""


TESTED = "tested as (select diff_id, list_distinct(flatten(list([regexp_replace(regexp_extract(file_path, '([^/.]*)\\.[^/]*$', 1), '^test_', '')]))) as stems from h where file_path like 'tests/%' group by diff_id)"


def _no_tests() -> str:
    before, after = ex.OTHER_TESTS_REASON.split("{}")
    own = "lower(regexp_replace(regexp_replace(file_path, '^.*/', ''), '\\.[^.]*$', ''))"
    code = " and ".join(f"file_path not like '%{s}'" for s in ex.NON_CODE)
    return f"""select {KEY}, 8, 0, 'no-tests', case when stems is null then {ex.NO_TESTS} else {ex.OTHER_TESTS} end,
  case when stems is null then {text(ex.NO_TESTS_REASON)} else {text(before)} || own || {text(after)} end
  from (select *, {own} as own from h) join (select {KEY}, sum(points) as base from sig group by all) using ({KEY}) left join tested using (diff_id)
  where base >= {ex.RISKY} and file_path not like 'tests/%' and {code} and (stems is null or not list_contains(stems, own) or own = '')"""


_SYM_STOP = _list(ex.SYMBOL_STOPWORDS)


def _symbols() -> str:
    def rx(p: str) -> str:
        return p.replace("=(?!=)", "=(?:[^=]|$)")

    each = lambda v, ps: "list_concat(" + ", ".join(f"regexp_extract_all({v}, {text(rx(p))}, 1)" for p in ps) + ")"
    line = f"case when starts_with(x, '+') or starts_with(x, '-') then {each('substr(x, 2)', ex.CHANGED_SYMBOLS)} else {each('substr(x, 2)', ex.CONTEXT_SYMBOLS)} end"
    every = f"list_concat({each('heading', ex.CHANGED_SYMBOLS)}, flatten(list_transform(string_split(body, chr(10)), lambda x: {line})))"
    return f"sym as (select {KEY}, file_path, unnest(list_distinct(list_filter({every}, lambda s: len(s) >= 3 and not list_contains({_SYM_STOP}, lower(s))))) as symbol from h)"


_NAMES = "list_extract(['parse_user', 'loadUser', 'tokenStore', 'users'], (doc_id % 4 + 1)::int) || ' handler_' || (doc_id % 50)"
COUNTS = f"""
tree as (select {_PATH.replace('+ f', '+ 0')} as path, {_TEXT} || ' ' || {_NAMES} || case when doc_id % 3 = 0 then ' a$scope $scope load$user b$scope$c' else '' end as text from documents where doc_id is not null),
counts as (
  select path, token, count(*) as n from (select path, unnest(regexp_extract_all(text, '[0-9A-Za-z_]+')) as token from tree) group by all
  union all
  select path, symbol, sum(n) from (select path, symbol, len(regexp_extract_all(text, '\\b' || regexp_escape(symbol) || '\\b')) as n from tree, (select distinct symbol from sym where contains(symbol, '$'))) where n > 0 group by all
),
uses as (select {KEY}, symbol, (sum(n) - coalesce(sum(n) filter (path = file_path), 0))::bigint as uses from sym join counts on token = symbol group by {KEY}, file_path, symbol)
"""


def _blast() -> str:
    of = lambda at: "case " + " ".join(f"when uses >= {b[0]} then {b[1] if at == 1 else text(b[2])}" for b in ex.BLAST) + " end"
    return f"""select {KEY}, 4, row_number() over (partition by {KEY} order by {of(1)} desc, uses desc, symbol) as so, 'blast-radius', {of(1)}, 'blast radius: ''' || symbol || ''' ' || {of(2)} || ' (' || uses || ' places in the repo)'
  from uses where uses >= {ex.BLAST[-1][0]}"""


_COST = f"({ex.SECONDS_PER_HUNK}::double + changed * {ex.SECONDS_PER_LINE}::double)"
_DURATION = "case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' || case when s % 60 = 0 then '' else lpad((s % 60)::varchar, 2, '0') || 's' end else (s // 3600) || 'h' || case when s % 3600 // 60 = 0 then '' else lpad((s % 3600 // 60)::varchar, 2, '0') || 'm' end end"
SPENT = f"m as (select *, sum({_COST}) over (partition by diff_id order by rank rows unbounded preceding) as spent from sc), r as (select *, spent <= {q.SECONDS} or rank = 1 as reviewed from m)"
_COUNT = lambda c: f"case when {c} = 1 then '' else ',' || {c} end"
_HEADER = f"'@@ -' || new_start || {_COUNT('old_lines')} || ' +' || new_start || {_COUNT('new_lines')} || ' @@' || heading"
_WHY = f"case when why = '' then {text(ex.QUIET)} else why end"
_CELL = "replace(why, '|', '\\|')"
BLOCK = f"b as (select *, '### ' || rank || '. ' || file_path || ':' || new_start || ' — ' || tier || ' (risk ' || score || ')' || chr(10) || 'why: ' || {_WHY} || chr(10) || chr(10) || '```diff' || chr(10) || {_HEADER} || chr(10) || body || chr(10) || '```' as block from sc), bt as (select *, ceil(length(block) / 4.0)::bigint as tokens from b), taken as (select *, spent <= {q.TOKENS} or rank = 1 as reviewed from (select *, sum(tokens + 2) over (partition by diff_id order by rank rows unbounded preceding)::double as spent from bt))"
_BAR = "'[' || repeat('#', round_even(score::double / 100 * 20, 0)::int) || repeat(' ', 20 - round_even(score::double / 100 * 20, 0)::int) || ']'"
_PLACE = "file_path || ':' || new_start"
_MENU_WHY = f"case when why = '' then {text('(' + ex.QUIET + ')')} else why end"
_MARKDOWN_ROW = f"'| [ ] | ' || rank || ' | ' || {_case('tier', ex.EMOJI)} || ' ' || tier || ' | ' || score || ' | `' || {_PLACE} || '` | ' || case when why = '' then '_' || {text(ex.QUIET)} || '_' else {_CELL} end || ' |'"
_PLURAL = lambda n, word: f"{n} || case when {n} = 1 then ' {word}' else ' {word}s' end"


def _join(*parts: str) -> str:
    """A document of parts with line feeds between them."""
    return " || chr(10) || ".join(f"({p})" for p in parts)


def _markdown() -> str:
    table = lambda tier: f"string_agg({_MARKDOWN_ROW}, chr(10) order by rank) filter ({tier})"
    head = [text(line) for line in ex.TABLE_HEAD.split("\n")]
    read = f"case when read is null then {text('_Nothing rises above skim level — the whole diff is low-risk._ 🎉')} else {_join(text('_In recommended reading order, most-risky-first._'), text(''), *head, 'read')} end"
    fold = f"case when skim is null then '' else {_join(text('<details>'), text('<summary>🟢 Skim-safe · ') + f' || {_PLURAL("skims", "hunk")} || ' + text(' (low risk)</summary>'), text(''), *head, 'skim', text(''), text('</details>'), text(''), text(''))} end"
    gate = f"case when top >= {q.GATE} then '> ⛔ **CI gate:** a hunk scored **' || top || '** (≥ `{q.GATE}`). Make sure it gets a real read before merging.' else '> ✅ **CI gate:** top risk **' || top || '** is under the `{q.GATE}` threshold.' end"
    legend = f"<sub>Tiers: 🔴 gulp (read first, ≥{ex.GULP}) · 🟡 sip (read, ≥{ex.SIP}) · 🟢 savor (skim-safe, <{ex.SIP}). Ranked by risk + surprise · hunkwise</sub>"
    summary = f"'**' || {_PLURAL('n', 'hunk')} || '** across **' || {_PLURAL('files', 'file')} || '** · top risk **' || top || '**'"
    lines = _join(text("<!-- hunkwise:review-menu -->"), text("## 🍷 hunkwise — review-order menu"), text(""), summary, text(""), text("### Read these first"), text(""), read, text(""), f"{fold} || {gate}", text(""), text(legend))
    return f"select diff_id, {lines} as document from (select diff_id, count(*) as n, count(distinct file_path) as files, max(score) as top, {table('tier <> ' + text('savor'))} as read, {table('tier = ' + text('savor'))} as skim, count(*) filter (tier = 'savor') as skims from sc group by diff_id)"


def _menu() -> str:
    width = "greatest(2, length(n::varchar))"
    row = f"'  ' || lpad(rank::varchar, {width}::int, ' ') || '  ' || {_case('tier', ex.LABEL)} || '  ' || lpad(score::varchar, 3, ' ') || '  ' || {_BAR} || '  ' || {_PLACE} || '  ' || {_MENU_WHY}"
    said = f"'─ cut: review ' || cut || ' above · skim ' || (n - cut) || ' below · budget {q.SECONDS // 60}m · ≈' || {_DURATION} || ' above '"
    # the cut follows the last row above it
    rows = f"string_agg(line || case when rank = cut and cut < n then chr(10) || rpad({said}, greatest(120, length({said}))::int, '─') else '' end, chr(10) order by rank)"
    legend = f"Tiers: GULP (read first, ≥{ex.GULP}) · SIP (read, ≥{ex.SIP}) · SAVR (skim-safe, <{ex.SIP}).  Listed most-risky-first."
    summary = "'🍷 hunkwise — ' || " + _PLURAL("n", "hunk") + " || ' across ' || " + _PLURAL("files", "file") + " || ' · top risk ' || top"
    whole = _join(summary, text(""), f"'  ' || lpad('#', {width}::int, ' ') || '  TIER  SCR  RISK                    WHY'", "repeat('─', 120)", "rows", text(""), text(legend))
    return f"""select diff_id, {whole} as document from (
  select diff_id, n, files, top, {rows} as rows from (
    select *, {row} as line, round_even(seconds, 0)::bigint as s from (
      select *, count(*) over w as n, count(distinct file_path) over w as files, max(score) over w as top, count(*) filter (reviewed) over w as cut, sum(case when reviewed then {_COST} else 0 end) over w as seconds from r window w as (partition by diff_id)))
  group by diff_id, n, files, top)"""


_SIGNALS = f"sl as (select {KEY}, list(struct_pack(rule := rule, points := points::int, reason := reason) order by points desc, ro, so) as signals from sig group by all)"
_SARIF_RESULT = f"""struct_pack("ruleId" := coalesce(first_rule, {text(ex.SAFE_RULE)}), "level" := {_case('tier', ex.LEVEL)}, "message" := struct_pack("text" := case when message = '' then {text(ex.SAFE_MESSAGE)} else message end),
  "locations" := [struct_pack("physicalLocation" := struct_pack("artifactLocation" := struct_pack("uri" := file_path), "region" := struct_pack("startLine" := new_start, "endLine" := new_start + greatest(1, new_lines) - 1)))],
  "properties" := struct_pack("score" := score, "tier" := tier, "hunkId" := id))"""


def _sarif() -> str:
    rule = f"""struct_pack("id" := r, "name" := r, "shortDescription" := struct_pack("text" := {_case('r', ex.RULE_TEXTS)}))"""
    run = f"""struct_pack("tool" := struct_pack("driver" := struct_pack("name" := 'hunkwise', "rules" := list_transform(rules, lambda r: {rule}), "version" := '0.1.0')), "results" := results, "properties" := struct_pack("failOver" := {q.GATE}))"""
    return f"""select diff_id, to_json(struct_pack("$schema" := {text(ex.SARIF_SCHEMA)}, "version" := {text(ex.SARIF_VERSION)}, "runs" := [{run}]))::varchar as document
  from (select diff_id, list({_SARIF_RESULT} order by rank) as results, list_sort(list_distinct(list(coalesce(first_rule, {text(ex.SAFE_RULE)})))) as rules from sc group by diff_id)"""


def _bundle() -> str:
    end = f"case when n > cut then '_Budget reached: showing the ' || cut || ' highest-risk of ' || n || ' hunks; ' || (n - cut) || ' lower-risk ' || case when n - cut = 1 then 'hunk' else 'hunks' end || ' omitted._' else '_All ' || {_PLURAL('n', 'hunk')} || ' fit within the budget._' end"
    lead = text(ex.PREAMBLE.replace("{name}", "hunkwise") + f"\n\n**Stated intent:** {corpus.INTENT}\n\n")
    return f"select diff_id, {lead} || blocks || chr(10) || chr(10) || {end} as document from (select diff_id, count(*) as n, count(*) filter (reviewed) as cut, string_agg(block, chr(10) || chr(10) order by rank) filter (reviewed) as blocks from taken group by diff_id)"


SQL: dict[str, str] = {
    "parse_files": _sql("select diff_id, file_seq, path, change_type, old_path, new_path, old_mode, new_mode, is_binary from files", BASE),
    "parse_hunks": _sql(f"select {KEY}, file_path, change_type, new_start as old_start, old_lines, new_start, new_lines, heading, added, removed, changed, md5(body) as body_md5 from h", BASE),
    "hunk_ids": _sql(f"select {KEY}, id from h", BASE),
    "diff_counts": _sql("select diff_id, files, hunks, added, removed from (select diff_id, count(*) as files from files group by diff_id) join (select diff_id, count(*) as hunks, sum(added)::bigint as added, sum(removed)::bigint as removed from h group by diff_id) using (diff_id)", BASE),
    "file_rollup": _sql("select diff_id, coalesce(file_seq, 0)::int as file_seq, sum(added)::bigint as added, sum(removed)::bigint as removed, count(*) as hunks from h group by grouping sets ((diff_id, file_seq), (diff_id))", BASE),
    "rule_size": _long(_size()),
    "rule_surface": _long(_surface()),
    "rule_surface_extra": _long(_surface(corpus.EXTRA_SURFACE)),
    "rule_danger": _long(_size() + " and false", _danger()),
    "rule_control": _long(_size() + " and false", _control(), ctes=(CONTROL,)),
    "rank_hunks": _sql(RANKED, BASE, CLI, SCORED),
    "rank_hunks_library": _sql(RANKED, BASE, CONTROL, LIBRARY, SCORED),
    "weighted_scores": _sql(RANKED, BASE, CLI, _weights(), _scored("wsig")),
    **{f"profile_{'_'.join(names)}": _sql(RANKED, BASE, CLI, _profile(names), _scored("psig")) for names in q.PROFILE_SETS},
    "budget_count": _sql(f"select {KEY}, rank, rank <= {q.HUNKS} as reviewed from sc", BASE, CLI, SCORED),
    "budget_time": _sql(f"select {KEY}, rank, {_COST} as cost, spent, reviewed from r", BASE, CLI, SCORED, SPENT),
    "budget_summary": _sql(f"select *, {_DURATION} as total_text from (select *, round_even(total_seconds, 0)::bigint as s from (select diff_id, count(*) as total, count(*) filter (reviewed) as reviewed, count(*) filter (not reviewed) as skimmed, sum(case when reviewed then {_COST} else 0 end) as spent_seconds, sum({_COST}) as total_seconds from r group by diff_id))".replace("select *, case", "select diff_id, total, reviewed, skimmed, spent_seconds, total_seconds, case"), BASE, CLI, SCORED, SPENT),
    "context_tokens": _sql(f"select {KEY}, rank, tokens, spent, reviewed from taken", BASE, CLI, SCORED, BLOCK),
    "fail_over": _sql(f"select diff_id, max(score) as worst, max(score) >= {q.GATE} as tripped from sc group by diff_id", BASE, CLI, SCORED),
    "tier_histogram": _sql("select tier, count(*) as hunks, count(distinct diff_id) as diffs from sc group by tier", BASE, CLI, SCORED),
    "menu_summary": _sql("select diff_id, count(*) as hunks, count(distinct file_path) as files, max(score) as worst from sc group by diff_id", BASE, CLI, SCORED),
    "top_n_requests": _sql(f"select diff_id, id, file_path, {_HEADER} as header, body, score from sc where rank <= 3", BASE, CLI, SCORED),
    "echo_notes": _sql(f"select {KEY}, why || case when why = '' then '' else '; ' end || 'model: [echo] ' || file_path || ': review this change (+' || added || '/-' || removed || ' lines); check edge cases and error handling.' as why from sc where rank <= 3 union all select {KEY}, why from sc where rank > 3", BASE, CLI, SCORED),
    "json_rows": _sql(f"select diff_id, rank, id, file_path as file, new_start as old_start, new_start, added, removed, score, raw, case when why = '' then 0 else n end as n_signals from sc left join (select {KEY}, count(*)::int as n from sig group by all) using ({KEY})", BASE, CLI, SCORED),
    "text_rows": _sql(f"select diff_id, rank, {_case('tier', ex.LABEL)} as label, score, {_BAR} as bar, {_PLACE} || '  ' || {_MENU_WHY} as why from sc", BASE, CLI, SCORED),
    "menu_documents": _sql(_menu(), BASE, CLI, SCORED, SPENT),
    "json_documents": _sql(f"""select diff_id, to_json(list(struct_pack(id := id, file := file_path, old_start := new_start, new_start := new_start, added := added, removed := removed, score := score, raw := raw, signals := coalesce(signals, [])) order by rank))::varchar as document
  from sc left join sl using ({KEY}) group by diff_id""", BASE, CLI, SCORED, _SIGNALS),
    "markdown_rows": _sql(f"select diff_id, rank, tier, file_path, score, {_MARKDOWN_ROW} as row from sc", BASE, CLI, SCORED),
    "markdown_documents": _sql(_markdown(), BASE, CLI, SCORED),
    "sarif_documents": _sql(_sarif(), BASE, CLI, SCORED),
    "bundle_documents": _sql(_bundle(), BASE, CLI, SCORED, BLOCK),
    "sarif_results": _sql(f"select diff_id, rank, coalesce(first_rule, {text(ex.SAFE_RULE)}) as rule_id, {_case('tier', ex.LEVEL)} as level, case when message = '' then {text(ex.SAFE_MESSAGE)} else message end as message, file_path as uri, new_start as start_line, new_start + greatest(1, new_lines) - 1 as end_line, score, tier, id as hunk_id from sc", BASE, CLI, SCORED),
    "bundle_blocks": _sql(f"select {KEY}, rank, md5(block) as block_md5, tokens from bt", BASE, CLI, SCORED, BLOCK),
    "file_churn": _sql("select path, commits, fixes, busiest from churn", CHURN),
    "hotspots": _long(_size() + " and false", _hotspots(), ctes=(CHURN,)),
    "owners": _long(_size() + " and false", _owners()),
    "owners_index": _long(_size() + " and false", _owners_index()),
    "intent": _long(_size() + " and false", _intent()),
    "no_tests": _sql(f"select {KEY}, rule, points, reason from nt", BASE, CLI, TESTED, _signals(_size().replace("from h where", "from h where false and"), _no_tests(), name="nt")),
    "symbols": _sql(f"select {KEY}, symbol from sym", BASE, _symbols()),
    "symbol_uses": _sql(f"select {KEY}, symbol, uses from uses", BASE, _symbols(), COUNTS),
    "blast_radius": _long(_size() + " and false", _blast(), ctes=(_symbols(), COUNTS)),
    "review_everything": _sql(
        f"select {KEY}, id, file_path, raw, score, tier, rank, why from sc", BASE, CONTROL, CHURN, _symbols(), COUNTS, TESTED,
        _signals(_size(), _surface(), _danger(), _control(), _blast(), _hotspots(), _owners(), _intent(), name="before"),
        "sig as (select * from before union all select * from (" + _no_tests().replace("from sig group by all", "from before group by all") + "))", _profile(["security"]), _scored("psig"),
    ),
}
