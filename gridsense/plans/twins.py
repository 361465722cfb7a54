"""SQL twins of the longer queries: fuzzy lookup, the four rounds of annotation, and what is inferred of a table."""

from __future__ import annotations

from .views import C_CELLS, INDEX_SQL, S_CELLS, edges_sql


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence, row by row of the usual table."""
    return (
        f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda row_, i_: "
        f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda acc, j: list_append(acc, greatest(acc[j[1]], row_[j[1] + 1], row_[j[1]] + CASE WHEN substr({b}, j[1], 1) = substr({a}, i_[1], 1) THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)]), "
        f"list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT)))[length({b}) + 1]"
    )


def ratio_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0 ELSE 2.0 * {lcs_sql(a, b)} / (length({a}) + length({b})) END)"


def words_sql(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def set_parts_sql(x: str, y: str, name: str) -> str:
    """Columns `name`_c, _1, _2 of two lists of distinct tokens: the common ones, and both strings that are compared."""
    common = f"list_sort(list_intersect({x}, {y}))"
    rest = lambda p, q: f"array_to_string(list_concat({common}, list_sort(list_filter({p}, lambda w: NOT list_contains({q}, w)))), ' ')"
    return f"{common} AS {name}_c, {rest(x, y)} AS {name}_1, {rest(y, x)} AS {name}_2"


def set_ratio_sql(x: str, y: str, name: str) -> str:
    c, one, two = f"{name}_c", f"{name}_1", f"{name}_2"
    base = f"length(array_to_string({c}, ' '))"
    known = f"CASE WHEN len({c}) > 0 THEN 2.0 * {base} / ({base} + least(length({one}), length({two}))) ELSE 0.0 END"
    return f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 WHEN len({c}) > 0 AND len({c}) IN (len({x}), len({y})) THEN 1.0 ELSE greatest({known}, {ratio_sql(one, two)}) END)"


#: rows (k, x, y, i) of the windows of two strings, the shorter first; `source` has k, a, b
def windows_sql(source: str) -> str:
    return f"SELECT k, x, y, unnest(range(1 - length(x), length(y))) AS i FROM (SELECT k, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM {source})"


WINDOW = "substr(y, CAST(greatest(i, 0) + 1 AS BIGINT), CAST(least(i + length(x), length(y)) - greatest(i, 0) AS BIGINT))"


def hits_sql(mentions: str) -> str:
    """CTEs up to hits(mention, entity, label, origin, bm25), from a CTE of mentions."""
    edit = lambda m: f"CASE WHEN length({m}) <= 2 THEN 0 WHEN length({m}) <= 5 THEN 1 ELSE 2 END"
    return f"""{INDEX_SQL}, {mentions},
post AS (SELECT entity, label, origin, unnest(list_filter(regexp_split_to_array(lower(label), '[^0-9a-z]+'), lambda t: t <> '')) AS token FROM index_),
tf AS MATERIALIZED (SELECT entity, label, origin, token, count(*) AS tf, sum(count(*)) OVER (PARTITION BY entity, label, origin) AS size FROM post GROUP BY entity, label, origin, token),
mean AS (SELECT avg(size) AS mean FROM (SELECT DISTINCT entity, label, origin, size FROM tf)),
df AS MATERIALIZED (SELECT token, count(*) AS df FROM tf GROUP BY token),
mt AS MATERIALIZED (SELECT DISTINCT mention, unnest(list_filter(regexp_split_to_array(mention, '[^0-9a-z]+'), lambda t: t <> '')) AS m FROM mentions),
near AS MATERIALIZED (SELECT mention, token, df, min(levenshtein(m, token)) AS d FROM mt, df WHERE abs(length(m) - length(token)) <= 2 AND levenshtein(m, token) <= {edit('m')} GROUP BY ALL),
s AS (SELECT mention, entity, label, origin, sum((1 - d / greatest(length(token), 1)) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS s
  FROM near JOIN tf USING (token), mean, (SELECT count(*) AS n FROM index_) WHERE length(label) BETWEEN floor(0.25 * length(mention)) AND ceil(4.0 * length(mention)) GROUP BY ALL),
dfl AS MATERIALIZED (SELECT lower(label) AS text, count(*) AS df FROM index_ GROUP BY 1),
near_l AS MATERIALIZED (SELECT mention, text, df, levenshtein(mention, text) AS d FROM (SELECT DISTINCT mention FROM mt), dfl WHERE abs(length(mention) - length(text)) <= 2 AND levenshtein(mention, text) <= {edit('mention')}),
w AS (SELECT mention, entity, label, origin, (1 - d / greatest(length(text), 1)) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS s FROM near_l JOIN index_ ON lower(label) = text, (SELECT count(*) AS n FROM index_)),
summed AS (SELECT mention, entity, label, origin, sum(s) AS s FROM (SELECT * FROM s UNION ALL SELECT * FROM w) GROUP BY ALL),
hits AS MATERIALIZED (SELECT mention, entity, label, origin, s * CASE origin WHEN 'MAIN_ALIAS' THEN 0.94 WHEN 'SUB_ALIAS' THEN 0.88 ELSE 1 END AS bm25 FROM summed)"""


def ranked_sql(mentions: str) -> str:
    """CTEs up to ranked(mention, entity, label, origin, ratio, partial, score, rank)."""
    m, x, xl = "mention", "label", "xl"
    both = lambda low, raw: f"(0.9 * {low} + 0.1 * {raw})"
    return f"""{hits_sql(mentions)},
lists AS (SELECT row_number() OVER () AS k, mention, entity, label, origin, pr, bm25, lower(label) AS xl, list_distinct({words_sql(m)}) AS mts, list_distinct({words_sql('lower(label)')}) AS lts, list_distinct({words_sql(x)}) AS rts,
  length(mention) / greatest(length(label), 1) > 0.5 AND length(mention) / greatest(length(label), 1) < 2 AS like_ FROM hits JOIN index_ USING (entity, label, origin)),
parts AS MATERIALIZED (SELECT *, array_to_string(list_sort({words_sql(m)}), ' ') AS ms, array_to_string(list_sort({words_sql(xl)}), ' ') AS ls, array_to_string(list_sort({words_sql(x)}), ' ') AS rs, {set_parts_sql('mts', 'lts', 'low')}, {set_parts_sql('mts', 'rts', 'raw')} FROM lists),
three AS MATERIALIZED (SELECT *, {both(ratio_sql(m, xl), ratio_sql(m, x))} AS r1, {both(ratio_sql('ms', 'ls'), ratio_sql('ms', 'rs'))} AS r2, CASE WHEN like_ THEN {both(set_ratio_sql('mts', 'lts', 'low'), set_ratio_sql('mts', 'rts', 'raw'))} ELSE 0.0 END AS r3 FROM parts),
rated AS MATERIALIZED (SELECT k, mention, entity, label, origin, pr, bm25, xl, like_ AND r3 > 0.9 AS whole, (r1 + r2 + r3 - least(r1, r2, r3)) / 2 * CASE origin WHEN 'MAIN_ALIAS' THEN 0.94 WHEN 'SUB_ALIAS' THEN 0.88 ELSE 1 END AS ratio FROM three),
low_pairs AS MATERIALIZED (SELECT k, mention AS m, xl, label FROM rated WHERE ratio < 0.75 AND NOT whole AND abs(length(regexp_replace(mention, '[^ ]', '', 'g')) - length(regexp_replace(label, '[^ ]', '', 'g'))) <= 2),
stretch AS (SELECT k, max({ratio_sql('x', 'v')}) AS p FROM (SELECT *, {WINDOW} AS v FROM ({windows_sql('(SELECT k, m AS a, xl AS b FROM low_pairs)')})) GROUP BY k),
stretch_raw AS (SELECT k, max({ratio_sql('x', 'v')}) AS p FROM (SELECT *, {WINDOW} AS v FROM ({windows_sql('(SELECT k, m AS a, label AS b FROM low_pairs)')})) GROUP BY k),
labelled AS (SELECT rated.*, (whole OR coalesce(0.9 * stretch.p + 0.1 * stretch_raw.p > 0.9, false)) AND ratio < 0.75 AS part FROM rated LEFT JOIN stretch USING (k) LEFT JOIN stretch_raw USING (k)),
ones AS (SELECT *, row_number() OVER (PARTITION BY mention, entity ORDER BY ratio DESC, bm25 DESC, label DESC, origin DESC) AS first_, bool_or(part) OVER (PARTITION BY mention, entity) AS any_part, max(bm25) OVER (PARTITION BY mention, entity) AS own_bm25, max(ratio) OVER (PARTITION BY mention) AS top, max(bm25) OVER (PARTITION BY mention) AS top_bm25 FROM labelled),
kept AS (SELECT *, ratio >= greatest(0.70, top - 0.25) AS enough, max(pr) OVER (PARTITION BY mention) AS top_pr FROM ones WHERE first_ = 1 AND (any_part OR ratio >= greatest(0.70, top - 0.25))),
totals AS (SELECT mention, entity, label, origin, ratio, NOT enough AS partial, (1 - 0.10 - 0.20) * ratio + 0.10 * log2(pr + 1) / CASE WHEN top_pr > 0 THEN log2(top_pr + 1) ELSE 1.0 END + 0.20 * own_bm25 / top_bm25 AS score FROM kept),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY round(score, 9) DESC, entity) AS rank FROM totals)"""


BM25 = f"WITH {hits_sql('{mentions}')} SELECT mention, entity, label, origin, round(bm25, 5) AS bm25 FROM hits"
LOOKUP = f"WITH {ranked_sql('{mentions}')} SELECT mention, entity, label, origin, round(ratio, 6) AS ratio, partial, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 20"

_PAIR = "table_id, head, tail"
_CELL = "table_id, row_idx, col_idx"
_CAND = "table_id, row_idx, col_idx, entity"

#: paths of pairs(head, tail): d are the direct ones, two those over a shared neighbour
_TRANSITIVE = "('P131', 'P276', 'P279', 'P361', 'P403', 'P460', 'P527', 'P706', 'P927', 'P1647', 'P2094', 'P3373', 'P3403', 'P5607', 'P5973', 'P171')"
_FLIP = "CASE WHEN {0} LIKE '(-)%' THEN substr({0}, 4) ELSE '(-)' || {0} END"
HOPS = f"""d AS MATERIALIZED (SELECT DISTINCT head, tail, pid AS path FROM pairs JOIN edges ON subject = head AND object = tail WHERE tag = 'NORMAL'),
deg AS MATERIALIZED (SELECT subject AS node, count(*) AS n FROM edges GROUP BY subject),
e AS MATERIALIZED (SELECT DISTINCT subject, pid, object FROM edges WHERE tag = 'NORMAL'),
rest AS (SELECT head, tail FROM pairs ANTI JOIN d USING (head, tail)),
hop AS (SELECT head, tail, a.object AS node, a.pid AS p1, {_FLIP.format('b.pid')} AS p2, 1 / (2 + log10(2 + n)) AS pop FROM rest JOIN e a ON a.subject = head JOIN e b ON b.subject = tail AND b.object = a.object JOIN deg ON deg.node = a.object),
two AS (SELECT head, tail, node, CASE WHEN p1 = p2 AND replace(p1, '(-)', '') IN {_TRANSITIVE} THEN p1 ELSE p1 || '::' || p2 END AS path,
  CASE WHEN p1 = p2 AND replace(p1, '(-)', '') IN {_TRANSITIVE} THEN 1.0 WHEN p1 <> p2 AND starts_with(p1, '(-)') <> starts_with(p2, '(-)') THEN pop / 1.75 ELSE pop END AS prox FROM hop)"""


def cpa_sql(name: str, cea: str, best_only: bool, unrelated: str = "") -> str:
    """CTE `name` of relations, from the cells' entities in the CTE `cea`."""
    less = f" ANTI JOIN {unrelated} u ON u.table_id = h.table_id AND u.head = h.col_idx AND u.tail = t.col_idx" if unrelated else ""
    keep = "cnt * tot >= first_value(cnt * tot) OVER by_" if best_only else "cnt >= first_value(cnt) OVER by_"
    keep = keep.replace("cnt * tot", "round(cnt * tot, 9)")
    return f"""{name}_r AS (SELECT h.table_id, h.row_idx, h.col_idx AS head, t.col_idx AS tail, path, max(prox * greatest(h.score, t.score)) AS s, min(prox) AS prox
  FROM {cea} h JOIN {cea} t ON h.table_id = t.table_id AND h.row_idx = t.row_idx AND h.col_idx < t.col_idx JOIN links l ON l.table_id = h.table_id AND l.head_key = h.entity AND l.tail_key = t.entity{less} GROUP BY ALL),
{name}_v AS (SELECT table_id, head, tail, path, count(*) AS cnt, sum(s) AS tot, min(prox) AS prox FROM {name}_r GROUP BY ALL),
{name} AS MATERIALIZED (SELECT table_id, head, tail, path, tot / n AS score, cnt / CAST(n AS DOUBLE) AS coverage, prox, row_number() OVER by_ AS rank FROM {name}_v JOIN n_rows USING (table_id)
  WINDOW by_ AS (PARTITION BY table_id, head, tail ORDER BY round(cnt * tot, 9) DESC, cnt DESC, prox DESC, contains(path, '::'), starts_with(path, '(-)'), path) QUALIFY {keep})"""


def cta_sql(name: str, cea: str, best_only: bool) -> str:
    """CTE `name` of column types."""
    by = "(PARTITION BY table_id, col_idx ORDER BY round(cnt * tot, 9) DESC, type)"
    ranked = f"""{name}_r AS (SELECT table_id, row_idx, col_idx, type, max(CASE level WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 ELSE 0.2 END * score) AS s FROM {cea} JOIN types USING (entity) GROUP BY ALL),
{name}_v AS (SELECT table_id, col_idx, type, count(*) AS cnt, sum(s) AS tot FROM {name}_r GROUP BY ALL),
{name}_k AS (SELECT *, row_number() OVER {by} AS rank, round(cnt * tot, 9) >= max(round(cnt * tot, 9)) OVER (PARTITION BY table_id, col_idx) AS first_, first_value(cnt) OVER {by} AS least_ FROM {name}_v)"""
    kept = f"SELECT * FROM {name}_k WHERE first_ UNION ALL SELECT k.* FROM {name}_k k SEMI JOIN (SELECT a.table_id, a.col_idx, supertype FROM {name}_k a JOIN up ON up.type = a.type WHERE a.first_) s ON s.table_id = k.table_id AND s.col_idx = k.col_idx AND s.supertype = k.type WHERE NOT first_" if best_only else f"SELECT * FROM {name}_k WHERE cnt >= least_"
    return f"{ranked}, {name} AS MATERIALIZED (SELECT table_id, col_idx, type, tot / n AS score, cnt / CAST(n AS DOUBLE) AS coverage, rank FROM ({kept}) JOIN n_rows USING (table_id))"


def rescore_sql(name: str, relations: str, unrelated: str = "") -> str:
    """CTE `name` of candidates with the score that confirmed contexts give, and whether their cell has any."""
    less = f" ANTI JOIN {unrelated} USING ({_PAIR})" if unrelated else ""
    return f"""{name}_w AS (SELECT * FROM weights SEMI JOIN {relations} USING ({_PAIR}){less}),
{name}_f AS (SELECT w.table_id, w.row_idx, w.col_idx, w.entity, w.ctx_col, arg_min(r.coverage * r.prox, r.rank) AS f FROM {name}_w w JOIN all_paths p ON p.table_id = w.table_id AND p.row_idx = w.row_idx AND p.col_idx = w.col_idx AND p.entity = w.entity AND p.ctx_col = w.ctx_col
  JOIN {relations} r ON r.table_id = w.table_id AND r.head = w.head AND r.tail = w.tail AND r.path = p.path GROUP BY ALL),
{name}_a AS (SELECT {_CAND}, sum(weight * scaled) AS num, sum(base) AS den, max(weight) AS most, max(scaled) AS scaled FROM (SELECT *, greatest(0.1, coalesce(f, 0) * score) AS scaled, CASE WHEN ctx_entity THEN 1.0 ELSE 0.3 END AS base FROM {name}_w LEFT JOIN {name}_f USING ({_CAND}, ctx_col)) GROUP BY {_CAND}),
{name} AS MATERIALIZED (SELECT {_CAND}, c.rank, sim, CASE WHEN cols <= 1 THEN sim WHEN most > 0.1 THEN coalesce(num / den, 0.01) / (1 + exp(-((power(sim, 2.5) / 0.5 - 1) / 0.2))) ELSE 0.1 * sim END AS score, max(coalesce(scaled, 0.1)) OVER (PARTITION BY {_CELL}) AS contextless
  FROM cand c LEFT JOIN {name}_a USING ({_CAND}) JOIN n_cols USING (table_id))"""


def cea_sql(name: str, scored: str, found: str, last: bool) -> str:
    """CTE `name` of the best candidates of each cell, helped by the column types of the CTE `found`."""
    alone = "round(contextless, 9) = 0.1" if last else "false"
    potential = f"LEFT JOIN potentials p USING ({_CAND})" if last else ""
    start = f"CASE WHEN {alone} AND potential IS NOT NULL THEN least(1.0, score * (1 + potential)) ELSE score END" if last else "score"
    count = "coalesce(n_potential, 0)" if last else "0"
    return f"""{name}_p AS (SELECT {_CAND}, f.type, f.score AS c_score FROM cand JOIN {found} f USING (table_id, col_idx)),
{name}_l AS (SELECT {_CAND}, p.type, c_score, min(level) AS level FROM {name}_p p LEFT JOIN types USING (entity, type) GROUP BY ALL),
{name}_n AS (SELECT {_CAND}, p.type, min(t.level) AS n_level FROM {name}_p p JOIN types t USING (entity) JOIN neighbours b ON b.type = p.type AND b.neighbour = t.type WHERE t.level <= 2 GROUP BY ALL),
{name}_g AS (SELECT {_CAND}, max(CASE WHEN level = 1 THEN 1.0 WHEN level = 2 OR n_level = 1 THEN 0.7 WHEN level = 3 OR n_level = 2 THEN 0.2 ELSE 0.0 END * c_score) AS g FROM {name}_l LEFT JOIN {name}_n USING ({_CAND}, type) GROUP BY {_CAND}),
{name}_c AS (SELECT table_id, col_idx, avg(coverage) AS w FROM {found} GROUP BY ALL),
{name}_t AS (SELECT {_CAND}, rank, {count} AS np, CASE WHEN w IS NOT NULL THEN ({start} + CASE WHEN {alone} THEN w ELSE w / 2 END * coalesce(g, 0)) / (1 + CASE WHEN {alone} THEN w ELSE w / 2 END) ELSE score END AS total
  FROM {scored} LEFT JOIN {name}_g USING ({_CAND}) LEFT JOIN {name}_c USING (table_id, col_idx) {potential}),
{name} AS MATERIALIZED (SELECT {_CAND}, total AS score, row_number() OVER (PARTITION BY {_CELL} ORDER BY round(total, 9) DESC, np DESC, rank) AS rank FROM {name}_t QUALIFY round(total, 9) = max(round(total, 9)) OVER (PARTITION BY {_CELL}))"""


#: the kind of each column of the supplier tables, and the mentions of its entity columns
_KINDS = r"""kinds AS MATERIALIZED (SELECT table_id, col_idx, CASE WHEN avg(CASE WHEN regexp_full_match(value, '-?[0-9]+[.][0-9]+') THEN 0 ELSE 1 END) > 0.5 AND avg(CASE WHEN length(value) > 150 THEN 1 ELSE 0 END) < 0.5
  AND avg(CASE WHEN len(list_distinct(regexp_extract_all(value, '[[:punct:]]'))) > 3 THEN 1 ELSE 0 END) < 0.5 THEN 'entity' ELSE 'without_unit' END AS kind FROM cells WHERE row_idx > 0 GROUP BY ALL),
mentions AS MATERIALIZED (SELECT DISTINCT lower(value) AS mention FROM cells JOIN kinds USING (table_id, col_idx) WHERE row_idx > 0 AND kind = 'entity' AND length(value) > 1)"""

ROUNDS = f"""WITH {ranked_sql(S_CELLS + ', ' + _KINDS)}, {edges_sql()},
answered AS (SELECT table_id, col_idx, avg(CASE WHEN r.mention IS NULL THEN 0 ELSE 1 END) AS share FROM cells LEFT JOIN (SELECT DISTINCT mention FROM ranked) r ON r.mention = lower(value) WHERE row_idx > 0 GROUP BY ALL),
sorts AS MATERIALIZED (SELECT table_id, col_idx, CASE WHEN kind = 'entity' AND share < 0.3 THEN 'text' ELSE kind END AS kind FROM kinds JOIN answered USING (table_id, col_idx)),
n_rows AS MATERIALIZED (SELECT table_id, count(DISTINCT row_idx) AS n FROM cells WHERE row_idx > 0 GROUP BY table_id), n_cols AS (SELECT table_id, count(*) AS cols FROM sorts GROUP BY table_id),
cand AS MATERIALIZED (SELECT table_id, row_idx, col_idx, entity, rank, score AS sim, length(mention) AS len FROM cells JOIN sorts USING (table_id, col_idx) JOIN ranked ON mention = lower(value) WHERE row_idx > 0 AND kind = 'entity' AND rank <= 20),
pc AS MATERIALIZED (SELECT a.table_id, a.row_idx, a.col_idx AS h, b.col_idx AS t, a.entity AS head, b.entity AS tail, a.sim AS h_sim, b.sim AS t_sim, a.len AS h_len, b.len AS t_len FROM cand a JOIN cand b ON a.table_id = b.table_id AND a.row_idx = b.row_idx AND a.col_idx < b.col_idx AND a.entity <> b.entity),
pairs AS MATERIALIZED (SELECT DISTINCT head, tail FROM pc), {HOPS},
paths AS MATERIALIZED (SELECT head, tail, path, min(prox) AS prox, max(max(prox)) OVER (PARTITION BY head, tail) AS best FROM (SELECT head, tail, path, prox FROM two UNION ALL SELECT head, tail, path, 1.0 FROM d) GROUP BY head, tail, path),
scored_pairs AS MATERIALIZED (SELECT pc.*, CASE WHEN best > 0 AND t_sim >= CASE WHEN t_len > 5 THEN 0.7 ELSE 0.9 END THEN greatest(0.1, best * t_sim) ELSE 0.1 END AS h_score,
  CASE WHEN best > 0 AND h_sim >= CASE WHEN h_len > 5 THEN 0.7 ELSE 0.9 END THEN greatest(0.1, best * h_sim) ELSE 0.1 END AS t_score FROM pc LEFT JOIN (SELECT DISTINCT head, tail, best FROM paths) USING (head, tail)),
both_ AS (SELECT table_id, row_idx, h AS col_idx, head AS entity, t AS ctx_col, h_score AS score FROM scored_pairs UNION ALL SELECT table_id, row_idx, t, tail, h, t_score FROM scored_pairs
  UNION ALL SELECT table_id, row_idx, c.col_idx, entity, s.col_idx, 0.1 FROM cand c JOIN sorts s USING (table_id) WHERE (s.kind = 'entity' AND s.col_idx <> c.col_idx) OR (s.kind <> 'entity' AND s.col_idx >= c.col_idx)),
scores AS MATERIALIZED (SELECT {_CAND}, ctx_col, max(score) AS score FROM both_ GROUP BY ALL),
live AS MATERIALIZED (SELECT p.*, path, prox FROM scored_pairs p JOIN paths USING (head, tail) WHERE greatest(h_score, t_score) > 0.1),
all_paths AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT table_id, row_idx, h AS col_idx, head AS entity, t AS ctx_col, path FROM live UNION ALL SELECT table_id, row_idx, t, tail, h, path FROM live)),
links AS MATERIALIZED (SELECT DISTINCT table_id, head AS head_key, tail AS tail_key, path, prox FROM live),
firsts AS MATERIALIZED (SELECT {_CAND}, 0.1 * sim AS score FROM cand), {cpa_sql('one', 'firsts', False)},
up AS MATERIALIZED (SELECT DISTINCT subject AS type, object AS supertype FROM edges WHERE pid = 'P279'),
l1 AS (SELECT DISTINCT subject AS entity, object AS type FROM edges WHERE pid = 'P31' AND subject IN (SELECT entity FROM ranked)), l2 AS (SELECT DISTINCT entity, supertype AS type FROM l1 JOIN up USING (type)), l3 AS (SELECT DISTINCT entity, supertype AS type FROM l2 JOIN up USING (type)),
types AS MATERIALIZED (SELECT entity, type, 1 AS level FROM l1 UNION ALL SELECT entity, type, 2 FROM l2 UNION ALL SELECT entity, type, 3 FROM l3),
neighbours AS MATERIALIZED (SELECT DISTINCT subject AS type, object AS neighbour FROM edges WHERE tag = 'NORMAL' AND pid <> '(-)P31' AND subject IN (SELECT type FROM types)),
zero AS (SELECT table_id, min(col_idx) AS c0 FROM sorts WHERE kind = 'entity' GROUP BY table_id),
turned AS (SELECT s.*, coalesce(k.kind = 'entity', false) AS ctx_entity, c0, coalesce(k.kind = 'entity', false) AND ctx_col < s.col_idx AS turn FROM scores s LEFT JOIN sorts k ON k.table_id = s.table_id AND k.col_idx = s.ctx_col JOIN zero ON zero.table_id = s.table_id),
weights AS MATERIALIZED (SELECT t.table_id, t.row_idx, t.col_idx, t.entity, t.ctx_col, t.score, ctx_entity, t.head, t.tail, CASE WHEN ctx_entity THEN greatest(0.05, coalesce(coverage * prox, 0) / (1 + 4 * least(abs(ctx_col - c0), abs(col_idx - c0)))) ELSE greatest(0.01, 0.3 * coalesce(coverage * prox, 0) / (1 + 4 * least(abs(ctx_col - c0), abs(col_idx - c0)))) END AS weight
  FROM (SELECT *, CASE WHEN turn THEN ctx_col ELSE col_idx END AS head, CASE WHEN turn THEN col_idx ELSE ctx_col END AS tail FROM turned) t LEFT JOIN (SELECT {_PAIR}, coverage, prox FROM one WHERE rank = 1) USING ({_PAIR})),
{rescore_sql('scored', 'one')}, {cta_sql('types_1', 'scored', False)}, {cea_sql('best', 'scored', 'types_1', False)}, {cta_sql('types_2', 'best', True)}, {cpa_sql('two_', 'best', False)},
apart AS MATERIALIZED (SELECT a.table_id, a.col_idx AS head, b.col_idx AS tail FROM sorts a JOIN sorts b USING (table_id) ANTI JOIN (SELECT r.table_id, r.head, r.tail FROM two_ r JOIN sorts s ON s.table_id = r.table_id AND s.col_idx = r.tail AND s.kind <> 'entity' WHERE rank = 1 AND coverage > 0 QUALIFY row_number() OVER (PARTITION BY r.table_id, r.tail ORDER BY coverage DESC, r.head) = 1) c ON c.table_id = a.table_id AND c.head = a.col_idx AND c.tail = b.col_idx WHERE a.kind = 'entity' AND b.kind <> 'entity'),
{rescore_sql('again', 'two_', 'apart')},
need AS (SELECT table_id, head AS col_idx, path AS pid, coverage FROM two_ WHERE NOT contains(path, '::') UNION ALL SELECT table_id, tail, {_FLIP.format('path')}, coverage FROM two_ WHERE NOT contains(path, '::')),
potentials AS MATERIALIZED (SELECT {_CAND}, count(*) AS n_potential, max(coverage) AS potential FROM cand JOIN need USING (table_id, col_idx) JOIN (SELECT DISTINCT subject AS entity, pid FROM edges) USING (entity, pid) GROUP BY ALL),
{cea_sql('last_', 'again', 'types_2', True)}"""

FIRST = f"{ROUNDS} SELECT {_CAND}, round(0.1 * sim, 6) AS score, CAST(row_number() OVER (PARTITION BY {_CELL} ORDER BY round(0.1 * sim, 9) DESC, rank) AS INT) AS rank FROM cand"
CEA = f"{ROUNDS} SELECT {_CAND}, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM last_"
CTA = f"{ROUNDS}, {cta_sql('final_', 'last_', True)} SELECT table_id, col_idx, type, round(score, 6) AS score, coverage, CAST(rank AS INT) AS rank FROM final_"
CPA = f"{ROUNDS}, {cpa_sql('final_', 'last_', True, 'apart')} SELECT table_id, head, tail, path, round(score, 6) AS score, coverage, prox, CAST(rank AS INT) AS rank FROM final_"

# --- what is inferred of a table


def _mixed_sql(line: str, name: str) -> str:
    """CTE `name` (table_id, m, s): mean and deviation of how mixed the data types of lines are."""
    return f"""{name} AS (SELECT table_id, CASE WHEN count(*) > 1 THEN avg(h) END AS m, CASE WHEN count(*) > 1 THEN stddev_samp(h) END AS s FROM (SELECT table_id, power(avg(1 - power(1 - 2 * p, 2)), 2) AS h
  FROM (SELECT table_id, {line}, dtype, count(*) / CAST(sum(count(*)) OVER (PARTITION BY table_id, {line}) AS DOUBLE) AS p FROM t WHERE row_idx > 0 AND col_idx > 0 GROUP BY table_id, {line}, dtype) GROUP BY table_id, {line}) GROUP BY table_id)"""


def _spread_sql(line: str, name: str) -> str:
    return f"{name} AS (SELECT table_id, avg(coalesce(s, 0)) AS x FROM (SELECT table_id, stddev_pop(length(value)) FILTER (value <> '') AS s, count(*) AS n, count(*) FILTER (value <> '') AS f FROM t GROUP BY table_id, {line}) WHERE 2 * f >= n GROUP BY table_id)"


def _typed_sql(source: str) -> str:
    return rf"""SELECT *, CASE WHEN regexp_full_match(value, '-?[0-9]+[.][0-9]+') THEN 'CARDINAL' ELSE 'UNKNOWN' END AS label,
  CASE WHEN regexp_full_match(value, '-?[0-9]+[.][0-9]+') THEN 'CARDINAL' WHEN 2 * length(regexp_replace(value, '[^0-9]', '', 'g')) >= length(value) THEN 'String_Number' WHEN upper(value) = value THEN 'String_Uppercase' ELSE 'String_Normal' END AS dtype FROM {source}"""


def _sure_sql(line: str, other: str) -> str:
    return f"SELECT DISTINCT table_id FROM (SELECT table_id, {line}, label, count(*) / CAST(sum(count(*)) OVER (PARTITION BY table_id, {line}) AS DOUBLE) AS p FROM t WHERE {other} > 0 GROUP BY table_id, {line}, label) WHERE label <> 'UNKNOWN' AND p > 0.8"


#: customers as they are, turned, without their header row, and of two rows
_MIXED = f"""WITH {C_CELLS}, mixed AS (SELECT * FROM cells UNION ALL SELECT 'T' || table_id, col_idx, row_idx, value FROM cells UNION ALL SELECT 'B' || table_id, row_idx - 1, col_idx, value FROM cells WHERE row_idx > 0 UNION ALL SELECT 'W' || table_id, row_idx, col_idx, value FROM cells WHERE row_idx < 2),
dims AS MATERIALIZED (SELECT table_id, max(row_idx) + 1 AS n_rows, max(col_idx) + 1 AS n_cols FROM mixed GROUP BY table_id HAVING max(row_idx) > 0), t AS MATERIALIZED ({_typed_sql('mixed SEMI JOIN dims USING (table_id)')}),
{_mixed_sql('row_idx', 'rows_')}, {_mixed_sql('col_idx', 'cols_')}, {_spread_sql('row_idx', 'row_len')}, {_spread_sql('col_idx', 'col_len')},
edge AS (SELECT table_id, avg(CASE WHEN label <> 'UNKNOWN' THEN 1.0 ELSE 0.0 END) FILTER (row_idx = 0) AS top, avg(CASE WHEN label <> 'UNKNOWN' THEN 1.0 ELSE 0.0 END) FILTER (col_idx = 0) AS lft FROM t WHERE (row_idx = 0) <> (col_idx = 0) GROUP BY table_id),
across AS ({_sure_sql('col_idx', 'row_idx')}), down AS ({_sure_sql('row_idx', 'col_idx')}),
facts AS (SELECT dims.*, r.m AS h, c.m AS v, 0.5 * r.s / sqrt(n_rows) AS hm, 0.5 * c.s / sqrt(n_cols) AS vm, coalesce(top, 0) AS top, coalesce(lft, 0) AS lft, table_id IN (SELECT * FROM across) AS hor, table_id IN (SELECT * FROM down) AS ver, coalesce(rl.x, 0) >= coalesce(cl.x, 0) AS wide, n_rows / CAST(n_cols AS DOUBLE) AS aspect
  FROM dims LEFT JOIN rows_ r USING (table_id) LEFT JOIN cols_ c USING (table_id) LEFT JOIN edge USING (table_id) LEFT JOIN row_len rl USING (table_id) LEFT JOIN col_len cl USING (table_id)),
picks AS (SELECT *, CASE WHEN n_rows <= 2 OR n_cols <= 2 THEN 0 WHEN h + hm + 0.01 < v - vm THEN 1 WHEN h - hm >= v + vm + 0.01 THEN 2 WHEN top > 0.5 AND lft < 0.05 THEN 3 WHEN lft > 0.5 AND top < 0.05 THEN 4 WHEN hor AND NOT ver THEN 5 WHEN ver AND NOT hor THEN 6
  WHEN (aspect <= 0.25 OR aspect >= 4) AND n_rows >= n_cols THEN 7 WHEN aspect <= 0.25 OR aspect >= 4 THEN 8 WHEN wide THEN 9 ELSE 10 END AS pick FROM facts),
sides AS MATERIALIZED (SELECT table_id, n_rows, n_cols, CASE WHEN pick IN (1, 3, 6, 8, 10) THEN 'VERTICAL' ELSE 'HORIZONTAL' END AS orientation, CASE pick WHEN 1 THEN ((v - vm) - (h + hm)) / ((v - vm) + CASE WHEN h < 0.1 THEN 0.1 ELSE 0 END) WHEN 2 THEN ((h - hm) - (v + vm)) / ((h - hm) + CASE WHEN v < 0.1 THEN 0.1 ELSE 0 END)
  WHEN 3 THEN 0.2 WHEN 4 THEN 0.2 WHEN 5 THEN 0.15 WHEN 6 THEN 0.15 ELSE 0.1 END AS score FROM picks),
turned AS MATERIALIZED (SELECT table_id, CASE WHEN orientation = 'VERTICAL' THEN col_idx ELSE row_idx END AS row_idx, CASE WHEN orientation = 'VERTICAL' THEN row_idx ELSE col_idx END AS col_idx, value, label, dtype, score AS o, CASE WHEN orientation = 'VERTICAL' THEN n_rows ELSE n_cols END AS n_cols FROM t JOIN sides USING (table_id)),
votes AS (SELECT table_id, col_idx, label, count(*) / CAST(sum(count(*)) OVER (PARTITION BY table_id, col_idx) AS DOUBLE) AS score, row_number() OVER (PARTITION BY table_id, col_idx ORDER BY count(*) DESC) AS rank FROM turned WHERE row_idx > 0 GROUP BY table_id, col_idx, label)"""

ORIENTATION = f"{_MIXED} SELECT table_id, orientation, round(score, 2) AS score FROM sides"
HEADER = f"""{_MIXED}, met AS (SELECT h.table_id, h.col_idx, o, v.score, v.rank, v.label = h.label AS inside, h.label <> 'UNKNOWN' AS trusted FROM turned h JOIN votes v USING (table_id, col_idx) WHERE h.row_idx = 0)
SELECT table_id, max(score) FILTER (trusted AND inside AND rank = 1 AND score > 0.2) IS NULL AS has_header, round(coalesce(max(score) FILTER (trusted AND inside AND rank = 1 AND score > 0.2), coalesce(sum(score) FILTER (NOT inside), 0) / count(DISTINCT col_idx)) * any_value(o), 2) AS score FROM met GROUP BY table_id"""
KEY = f"""{_MIXED}, text_ AS (SELECT table_id, col_idx, avg(CASE WHEN dtype LIKE 'String%' THEN 1.0 ELSE 0.0 END) AS text_, row_number() OVER (PARTITION BY table_id ORDER BY col_idx) AS k FROM turned WHERE row_idx > 0 GROUP BY table_id, col_idx),
counts AS (SELECT table_id, col_idx, any_value(o) AS o, any_value(n_cols) AS n_cols, count(*) AS n, count(DISTINCT value) FILTER (dtype LIKE 'String%' AND length(regexp_replace(value, '[^0-9A-Za-z ]', '', 'g')) BETWEEN 4 AND 199) AS u FROM turned GROUP BY table_id, col_idx),
some_ AS (SELECT *, min(CASE WHEN text_ > 0.5 THEN col_idx END) OVER (PARTITION BY table_id) AS first_ FROM text_ JOIN counts USING (table_id, col_idx) WHERE k <= CASE WHEN n_cols > 8 THEN 4 ELSE 3 END),
rated AS (SELECT *, CASE WHEN text_ > 0.5 AND u > 0 THEN u / CAST(n AS DOUBLE) / sqrt(1 + 2 * (col_idx - first_)) ELSE 0 END AS s FROM some_),
best AS (SELECT *, lead(s) OVER by_ AS next FROM rated WINDOW by_ AS (PARTITION BY table_id ORDER BY s DESC, col_idx) QUALIFY row_number() OVER by_ = 1)
SELECT table_id, CAST(CASE WHEN s >= 0.25 THEN col_idx END AS INT) AS key_col, round(CASE WHEN s >= 0.25 THEN CASE WHEN next IS NULL THEN 1.0 ELSE (s - next) / (s + next) END * o ELSE 0.0 END, 2) AS score FROM best"""
