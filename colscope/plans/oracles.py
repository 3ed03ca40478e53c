"""The registered queries once more, as SQL for another engine.

Each statement starts from the given tables and is independent of the operators: brute force over pairs, recursive
queries for the greedy walks.
"""

from __future__ import annotations

from colscope.functions import names as N
from colscope.functions import text as X
from colscope.plans.tenants import TENANT_VIEWS, _columns

# Columns of the given tables, in order.
GIVEN = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}

_LABEL = (
    "CASE WHEN t LIKE '%[]' THEN 'array' WHEN t IN ('TINYINT','SMALLINT','INTEGER','BIGINT') THEN 'integer' "
    "WHEN t IN ('FLOAT','DOUBLE') THEN 'float' WHEN t = 'BOOLEAN' THEN 'boolean' "
    "WHEN t LIKE 'TIMESTAMP%' THEN 'datetime' WHEN t = 'VARCHAR' THEN 'string' ELSE lower(t) END"
)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _profile(source: str, file_name: str, columns: list[str]) -> list[str]:
    return [
        f"SELECT {_quoted(file_name)} AS file_name, {_quoted(c)} AS column_name, any_value(typeof({c})) AS t, "
        f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, count(*) AS total_rows "
        f"FROM {source}"
        for c in columns
    ]


def _sampled(table: str, rows: int) -> str:
    """The sampled rows of a table, as a subquery with their place ``ri``."""
    return f"(SELECT * FROM (SELECT *, row_number() OVER () - 1 AS ri FROM {table}) ORDER BY md5('42:' || ri), ri LIMIT {rows})"


def _given_profiles() -> list[str]:
    return [s for t, cols in GIVEN.items() for s in _profile(t, f"{t}.parquet", cols.split())]


def _tenant_profiles() -> list[str]:
    parts = []
    for name, (table, columns) in TENANT_VIEWS.items():
        wanted = [item.rsplit(" AS ", 1)[1] for item in _columns(columns)]
        parts += _profile(f"(SELECT {columns} FROM {table})", name, wanted)
    return parts


def _catalog(parts: list[str]) -> str:
    return (
        "raw AS (" + " UNION ALL ".join(parts) + f"), cat AS (SELECT file_name, column_name, {_LABEL} AS data_type, "
        "null_count, unique_count, total_rows FROM raw)"
    )


_ALL = _given_profiles() + _tenant_profiles()
CAT = "WITH RECURSIVE " + _catalog(_ALL)
_COUNTS = "file_name, column_name, data_type, null_count, unique_count, total_rows"


def _enriched(name: str) -> str:
    spaced = f"replace({name}, '_', ' ')"
    parts = [spaced]
    for words, phrase in N.ENRICHMENTS:
        found = " OR ".join(f"contains(lower({spaced}), {_quoted(w)})" for w in words)
        parts.append(f"CASE WHEN {found} THEN {_quoted(phrase)} ELSE '' END")
    return " || ".join(parts)


def _normal(text: str) -> str:
    split = f"regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(lower(replace({split}, '_', ' ')), '[ \\t\\r\\n]+', ' ', 'g'))"


def _grams(alias: str, source: str, key: str, text: str) -> str:
    """CTEs ending in ``alias`` (key, g, w): unit-length trigram weights of ``text`` per ``key``."""
    return (
        f"{alias}_w AS (SELECT {key} AS k, unnest(string_split({text}, ' ')) AS w FROM {source}), "
        f"{alias}_i AS (SELECT k, '  ' || w || ' ' AS p, unnest(range(1, length(w) + 2)) AS i "
        f"FROM {alias}_w WHERE w <> ''), "
        f"{alias}_n AS (SELECT k, substr(p, i, 3) AS g, count(*) AS n FROM {alias}_i GROUP BY ALL), "
        f"{alias} AS (SELECT k, g, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS w FROM {alias}_n)"
    )


def _terms(concepts: dict[str, list[str]]) -> str:
    rows = ", ".join(
        f"({_quoted(c)}, {i}, {_quoted(term)})" for i, (c, terms) in enumerate(concepts.items()) for term in terms
    )
    return f"terms(concept, concept_order, term) AS (VALUES {rows})"


def _name_pairs(threshold: float, enrich: bool, source: str = "cat", name: str = "column_name") -> str:
    """CTEs ending in ``np`` (name1, name2, similarity)."""
    target = _normal(_enriched("n")) if enrich else _normal("n")
    return (
        f"nm AS (SELECT DISTINCT {name} AS n FROM {source}), "
        + _grams("q", "nm", "n", _normal("n"))
        + ", "
        + _grams("tg", "nm", "n", target)
        + ", np AS (SELECT q.k AS name1, tg.k AS name2, round(sum(q.w * tg.w), 6) AS similarity "
        f"FROM q JOIN tg USING (g) GROUP BY ALL HAVING round(sum(q.w * tg.w), 6) >= {threshold})"
    )


def _concepts(source: str, name: str, threshold: float) -> str:
    """CTEs ending in ``cn`` (name, concept, similarity)."""
    return (
        f"nm AS (SELECT DISTINCT {name} AS n FROM {source}), "
        + _terms(N.CONCEPT_TERMS)
        + ", "
        + _grams("tg", "nm", "n", _normal(_enriched("n")))
        + ", "
        + _grams("q", "(SELECT DISTINCT term FROM terms)", "term", _normal("term"))
        + ", sims AS (SELECT tg.k AS name, q.k AS term, round(sum(q.w * tg.w), 6) AS similarity "
        f"FROM q JOIN tg USING (g) GROUP BY ALL HAVING sum(q.w * tg.w) >= {threshold - 1e-6}), "
        "cn AS (SELECT name, concept, max(similarity) AS similarity FROM sims JOIN terms USING (term) "
        f"WHERE similarity >= {threshold} GROUP BY ALL)"
    )


def _classes(source: str, name: str, threshold: float, prefix: str = "") -> str:
    """CTEs ending in ``cl`` (name, concept)."""
    p = f"c{prefix}"
    return (
        f"{p}nm AS MATERIALIZED (SELECT DISTINCT {name} AS n FROM {source}), "
        + _terms(N.CONCEPT_TEMPLATES)
        + ", "
        + _grams(f"{p}t", f"{p}nm", "n", _normal(_enriched("n")))
        + ", "
        + _grams(f"{p}q", "(SELECT DISTINCT term FROM terms)", "term", _normal("term"))
        + f", {p}s AS MATERIALIZED (SELECT {p}t.k AS name, {p}q.k AS term, round(sum({p}q.w * {p}t.w), 6) AS similarity "
        f"FROM {p}q JOIN {p}t USING (g) GROUP BY ALL HAVING sum({p}q.w * {p}t.w) >= {max(threshold, 0.1) - 1e-6}), "
        f"{p}b AS (SELECT name, concept, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, concept_order) "
        f"AS r FROM {p}s JOIN terms USING (term) WHERE similarity >= {max(threshold, 0.1)}), "
        f"cl AS (SELECT n AS name, coalesce(concept, 'other') AS concept FROM {p}nm "
        f"LEFT JOIN (SELECT * FROM {p}b WHERE r = 1) b ON n = name)"
    )


_FILES = "files AS (SELECT DISTINCT file_name AS f FROM cat)"
_FILE_PAIRS = (
    _FILES + ", fp AS (SELECT a.f AS file1, b.f AS file2 FROM files a JOIN files b ON a.f < b.f)"
)
_SIDES = (
    _FILE_PAIRS
    + ", sides AS (SELECT file1, file2, column_name, "
    "max(CASE WHEN file_name = file1 THEN data_type END) AS t1, max(CASE WHEN file_name = file2 THEN data_type END) AS t2 "
    "FROM fp JOIN cat ON file_name IN (file1, file2) GROUP BY ALL)"
)
_SIMILAR = "WHERE i / (s1.n + s2.n - i) >= 0.1)"
_JACCARD = (
    "sz AS (SELECT file_name, count(*) AS n FROM cat GROUP BY ALL), "
    "jc AS (SELECT a.file_name AS file1, b.file_name AS file2, count(*) AS i FROM cat a JOIN cat b "
    "USING (column_name) WHERE a.file_name < b.file_name GROUP BY ALL), "
    "jp AS (SELECT file1, file2, i, s1.n + s2.n - i AS u FROM jc JOIN sz s1 ON s1.file_name = file1 "
    "JOIN sz s2 ON s2.file_name = file2 " + _SIMILAR
)


def _walk(items: str, edges: str, later_only: bool) -> str:
    """CTEs ending in ``led`` (i, j, similarity): edges of the items that lead a greedy walk in order of ``i``.

    ``items`` (i, ...), ``edges`` (i, j, similarity).
    """
    wanted = "WHERE j > i" if later_only else ""
    return (
        f"eg AS (SELECT i, list(j ORDER BY j) AS js FROM {edges} {wanted} GROUP BY i), "
        "walk(i, done) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL "
        "SELECT w.i + 1, CASE WHEN list_contains(w.done, w.i + 1) OR eg.js IS NULL THEN w.done "
        "ELSE list_concat(w.done, list_append(eg.js, w.i + 1)) END "
        f"FROM walk w LEFT JOIN eg ON eg.i = w.i + 1 WHERE w.i < (SELECT max(i) FROM {items})), "
        "leads AS (SELECT i + 1 AS i FROM walk WHERE NOT list_contains(done, i + 1)), "
        f"led AS (SELECT i, j, similarity FROM {edges} SEMI JOIN leads USING (i) {wanted})"
    )


_ITEMS = (
    "items AS (SELECT row_number() OVER (ORDER BY file_name, column_name) AS i, file_name, column_name FROM cat)"
)
_ITEM_EDGES = (
    "ie AS (SELECT a.i, b.i AS j, similarity FROM np JOIN items a ON a.column_name = name1 "
    "JOIN items b ON b.column_name = name2 WHERE a.i <> b.i)"
)


def _name_group_columns(name: str) -> str:
    lower = f"({name} = lower({name}) AND regexp_matches({name}, '\\p{{Ll}}') AND NOT contains({name}, '_'))"
    return (
        f"bool_or(contains({name}, '_')) AS su, bool_or(regexp_matches({name}, '\\p{{Lu}}')) AS sc, "
        f"bool_or({lower}) AS sl, bool_and(contains(lower({name}), 'id')) AS ai, "
        f"bool_or(contains(lower({name}), 'customer')) AS ac, bool_or(contains(lower({name}), 'user')) AS au, "
        f"bool_or(contains(lower({name}), 'order')) AS ao, count(*) AS members, count(DISTINCT {name}) AS distinct_names"
    )


_STYLE_LIST = (
    "concat_ws(', ', CASE WHEN su THEN 'underscore' END, CASE WHEN sc THEN 'camelcase' END, "
    "CASE WHEN sl THEN 'lowercase' END)"
)
_INCONSISTENT = "(members > 1 AND (su::INT + sc::INT + sl::INT > 1 OR distinct_names = members))"
_SUGGESTION = (
    "CASE WHEN ai AND ac THEN 'customer_id' WHEN ai AND au THEN 'user_id' WHEN ai AND ao THEN 'order_id' "
    "ELSE shortest END"
)
_REASON = (
    "CASE WHEN replace(la, '_', '') = replace(lb, '_', '') THEN 'underscore_variation' "
    "WHEN starts_with(la, left(lb, 4)) OR starts_with(lb, left(la, 4)) THEN 'similar_prefix' "
    "WHEN ends_with(la, right(lb, 4)) OR ends_with(lb, right(la, 4)) THEN 'similar_suffix' END"
)
_WORDS = (
    "vocab AS MATERIALIZED (SELECT DISTINCT doc_id, lang, w FROM (SELECT doc_id, lang, "
    "unnest(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+')) AS w FROM documents) WHERE w <> '')"
)
_BLANK_SQL = "||".join(f"chr({ord(c)})" for c in X.BLANK)


def _content(line: str) -> str:
    trimmed = f"trim({line}, bl)"
    return f"({trimmed} <> '' AND NOT regexp_matches({trimmed}, '{X.SEPARATOR_LINE}'))"


_LINES = (
    f"WITH b AS (SELECT {_BLANK_SQL} AS bl), l AS (SELECT doc_id, bl, string_split(text, chr(10)) AS ls "
    "FROM documents, b), "
    f"c AS (SELECT doc_id, len(list_filter(ls, lambda x: {_content('x')})) AS n, "
    f"list_filter(ls[1:10], lambda x: {_content('x')})[1:5] AS shown FROM l) "
)


def _semantic_search(term: str, threshold: float) -> str:
    return (
        CAT
        + ", nm AS (SELECT DISTINCT column_name AS n FROM cat), "
        + _grams("tg", "nm", "n", _normal(_enriched("n")))
        + ", "
        + _grams("q", f"(SELECT {_quoted(term)} AS term)", "term", _normal("term"))
        + ", m AS (SELECT tg.k AS column_name, round(sum(q.w * tg.w), 6) AS similarity FROM q JOIN tg USING (g) "
        f"GROUP BY ALL HAVING round(sum(q.w * tg.w), 6) >= {threshold}) "
    )


def _search_rows(term: str) -> str:
    return _semantic_search(term, 0.6) + (
        "SELECT file_name, column_name, data_type, null_count, unique_count, "
        "round(similarity, 3) AS semantic_similarity, 'semantic' AS match_type, "
        "CASE WHEN round(similarity, 3) > 0.8 THEN 'HIGH' ELSE 'MED' END AS confidence FROM m JOIN cat USING (column_name)"
    )


_VECTOR = "embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n"
_COSINE = "round(list_dot_product(a.v, b.v) / (a.n * b.n), 6)"


def _given_vectors(alias: str, texts: str) -> str:
    """CTE ``alias`` (t, v, n): a given vector for every text ``t`` of a query."""
    return (
        f"{alias} AS (SELECT t, {_VECTOR} FROM ({texts}) x JOIN embeddings ON vec_id = "
        "('0x' || substr(md5(t), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings))"
    )


def _dense_pairs(threshold: float) -> str:
    """CTEs ending in ``np`` (name1, name2, similarity), by given vectors."""
    return _given_vectors("dv", "SELECT DISTINCT column_name AS t FROM cat") + (
        f", np AS (SELECT a.t AS name1, b.t AS name2, {_COSINE} AS similarity FROM dv a, dv b WHERE {_COSINE} >= {threshold})"
    )


def _dense_terms(concepts: dict[str, list[str]], threshold: float) -> str:
    """CTEs ending in ``ts`` (name, concept, concept_order, similarity), by given vectors."""
    return (
        _terms(concepts)
        + ", "
        + _given_vectors("da", "SELECT DISTINCT column_name AS t FROM cat")
        + ", "
        + _given_vectors("db", "SELECT DISTINCT term AS t FROM terms")
        + f", ts AS (SELECT a.t AS name, concept, concept_order, {_COSINE} AS similarity FROM da a, db b JOIN terms ON term = b.t "
        f"WHERE {_COSINE} >= {threshold})"
    )


def _dense_classes(threshold: float) -> str:
    """CTEs ending in ``cl`` (name, concept), by given vectors."""
    return _dense_terms(N.CONCEPT_TEMPLATES, threshold) + (
        ", tb AS (SELECT name, concept, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, concept_order) AS r FROM ts), "
        "cl AS (SELECT t AS name, coalesce(concept, 'other') AS concept FROM da LEFT JOIN (SELECT * FROM tb WHERE r = 1) ON name = t)"
    )


def _schema_scores(threshold: float, enrich: bool = False, pairs: str | None = None) -> str:
    """CTEs ending in ``sc`` (file1, file2, similarity) and ``bm`` (their best matches)."""
    return (
        (pairs or _name_pairs(threshold, enrich))
        + ", "
        + _FILE_PAIRS
        + ", cand AS (SELECT file1, file2, name1, name2, similarity, row_number() OVER (PARTITION BY file1, file2, name1 "
        "ORDER BY similarity DESC, name2) AS r FROM fp JOIN cat c1 ON c1.file_name = file1 JOIN np ON name1 = c1.column_name "
        "JOIN cat c2 ON c2.file_name = file2 AND c2.column_name = name2), "
        "bm AS (SELECT * FROM cand WHERE r = 1), "
        "sz AS (SELECT file_name, count(*) AS n FROM cat GROUP BY ALL), "
        "sc AS (SELECT file1, file2, round(sum(similarity) / n, 6) AS similarity FROM bm JOIN sz ON file_name = file1 "
        f"GROUP BY file1, file2, n HAVING round(sum(similarity) / n, 6) > {threshold}) "
    )


def _naming_members(threshold: float, enrich: bool, pairs: str | None = None) -> str:
    """CTEs ending in ``gm`` (lead, member, similarity): groups of like names, leaders included."""
    return (
        CAT
        + ", "
        + (pairs or _name_pairs(threshold, enrich))
        + ", "
        + _ITEMS
        + ", "
        + _ITEM_EDGES
        + ", "
        + _walk("items", "ie", later_only=True)
        + ", gm AS (SELECT i AS lead, j AS member, similarity FROM led "
        "UNION ALL SELECT DISTINCT i, i, NULL FROM led) "
    )


def _semantic_differences(threshold: float, enrich: bool) -> str:
    return (
        CAT
        + ", "
        + _name_pairs(threshold, enrich)
        + ", "
        + _SIDES
        + ", o1 AS (SELECT file1, file2, column_name, row_number() OVER (PARTITION BY file1, file2 ORDER BY column_name) AS k "
        "FROM sides WHERE t2 IS NULL), "
        "opts AS (SELECT o1.file1, o1.file2, k, o1.column_name AS name1, list({'s': similarity, 'n': name2} "
        "ORDER BY similarity DESC, name2) FILTER (WHERE o2.column_name IS NOT NULL) AS c FROM o1 LEFT JOIN np ON name1 = o1.column_name "
        "LEFT JOIN sides o2 ON o2.file1 = o1.file1 AND o2.file2 = o1.file2 AND o2.column_name = name2 AND o2.t1 IS NULL "
        "GROUP BY ALL), "
        "mt(file1, file2, k, used, name1, pick) AS (SELECT file1, file2, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, "
        "NULL::STRUCT(s DOUBLE, n VARCHAR) FROM fp UNION ALL "
        "SELECT file1, file2, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.n) END, name1, pick FROM "
        "(SELECT m.file1, m.file2, o.k, m.used, o.name1, list_filter(o.c, lambda x: NOT list_contains(m.used, x.n))[1] AS pick "
        "FROM mt m JOIN opts o ON o.file1 = m.file1 AND o.file2 = m.file2 AND o.k = m.k + 1)), "
        "eq AS (SELECT file1, file2, name1, pick.n AS name2, pick.s AS s FROM mt WHERE pick IS NOT NULL), "
        "x AS (SELECT sides.*, e1.name2 AS m1, e1.s AS s, e2.name1 AS m2 FROM sides "
        "LEFT JOIN eq e1 ON e1.file1 = sides.file1 AND e1.file2 = sides.file2 AND e1.name1 = column_name AND t2 IS NULL "
        "LEFT JOIN eq e2 ON e2.file1 = sides.file1 AND e2.file2 = sides.file2 AND e2.name2 = column_name AND t1 IS NULL) "
        "SELECT file1, file2, 1 AS copies1, 1 AS copies2, "
        "(count(*) FILTER (WHERE t1 IS NOT NULL AND t2 IS NOT NULL) + count(m1)) / count(*) AS similarity, "
        "count(*) FILTER (WHERE t1 IS NOT NULL AND t2 IS NOT NULL) AS common_columns, "
        "coalesce(string_agg(column_name || ' (' || t1 || ')', ', ' ORDER BY column_name) FILTER (WHERE t2 IS NULL AND m1 IS NULL), '') AS unique_to_file1, "
        "coalesce(string_agg(column_name || ' (' || t2 || ')', ', ' ORDER BY column_name) FILTER (WHERE t1 IS NULL AND m2 IS NULL), '') AS unique_to_file2, "
        "coalesce(string_agg(column_name || ': ' || t1 || ' vs ' || t2, ', ' ORDER BY column_name) FILTER (WHERE t1 <> t2), '') AS type_mismatches, "
        "coalesce(string_agg(column_name || ' <-> ' || m1 || ' ' || printf('%.3f', s), ', ' ORDER BY column_name) FILTER (WHERE m1 IS NOT NULL), '') AS semantic_equivalents, "
        "coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (WHERE t2 IS NULL AND m1 IS NULL), '') AS missing_in_file2, "
        "coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (WHERE t1 IS NULL AND m2 IS NULL), '') AS missing_in_file1 "
        "FROM x GROUP BY file1, file2 HAVING count(*) FILTER (WHERE t1 IS NOT NULL AND t2 IS NOT NULL) + count(m1) > 0"
    )

def _naming_groups(threshold: float, enrich: bool) -> str:
    return (
        _naming_members(threshold, enrich)
        + ", "
        + _classes("cat", "column_name", 0.6)
        + f", g AS (SELECT lead, {_name_group_columns('column_name')}, round(avg(similarity), 6) AS avg_similarity, "
        "min_by(column_name, (length(column_name), -coalesce(similarity, 2), member)) AS shortest "
        "FROM gm JOIN items ON i = member GROUP BY lead) "
        f"SELECT file_name, column_name, concept, members, distinct_names, {_STYLE_LIST} AS styles, avg_similarity, {_SUGGESTION} AS suggestion "
        f"FROM g JOIN items ON i = lead JOIN cl ON name = column_name WHERE {_INCONSISTENT}"
    )


def _naming_names(members: str) -> str:
    """Pairs of names out of ``gm``."""
    return members + (
        "SELECT l.column_name AS leader, x.column_name AS member, similarity, count(DISTINCT x.i) AS members, count(*) AS pairs, "
        "min_by(l.file_name, l.i) AS leader_file, min_by(x.file_name, x.i) AS member_file FROM gm JOIN items l ON l.i = gm.lead "
        "JOIN items x ON x.i = gm.member WHERE gm.lead <> gm.member GROUP BY l.column_name, x.column_name, similarity"
    )


def _first_groups(members: str, classes: str) -> str:
    """Groups of the first leading column of every name."""
    return members + (
        ", fl AS (SELECT min(lead) AS lead FROM gm JOIN items ON i = lead GROUP BY column_name), "
        + classes
        + f", g AS (SELECT lead, {_name_group_columns('column_name')}, round(avg(similarity), 6) AS avg_similarity, "
        "min_by(column_name, (length(column_name), -coalesce(similarity, 2), member)) AS shortest "
        "FROM gm SEMI JOIN fl USING (lead) JOIN items ON i = member GROUP BY lead) "
        "SELECT column_name AS leader, file_name, concept, members, distinct_names, "
        f"{_STYLE_LIST} AS styles, avg_similarity, {_SUGGESTION} AS suggestion "
        f"FROM g JOIN items ON i = lead JOIN cl ON name = column_name WHERE {_INCONSISTENT}"
    )


def _short_edges(pairs: str) -> str:
    """CTEs ending in ``r``: a leading column and one whose name is like its own but longer or shorter by three or more."""
    return (
        CAT
        + ", "
        + pairs
        + ", "
        + _ITEMS
        + ", "
        + _ITEM_EDGES.replace("WHERE a.i <> b.i", "WHERE abs(length(name1) - length(name2)) >= 3")
        + ", "
        + _walk("items", "ie", later_only=False)
        + ", r AS (SELECT a.column_name AS n1, b.column_name AS n2, a.i AS i1, b.i AS i2, a.file_name AS f1, b.file_name AS f2, similarity, "
        "length(a.column_name) < length(b.column_name) AS s FROM led JOIN items a ON a.i = led.i JOIN items b ON b.i = led.j) "
    )


def _short_names(pairs: str) -> str:
    return _short_edges(pairs) + (
        ", p AS (SELECT n1, n2, s, similarity, count(*) AS pairs, min_by(f1, i1) AS f1, min_by(f2, i2) AS f2 FROM r GROUP BY ALL) "
        'SELECT CASE WHEN s THEN n1 ELSE n2 END AS "short", CASE WHEN s THEN n2 ELSE n1 END AS "long", similarity, n1 AS leader, pairs, '
        "CASE WHEN s THEN f1 ELSE f2 END AS short_file, CASE WHEN s THEN f2 ELSE f1 END AS long_file FROM p"
    )


def _near(k: int, least: float) -> str:
    """CTEs ending in ``nr`` (file1, file2, j, r): the nearest files of every file by columns and types."""
    return (
        "sz AS (SELECT file_name, count(*) AS n FROM cat GROUP BY ALL), "
        "nj AS (SELECT a.file_name AS file1, b.file_name AS file2, count(*) AS i FROM cat a JOIN cat b "
        "USING (column_name, data_type) WHERE a.file_name <> b.file_name GROUP BY ALL), "
        "ns AS (SELECT file1, file2, i / (s1.n + s2.n - i) AS j FROM nj JOIN sz s1 ON s1.file_name = file1 JOIN sz s2 ON s2.file_name = file2), "
        "nr AS (SELECT file1, file2, j, row_number() OVER (PARTITION BY file1 ORDER BY j DESC, file2) AS r FROM ns "
        f"WHERE j >= {least} QUALIFY r <= {k}), "
        "nb AS (SELECT DISTINCT least(file1, file2) AS file1, greatest(file1, file2) AS file2 FROM nr)"
    )


def _abbreviations(threshold: float, enrich: bool) -> str:
    return (
        CAT
        + ", "
        + _name_pairs(threshold, enrich)
        + ", "
        + _ITEMS
        + ", "
        + _ITEM_EDGES.replace("WHERE a.i <> b.i", "WHERE abs(length(name1) - length(name2)) >= 3")
        + ", "
        + _walk("items", "ie", later_only=False)
        + ", r AS (SELECT a.column_name AS n1, b.column_name AS n2, a.file_name AS f1, b.file_name AS f2, similarity, "
        "length(a.column_name) < length(b.column_name) AS s FROM led JOIN items a ON a.i = led.i JOIN items b ON b.i = led.j) "
        'SELECT CASE WHEN s THEN n1 ELSE n2 END AS "short", CASE WHEN s THEN n2 ELSE n1 END AS "long", similarity, '
        "CASE WHEN s THEN f1 ELSE f2 END AS short_file, CASE WHEN s THEN f2 ELSE f1 END AS long_file FROM r"
    )


def _concept_evolution(threshold: float) -> str:
    return (
        CAT
        + ", "
        + _concepts("cat", "column_name", threshold)
        + ", pf AS (SELECT concept, file_name, string_agg(column_name, ', ' ORDER BY similarity DESC, column_name) AS columns "
        "FROM cn JOIN cat ON column_name = name GROUP BY ALL) "
        "SELECT concept, count(*) OVER (PARTITION BY concept) AS file_count, file_name, columns FROM pf "
        "QUALIFY count(*) OVER (PARTITION BY concept) > 1"
    )


def _concept_types(threshold: float) -> str:
    return (
        CAT
        + ", "
        + _classes("cat", "column_name", threshold)
        + ", ty AS (SELECT concept, data_type, count(*) AS n FROM cat JOIN cl ON name = column_name WHERE concept <> 'other' GROUP BY ALL) "
        "SELECT concept, sum(n)::BIGINT AS columns, string_agg(data_type, ', ' ORDER BY data_type) AS inconsistent_types, "
        "min_by(data_type, (-n, data_type)) AS suggestion FROM ty GROUP BY concept HAVING count(*) > 1"
    )



def oracles() -> dict[str, str]:
    """Query name -> SQL."""
    given = "WITH " + _catalog(_given_profiles())
    tenants = "WITH " + _catalog(_tenant_profiles())
    list_columns = "count(*) AS column_count, max(total_rows) AS total_rows"
    typed = "SELECT column_name, data_type, count(*) AS file_count FROM cat GROUP BY ALL"
    mixed = "SELECT column_name FROM cat GROUP BY ALL HAVING count(DISTINCT data_type) > 1"
    common = "SELECT column_name, count(*) AS file_count FROM cat GROUP BY ALL HAVING count(*) >= 2"
    common_typed = (
        " SELECT column_name, count(*) AS file_count, count(DISTINCT data_type) AS type_variations, "
        "string_agg(DISTINCT data_type, ', ' ORDER BY data_type) AS data_types FROM cat GROUP BY ALL HAVING count(*) > 1"
    )
    column_rows = f"SELECT {_COUNTS} FROM cat WHERE "
    csv_type = (
        "CASE WHEN data_type = 'datetime' THEN 'string' WHEN data_type = 'integer' AND null_count > 0 THEN 'float' "
        # text that holds numbers only is numeric in a CSV
        "WHEN column_name IN ('cust_id', 'nation_id') THEN 'integer' WHEN column_name = 'total_price' THEN 'float' "
        "ELSE data_type END"
    )
    groups = (
        CAT
        + ", "
        + _JACCARD
        + ", items AS (SELECT row_number() OVER (ORDER BY file_name) AS i, file_name FROM (SELECT DISTINCT file_name FROM cat)), "
        "ie AS (SELECT a.i, b.i AS j, 1 AS similarity FROM jp JOIN items a ON a.file_name = file1 "
        "JOIN items b ON b.file_name = file2), "
        + _walk("items", "ie", later_only=True)
        + ", att AS (SELECT j, min(i) AS leader FROM led GROUP BY j), "
        "gm AS (SELECT x.file_name, coalesce(l.file_name, x.file_name) AS leader_file FROM items x "
        "LEFT JOIN att ON att.j = x.i LEFT JOIN items l ON l.i = att.leader) "
    )
    document_sets = (
        "WITH " + _WORDS + ", ds AS (SELECT doc_id, list(w ORDER BY w) AS ws, count(*) AS n FROM vocab GROUP BY doc_id), "
        "cls AS (SELECT min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n, ws FROM ds GROUP BY ws), "
        "rw AS (SELECT rep, n, copies, unnest(ws) AS w FROM cls), "
        "ov AS (SELECT a.rep AS rep1, b.rep AS rep2, a.copies AS copies1, b.copies AS copies2, a.n AS n1, b.n AS n2, "
        "count(*) AS shared FROM rw a JOIN rw b ON a.w = b.w AND a.rep < b.rep "
        "AND least(a.n, b.n) >= 0.69 * greatest(a.n, b.n) GROUP BY ALL) "
    )
    document_groups = (
        document_sets.replace("WITH ", "WITH RECURSIVE ", 1)
        + ", items AS (SELECT row_number() OVER (ORDER BY rep) AS i, rep, ws FROM cls), "
        "ie AS (SELECT a.i, b.i AS j, 1 AS similarity FROM ov JOIN items a ON a.rep = rep1 JOIN items b ON b.rep = rep2 "
        "WHERE shared / (n1 + n2 - shared) >= 0.7), "
        + _walk("items", "ie", later_only=True)
        + ", att AS (SELECT j, min(i) AS leader FROM led GROUP BY j), "
        "ld AS (SELECT x.ws, coalesce(l.rep, x.rep) AS leader FROM items x LEFT JOIN att ON att.j = x.i "
        "LEFT JOIN items l ON l.i = att.leader) "
        "SELECT doc_id, leader AS leader_doc_id FROM ds JOIN ld USING (ws)"
    )
    schema_groups = (
        groups
        + ", gs AS (SELECT leader_file, count(*) AS file_count FROM gm GROUP BY ALL HAVING count(*) > 1), "
        "gc AS (SELECT leader_file, column_name, count(*) AS c FROM gm JOIN cat USING (file_name) GROUP BY ALL), "
        "gw AS (SELECT leader_file, max(n) AS widest FROM gm JOIN sz USING (file_name) GROUP BY ALL) "
        "SELECT leader_file, file_count, coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (WHERE c = file_count), '') AS common_columns, "
        "count(*) FILTER (WHERE c = file_count) AS common_column_count, "
        "round(count(*) FILTER (WHERE c = file_count) / widest, 2) AS similarity_score "
        "FROM gs JOIN gc USING (leader_file) JOIN gw USING (leader_file) GROUP BY leader_file, file_count, widest"
    )
    differences = (
        " SELECT file1, file2, 1 AS copies1, 1 AS copies2, count(*) FILTER (WHERE t1 = t2) / count(*) AS similarity, "
        "count(*) FILTER (WHERE t1 IS NOT NULL AND t2 IS NOT NULL) AS common_columns_count, "
        "count(*) FILTER (WHERE t2 IS NULL) AS unique_to_file1_count, count(*) FILTER (WHERE t1 IS NULL) AS unique_to_file2_count, "
        "count(*) FILTER (WHERE t1 <> t2) AS type_mismatches_count, "
        "coalesce(string_agg(column_name || ' (' || t1 || ')', ', ' ORDER BY column_name) FILTER (WHERE t2 IS NULL), '') AS unique_to_file1, "
        "coalesce(string_agg(column_name || ' (' || t2 || ')', ', ' ORDER BY column_name) FILTER (WHERE t1 IS NULL), '') AS unique_to_file2, "
        "coalesce(string_agg(column_name || ': ' || t1 || ' vs ' || t2, ', ' ORDER BY column_name) FILTER (WHERE t1 <> t2), '') AS type_mismatches "
    )
    dense_members = _naming_members(0.25, False, _dense_pairs(0.25))
    return {
        "naming_group_names": _naming_names(_naming_members(0.6, enrich=False)),
        "naming_groups": _first_groups(_naming_members(0.6, enrich=False), _classes("cat", "column_name", 0.6)),
        "abbreviation_names": _short_names(_name_pairs(0.5, False)),
        "abbreviation_columns": _short_edges(_name_pairs(0.5, False))
        + ', e AS (SELECT CASE WHEN s THEN n1 ELSE n2 END AS "short", CASE WHEN s THEN n2 ELSE n1 END AS "long", n1 AS leader, * FROM r) '
        'SELECT DISTINCT "short", "long", leader, unnest([n1, n2]) AS column_name, unnest([f1, f2]) AS file_name FROM e',
        "nearest_schemas": CAT
        + ", "
        + _near(2, 0.05)
        + " SELECT file1 AS file_name, file2 AS near_file, 1 AS copies, j AS jaccard, r AS rank FROM nr",
        "nearest_differences": CAT
        + ", "
        + _near(2, 0.05)
        + ", "
        + _SIDES
        + differences
        + "FROM sides SEMI JOIN nb USING (file1, file2) GROUP BY file1, file2",
        "neighbouring_differences": CAT
        + ", "
        + _SIDES
        + ", nx AS (SELECT f AS file1, lead(f) OVER (ORDER BY f) AS file2 FROM files)"
        + differences
        + "FROM sides SEMI JOIN nx USING (file1, file2) GROUP BY file1, file2",
        "nearest_semantic_differences": _semantic_differences(0.5, enrich=False)
        .replace("fp AS (SELECT", _near(2, 0.05) + ", fp AS (SELECT", 1)
        .replace("WHERE a.f < b.f)", "JOIN nb ON nb.file1 = a.f AND nb.file2 = b.f)", 1)
        .replace("JOIN files b ON a.f < b.f)", "JOIN files b ON true JOIN nb ON nb.file1 = a.f AND nb.file2 = b.f)", 1),
        "dense_concepts": CAT
        + ", "
        + _dense_terms(N.CONCEPT_TERMS, 0.25)
        + ", cn AS (SELECT name, concept, max(similarity) AS similarity FROM ts GROUP BY ALL) "
        "SELECT concept, file_name, column_name, similarity FROM cn JOIN cat ON column_name = name",
        "dense_classes": CAT + ", " + _dense_classes(0.25) + " SELECT name AS column_name, concept FROM cl",
        "dense_schema_pairs": CAT
        + ", "
        + _schema_scores(0.1, pairs=_dense_pairs(0.1))
        + "SELECT file1, file2, 1 AS copies1, 1 AS copies2, similarity FROM sc",
        "dense_naming_groups": _first_groups(dense_members, _dense_classes(0.6)),
        "dense_naming_names": _naming_names(dense_members),
        "dense_abbreviations": _short_names(_dense_pairs(0.25)),
        "vector_pairs": f"WITH e AS (SELECT vec_id, {_VECTOR} FROM embeddings) SELECT a.vec_id AS vec1, b.vec_id AS vec2, {_COSINE} AS similarity "
        f"FROM e a, e b WHERE a.vec_id < b.vec_id AND {_COSINE} >= 0.4",
        "profile_catalog": given + f" SELECT {_COUNTS} FROM cat",
        "profile_nulls": tenants + f" SELECT {_COUNTS} FROM cat",
        "profile_reference_labels": given
        + " SELECT file_name, column_name, CASE WHEN data_type = 'array' THEN 'unknown' ELSE data_type END AS data_type, "
        "CASE WHEN data_type = 'array' THEN 0 ELSE null_count END AS null_count, "
        "CASE WHEN data_type = 'array' THEN 0 ELSE unique_count END AS unique_count, total_rows FROM cat",
        "profile_approximate": given + f" SELECT {_COUNTS}, true AS close FROM cat",
        "discover_files": " UNION ALL ".join(
            f"SELECT '{t}.parquet' AS file_name, 'parquet' AS format, count(*) AS total_rows FROM {t}" for t in GIVEN
        ),
        "scan_parquet": given + f" SELECT {_COUNTS} FROM cat",
        "scan_csv": tenants
        + f" SELECT replace(file_name, '.parquet', '.csv') AS file_name, column_name, {csv_type} AS data_type, "
        "null_count, unique_count, total_rows FROM cat",
        "scan_csv_sampled": " UNION ALL ".join(
            f"SELECT '{t}' AS file_name, least(count(*), 300) AS sampled_rows, {len(GIVEN[t].split())} AS column_count FROM {t}"
            for t in ("customer", "orders", "part", "documents")
        ),
        "csv_spanning_rows": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, length(coalesce(text, '')) AS n_chars FROM documents",
        "scan_sampled": given
        + " SELECT file_name, least(max(total_rows), 1000) AS sampled_rows, count(*) AS column_count FROM cat GROUP BY ALL",
        "scan_sampled_rows": "WITH "
        + _catalog([s for t, cols in GIVEN.items() for s in _profile(_sampled(t, 200), f"{t}.parquet", cols.split())])
        + f" SELECT {_COUNTS} FROM cat",
        "sampled_places": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, ri AS row, {key} AS key FROM {_sampled(t, 500)}"
            for t, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))
        ),
        "scan_rejected": " UNION ALL ".join(
            f"SELECT '{t}.parquet' AS file_name, 'File too large' AS reason, count(*) AS unread_rows FROM {t}" for t in GIVEN
        ),
        "scan_parts": """
SELECT 'customers' AS file_name, 'c_custkey' AS column_name, 'integer' AS data_type, count(*) AS total_rows, 0 AS null_count, NULL AS reason FROM customer
UNION ALL SELECT 'customers', 'c_name', 'string', count(*), 0, NULL FROM customer
UNION ALL SELECT 'orders', 'o_orderkey', 'integer', count(*), 0, NULL FROM orders
UNION ALL SELECT 'orders', 'o_totalprice', 'float', count(*), count(*) FILTER (WHERE o_orderkey % 2 = 0), NULL FROM orders
UNION ALL SELECT 'orders', 'p', 'integer', count(*), 0, NULL FROM orders
UNION ALL SELECT 'parts', NULL, NULL, NULL, NULL, 'clash of types'
UNION ALL SELECT 'suppliers', NULL, NULL, NULL, NULL, count(*) || ' rows hold more cells than the header' FROM supplier
""",
        "profile_parts": "WITH " + _catalog(
            _profile("(SELECT *, o_orderkey % 4 AS p FROM orders WHERE o_orderkey % 4 <> 3 OR o_orderstatus <> 'F')", "orders",
                     [*GIVEN["orders"].split(), "p"])
            + _profile("(SELECT * FROM customer WHERE c_custkey % 3 <> 2 OR c_acctbal > 0)", "customers", GIVEN["customer"].split())
        )
        + f" SELECT {_COUNTS}, true AS close, 1 AS read_again FROM cat",
        "catalog_round_trip": CAT
        + f" SELECT file_name, {list_columns} FROM cat WHERE file_name <> 'region.parquet' "
        "AND NOT (file_name = 'orders.parquet' AND column_name = 'o_orderstatus') GROUP BY ALL",
        "exported_rows": _LINES + "SELECT doc_id, n AS lines FROM c WHERE n > 20",
        "exported_documents": "SELECT 1 AS total_exports, 1 AS day_folders",
        "list_files": CAT + f" SELECT file_name, {list_columns} FROM cat GROUP BY ALL",
        "file_schema": CAT
        + " SELECT column_name, data_type, null_count, unique_count, total_rows FROM cat WHERE file_name = 'ordersAsia.parquet'",
        "database_stats": CAT
        + " SELECT count(DISTINCT file_name) AS total_files, count(*) AS total_columns, count(DISTINCT column_name) AS unique_columns FROM cat",
        "search_columns_like": CAT
        + " SELECT file_name, column_name, data_type, null_count, unique_count FROM cat WHERE column_name ILIKE '%r_n%'",
        "type_mismatches": CAT + f" SELECT * FROM ({typed}) SEMI JOIN ({mixed}) USING (column_name)",
        "type_mismatch_files": CAT
        + f" SELECT column_name, data_type, file_name FROM cat SEMI JOIN ({mixed}) USING (column_name)",
        "common_columns_sql": CAT + common_typed,
        "get_files": CAT
        + f" SELECT file_name, {list_columns} FROM cat WHERE contains(lower(file_name), 'customer') GROUP BY ALL",
        "get_schemas": CAT + " " + column_rows + "contains(lower(file_name), 'eu_')",
        "get_schemas_brief": CAT + f" SELECT file_name, {list_columns} FROM cat GROUP BY ALL",
        "search_columns": CAT + " " + column_rows + "contains(lower(column_name), 'r_n')",
        "search_files": CAT
        + " SELECT file_name, count(*) AS column_count, string_agg(column_name, ', ' ORDER BY column_name) AS columns "
        "FROM cat WHERE contains(lower(file_name), 'order') GROUP BY ALL",
        "search_types": CAT + " " + column_rows + "contains(lower(data_type), 'int')",
        "search_semantic": _search_rows("customer identifier"),
        "search_fallback": _search_rows("status order"),
        "catalog_totals": CAT
        + ", f AS (SELECT max(total_rows) AS r FROM cat GROUP BY file_name) SELECT (SELECT count(*) FROM f) AS total_files, "
        "(SELECT sum(r)::BIGINT FROM f) AS total_rows, count(DISTINCT column_name) AS unique_columns, "
        "count(DISTINCT data_type) AS unique_types, string_agg(DISTINCT data_type, ', ' ORDER BY data_type) AS data_types FROM cat",
        "file_stats": CAT
        + f" SELECT file_name, {list_columns} FROM cat WHERE contains(lower(file_name), 'orders') GROUP BY ALL",
        "column_stats": CAT
        + ", m AS (SELECT *, row_number() OVER (ORDER BY file_name, column_name) AS r FROM cat WHERE contains(lower(column_name), 'id')) "
        "SELECT count(*) AS matches, count(DISTINCT file_name) AS files, string_agg(DISTINCT data_type, ', ' ORDER BY data_type) AS data_types, "
        "string_agg(file_name || ': ' || column_name || ' (' || data_type || ')', '; ' ORDER BY r) FILTER (WHERE r <= 5) AS preview, "
        "greatest(count(*) - 5, 0) AS more FROM m",
        "largest_files": CAT
        + f" SELECT file_name, {list_columns} FROM cat GROUP BY ALL ORDER BY column_count DESC, file_name LIMIT 10",
        "common_columns": CAT + common_typed,
        "common_column_files": CAT
        + f" SELECT column_name, data_type, file_name, file_count FROM cat JOIN ({common}) USING (column_name)",
        "schema_jaccard_pairs": CAT
        + ", "
        + _JACCARD
        + ' SELECT file1, file2, 1 AS copies1, 1 AS copies2, i AS intersection, u AS "union", i / u AS jaccard FROM jp',
        "schema_group_files": groups + "SELECT file_name, leader_file FROM gm",
        "schema_groups": schema_groups,
        "tool_similar_schemas": schema_groups.replace(_SIMILAR, _SIMILAR.replace("0.1", "0.3")),
        "run_similar_schemas": schema_groups.replace(_SIMILAR, _SIMILAR.replace("0.1", "0.3")),
        "schema_differences": CAT
        + ", "
        + _SIDES
        + " SELECT file1, file2, 1 AS copies1, 1 AS copies2, count(*) FILTER (WHERE t1 = t2) / count(*) AS similarity, "
        "count(*) FILTER (WHERE t1 IS NOT NULL AND t2 IS NOT NULL) AS common_columns_count, "
        "count(*) FILTER (WHERE t2 IS NULL) AS unique_to_file1_count, count(*) FILTER (WHERE t1 IS NULL) AS unique_to_file2_count, "
        "count(*) FILTER (WHERE t1 <> t2) AS type_mismatches_count, "
        "coalesce(string_agg(column_name || ' (' || t1 || ')', ', ' ORDER BY column_name) FILTER (WHERE t2 IS NULL), '') AS unique_to_file1, "
        "coalesce(string_agg(column_name || ' (' || t2 || ')', ', ' ORDER BY column_name) FILTER (WHERE t1 IS NULL), '') AS unique_to_file2, "
        "coalesce(string_agg(column_name || ': ' || t1 || ' vs ' || t2, ', ' ORDER BY column_name) FILTER (WHERE t1 <> t2), '') AS type_mismatches "
        "FROM sides GROUP BY file1, file2 HAVING count(*) FILTER (WHERE t1 IS NOT NULL AND t2 IS NOT NULL) > 0",
        "schema_members": CAT
        + ", s AS (SELECT file_name, list(column_name || ' ' || data_type ORDER BY column_name) AS l FROM cat GROUP BY ALL) "
        "SELECT file_name, min(file_name) OVER (PARTITION BY l) AS first_file FROM s",
        "compare_schemas": CAT
        + ", a AS (SELECT column_name, data_type AS type1 FROM cat WHERE file_name = 'orders_us.parquet'), "
        "b AS (SELECT column_name, data_type AS type2 FROM cat WHERE file_name = 'ordersAsia.parquet') "
        "SELECT column_name, type1, type2, CASE WHEN type2 IS NULL THEN 'only_in_1' WHEN type1 IS NULL THEN 'only_in_2' "
        "WHEN type1 = type2 THEN 'same_type' ELSE 'different_type' END AS status FROM a FULL JOIN b USING (column_name)",
        "type_mismatches_map": CAT
        + f", t AS (SELECT * FROM ({typed}) SEMI JOIN ({mixed}) USING (column_name)) SELECT column_name, "
        "(sum(file_count) OVER (PARTITION BY column_name))::BIGINT AS total_files, data_type, file_count FROM t",
        "naming_patterns": CAT
        + ", n AS (SELECT DISTINCT column_name AS n, lower(column_name) AS l FROM cat), "
        "p AS (SELECT a.n AS column1, b.n AS column2, a.l AS la, b.l AS lb FROM n a JOIN n b ON a.n < b.n) "
        f"SELECT column1, column2, {_REASON} AS similarity_reason FROM p WHERE {_REASON} IS NOT NULL",
        "enhance_names": CAT
        + f" SELECT DISTINCT column_name, {_enriched('column_name')} AS enhanced FROM cat",
        "name_styles": CAT
        + f", n AS (SELECT column_name, {_name_group_columns('column_name')} FROM (SELECT DISTINCT column_name FROM cat) GROUP BY ALL) "
        f"SELECT column_name, {_STYLE_LIST} AS styles FROM n",
        "suggest_names": CAT
        + f", m AS (SELECT regexp_extract({_normal('column_name')}, '[^ ]*$') AS word, file_name, column_name FROM cat), "
        f"g AS (SELECT word, {_name_group_columns('column_name')}, "
        "min_by(column_name, (length(column_name), file_name, column_name)) AS shortest FROM m GROUP BY word) "
        f"SELECT word, members, distinct_names, {_STYLE_LIST} AS styles, {_INCONSISTENT} AS inconsistent, {_SUGGESTION} AS suggestion FROM g",
        "similar_columns": _semantic_search("customer identifier", 0.6)
        + "SELECT file_name, column_name, similarity FROM m JOIN cat USING (column_name)",
        "similar_names": CAT + ", " + _name_pairs(0.6, enrich=True) + " SELECT * FROM np",
        "concept_groups": CAT
        + ", "
        + _concepts("cat", "column_name", 0.5)
        + " SELECT concept, file_name, column_name, similarity FROM cn JOIN cat ON column_name = name",
        "classify_columns": CAT
        + ", "
        + _classes("cat", "column_name", 0.5)
        + " SELECT name AS column_name, concept FROM cl",
        "concept_evolution": _concept_evolution(0.5),
        "concept_types": _concept_types(0.5),
        "concept_type_columns": CAT
        + ", "
        + _classes("cat", "column_name", 0.5)
        + ", j AS (SELECT concept, file_name, column_name, data_type FROM cat JOIN cl ON name = column_name WHERE concept <> 'other') "
        "SELECT * FROM j SEMI JOIN (SELECT concept FROM j GROUP BY ALL HAVING count(DISTINCT data_type) > 1) USING (concept)",
        "tool_common_columns": CAT + common_typed,
        "run_type_mismatches": CAT
        + f", t AS (SELECT * FROM ({typed}) SEMI JOIN ({mixed}) USING (column_name)) SELECT column_name, "
        "(sum(file_count) OVER (PARTITION BY column_name))::BIGINT AS total_files, data_type, file_count FROM t",
        "tool_concept_groups": CAT
        + ", "
        + _concepts("cat", "column_name", 0.7)
        + " SELECT concept, file_name, column_name, similarity FROM cn JOIN cat ON column_name = name",
        "tool_concept_evolution": _concept_evolution(0.7),
        "tool_concept_types": _concept_types(0.6),
        "tool_semantic_pairs": CAT
        + ", "
        + _schema_scores(0.6, enrich=True)
        + "SELECT file1, file2, 1 AS copies1, 1 AS copies2, similarity FROM sc",
        "tool_semantic_differences": _semantic_differences(0.6, enrich=True),
        "tool_semantic_naming": _naming_groups(0.8, enrich=True),
        "tool_abbreviations": _abbreviations(0.8, enrich=True),
        "semantic_schema_pairs": CAT
        + ", "
        + _schema_scores(0.5)
        + "SELECT file1, file2, 1 AS copies1, 1 AS copies2, similarity FROM sc",
        "matching_concepts": CAT
        + ", "
        + _schema_scores(0.5)
        + ", "
        + _classes("cat", "column_name", 0.6)
        + " SELECT file1, file2, name1 AS column1, name2 AS column2, bm.similarity, concept FROM bm "
        "SEMI JOIN sc USING (file1, file2) JOIN cl ON name = name1",
        "naming_members": _naming_members(0.6, enrich=False)
        + "SELECT l.file_name AS leader_file, l.column_name AS leader_column, x.file_name, x.column_name, similarity "
        "FROM gm JOIN items l ON l.i = lead JOIN items x ON x.i = member",
        "naming_inconsistencies": _naming_groups(0.6, enrich=False),
        "abbreviations": _abbreviations(0.5, enrich=False),
        "semantic_differences": _semantic_differences(0.5, enrich=False),
        "common_words": "WITH "
        + _WORDS
        + " SELECT w AS word, count(*) AS file_count, count(DISTINCT lang) AS type_variations, "
        "string_agg(DISTINCT lang, ', ' ORDER BY lang) AS data_types FROM vocab GROUP BY w HAVING count(*) > 1",
        "words_of_languages": "WITH "
        + _WORDS
        + ", t AS (SELECT w, lang, count(*) AS n FROM vocab GROUP BY ALL) SELECT w AS word, lang, n AS documents, "
        "(sum(n) OVER (PARTITION BY w))::BIGINT AS total_documents FROM t QUALIFY count(*) OVER (PARTITION BY w) > 1",
        "word_documents": "WITH "
        + _WORDS
        + " SELECT w AS word, lang, doc_id::VARCHAR AS doc_id FROM vocab "
        "SEMI JOIN (SELECT w FROM vocab GROUP BY w HAVING count(DISTINCT lang) > 1) USING (w)",
        "word_families": "WITH "
        + _WORDS
        + ", n AS (SELECT DISTINCT w, lower(w) AS l FROM vocab), "
        "r AS (SELECT 'bare' AS rule, replace(l, '_', '') AS key, w FROM n UNION ALL SELECT 'prefix', left(l, 4), w FROM n "
        "UNION ALL SELECT 'suffix', right(l, 4), w FROM n) "
        "SELECT rule, key, count(*) AS names, min(w) AS first_name FROM r GROUP BY ALL HAVING count(*) > 1",
        "word_concepts": "WITH "
        + _WORDS
        + ", "
        + _concepts("vocab", "w", 0.5)
        + " SELECT concept, name AS word, similarity FROM cn",
        "classify_words": "WITH "
        + _WORDS
        + ", "
        + _classes("vocab", "w", 0.5)
        + " SELECT name AS word, concept FROM cl",
        "part_name_pairs": "WITH " + _name_pairs(0.6, False, "part", "p_name") + " SELECT * FROM np",
        "doc_jaccard_pairs": document_sets
        + "SELECT rep1, rep2, copies1, copies2, shared, n1 + n2 - shared AS united, round(shared / (n1 + n2 - shared), 6) AS jaccard "
        "FROM ov WHERE shared / (n1 + n2 - shared) >= 0.7",
        "doc_groups": document_groups,
        "vector_similar": "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), "
        "m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), "
        "q AS (SELECT label, list(m ORDER BY i) AS v, sqrt(sum(m * m)) AS n FROM m GROUP BY label) "
        "SELECT q.label AS query_id, vec_id AS item_id, round(list_dot_product(embedding::DOUBLE[], v) / n, 6) AS similarity "
        "FROM q, embeddings WHERE round(list_dot_product(embedding::DOUBLE[], v) / n, 6) >= 0.25",
        "content_lines": _LINES + "SELECT doc_id, n AS content_lines, n > 20 AS should_export FROM c",
        "preview": _LINES
        + "SELECT doc_id, array_to_string(shown, chr(10)) || CASE WHEN n > 5 THEN chr(10) || chr(10) || '[... ' || (n - len(shown)) "
        "|| ' more lines in export file ...]' ELSE '' END AS preview FROM c",
        "slug": f"WITH b AS (SELECT {_BLANK_SQL} AS bl) SELECT conv_id, turn, coalesce(nullif(regexp_replace(trim(regexp_replace("
        "left(lower(text), 30), '[^a-z0-9\\s]', '', 'g'), bl), '\\s+', '-', 'g'), ''), 'query') AS slug FROM conversations, b",
        "truncated_lists": CAT
        + ", l AS (SELECT file_name, list(column_name ORDER BY column_name) AS c FROM cat GROUP BY ALL) "
        "SELECT file_name, array_to_string(c[1:5], ', ') || CASE WHEN len(c) > 5 THEN '...' ELSE '' END AS columns FROM l",
    }
