"""SQL for a second engine, written apart from the DataFrame code, over the same tables."""

from __future__ import annotations

PRELUDE = """
WITH RECURSIVE v AS (SELECT max(version) AS version FROM commits),
vn AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY _version, id ORDER BY _seq DESC) AS rn FROM nodes WHERE id IS NOT NULL AND id <> '') WHERE rn = 1),
ve AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY _version, source_id, target_id, type ORDER BY _seq DESC) AS rn FROM edges
       WHERE source_id IS NOT NULL AND source_id <> '' AND target_id IS NOT NULL AND target_id <> '') WHERE rn = 1),
an AS (SELECT _version, id, type, name, description, properties FROM vn UNION ALL
       SELECT c.version, r.id, r.type, r.name, r.description, r.properties FROM reference_nodes r, commits c WHERE NOT EXISTS (SELECT 1 FROM vn WHERE vn._version = c.version AND vn.id = r.id)),
ends AS (SELECT _version, source_id AS id FROM ve UNION SELECT _version, target_id FROM ve),
syn AS (SELECT e._version, e.id, CASE WHEN lower(e.id) LIKE '%source%' OR lower(e.id) LIKE '%raw%' OR lower(e.id) LIKE '%db.%' OR lower(e.id) LIKE '%table%' THEN 'Dataset' ELSE 'Pipeline' END AS type,
        regexp_extract(e.id, '[^.]*$') AS name, 'External Data Asset / Source (' || e.id || ')' AS description, '{"source": "lineage_traversal"}' AS properties
        FROM ends e WHERE NOT EXISTS (SELECT 1 FROM an WHERE an._version = e._version AND an.id = e.id)),
alln AS (SELECT * FROM an UNION ALL SELECT * FROM syn),
n AS MATERIALIZED (SELECT alln.* EXCLUDE (_version) FROM alln, v WHERE _version = version),
e AS MATERIALIZED (SELECT source_id, target_id, type FROM ve, v WHERE _version = version),
down0 AS (SELECT source_id AS root FROM e WHERE type = 'DERIVED_FROM' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
up0 AS (SELECT target_id AS root FROM e WHERE type = 'DERIVED_FROM' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
col0 AS (SELECT min(source_id) AS root FROM e, down0 WHERE type = 'BELONGS_TO' AND target_id = root)
"""

_SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_OBJ = "[\\s﻿ ]"
SCOPE = "ledger"


def _walk(start: str, depth: int, upstream: bool = False) -> str:
    near, far = ("target_id", "source_id") if upstream else ("source_id", "target_id")
    cond = "type <> 'BELONGS_TO'" if upstream else "(level = 0 OR type <> 'BELONGS_TO')"
    return f"""{PRELUDE}, w AS (SELECT root AS id, 0 AS level FROM {start} WHERE root IS NOT NULL UNION SELECT e.{far}, level + 1 FROM w JOIN e ON e.{near} = w.id WHERE level < {depth} AND {cond}),
lv AS (SELECT id, min(level)::INT AS level FROM w GROUP BY id)"""


def _walk_edges(start: str, depth: int, upstream: bool = False) -> str:
    near = "target_id" if upstream else "source_id"
    cond = "type <> 'BELONGS_TO'" if upstream else "(level = 0 OR type <> 'BELONGS_TO')"
    return f"{_walk(start, depth, upstream)} SELECT source_id, target_id, type, level + 1 AS depth FROM e JOIN lv ON lv.id = e.{near} WHERE level < {depth} AND {cond}"


#: The neighbourhood of SCOPE in a version.
def _scope(tag: str, version: str) -> str:
    return f"""n{tag} AS MATERIALIZED (SELECT * FROM alln WHERE _version = {version}), e{tag} AS MATERIALIZED (SELECT * FROM ve WHERE _version = {version}),
t1{tag} AS (SELECT id FROM n{tag} WHERE lower(id) = '{SCOPE}' OR lower(name) = '{SCOPE}'),
hit{tag} AS (SELECT id FROM t1{tag} UNION SELECT id FROM n{tag} WHERE NOT EXISTS (SELECT 1 FROM t1{tag}) AND (contains(lower(id), '{SCOPE}') OR contains(lower(name), '{SCOPE}'))),
d{tag} AS (SELECT id, 0 AS level FROM hit{tag} UNION SELECT x.target_id, level + 1 FROM d{tag} JOIN e{tag} x ON x.source_id = d{tag}.id WHERE level < 5 AND (level = 0 OR x.type <> 'BELONGS_TO')),
u{tag} AS (SELECT id, 0 AS level FROM hit{tag} UNION SELECT x.source_id, level + 1 FROM u{tag} JOIN e{tag} x ON x.target_id = u{tag}.id WHERE level < 5 AND x.type <> 'BELONGS_TO'),
reach{tag} AS (SELECT id FROM d{tag} UNION SELECT id FROM u{tag}),
sc{tag} AS MATERIALIZED (SELECT id FROM reach{tag} UNION SELECT source_id FROM e{tag} WHERE type = 'BELONGS_TO' AND target_id IN (SELECT id FROM reach{tag}))"""


_NODE_DIFF = """SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed'
WHEN a.type IS DISTINCT FROM b.type OR a.name IS DISTINCT FROM b.name OR a.description IS DISTINCT FROM b.description OR a.properties IS DISTINCT FROM b.properties THEN 'modified' END AS status, a.name AS old_name, b.name AS new_name
FROM {a} a FULL JOIN {b} b ON a.id = b.id"""
_DIFF = f"""{PRELUDE}, o AS (SELECT alln.* FROM alln, v WHERE _version = version - 1), nd AS ({_NODE_DIFF.format(a="o", b="n")}),
oe AS (SELECT source_id, target_id, type FROM ve, v WHERE _version = version - 1),
ed AS (SELECT *, 'added' AS status FROM (SELECT * FROM e EXCEPT SELECT * FROM oe) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM oe EXCEPT SELECT * FROM e))"""

_PARENTS = f"""{PRELUDE}, guess AS (SELECT id, coalesce(nullif(json_extract_string(properties, '$.dataset_id'), ''), CASE WHEN contains(id, '.') THEN regexp_replace(id, '\\.[^.]*$', '') END) AS g FROM n WHERE type = 'Column'),
held AS (SELECT source_id AS id, min(target_id) AS b FROM e WHERE type = 'BELONGS_TO' GROUP BY 1),
par AS (SELECT coalesce(g.id, h.id) AS id, coalesce(b, g) AS dataset_id FROM (SELECT * FROM guess WHERE g IS NOT NULL) g FULL JOIN held h ON g.id = h.id)"""
_ROLLED = f"""{_PARENTS}, ro AS (SELECT coalesce(s.dataset_id, e.source_id) AS source_id, coalesce(t.dataset_id, e.target_id) AS target_id, e.type, e.source_id AS rs, e.target_id AS rt FROM e LEFT JOIN par s ON s.id = e.source_id LEFT JOIN par t ON t.id = e.target_id WHERE e.type <> 'BELONGS_TO'),
rolled AS (SELECT * FROM ro WHERE source_id <> target_id AND source_id IN (SELECT id FROM n WHERE type <> 'Column') AND target_id IN (SELECT id FROM n WHERE type <> 'Column')),
jn AS (SELECT *, CASE WHEN lower(rs) LIKE '%.id' AND contains(lower(rt), '_id') THEN 2 WHEN contains(lower(rs), '_id') AND lower(rt) LIKE '%.id' THEN 1 ELSE 0 END AS score FROM rolled WHERE type = 'JOINS_WITH'),
jc AS (SELECT least(source_id, target_id) AS id_a, greatest(source_id, target_id) AS id_b, source_id, target_id, score::INT AS score FROM jn QUALIFY row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY score DESC, rs, rt, source_id, target_id) = 1)"""

_BYTES = "list_transform(range(32), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT / 255.0::DOUBLE * 2 - 1)"


def _token_sums(source: str, text: str) -> str:
    """id, i, x: sums of the digests of the tokens of a text."""
    return f"""src AS (SELECT id, {text} AS t FROM {source}),
raw AS (SELECT id, t, list_filter(regexp_split_to_array(t, '[^a-zA-Z0-9]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(t), '{_SPACE}'), lambda x: x <> '') AS b FROM src),
tok AS (SELECT id, t, list_transform(a, lambda x: lower(x)) AS a, b FROM raw),
tk AS (SELECT id, unnest(CASE WHEN len(a) + len(b) = 0 THEN [lower(t)] ELSE list_concat(a, list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) END) AS w FROM tok),
hs AS (SELECT w, {_BYTES} AS b FROM (SELECT DISTINCT w, sha256(w) AS h FROM tk)),
sm AS (SELECT id, i, sum(b[i + 1]) AS x FROM tk JOIN hs USING (w), range(32) r(i) GROUP BY id, i)"""


#: Members of properties that belong to the type; the others are the base properties, which are part of the text.
_OWN = {"Dataset": "database schema schema_name table_type owner", "Column": "dataset_id data_type is_nullable ordinal_position", "Pipeline": "resource_type owner", "User": "email", "Team": "email", "BusinessTerm": "definition domain"}
_OWN_SQL = "CASE type " + " ".join(f"WHEN '{t}' THEN {names.split()!r}" for t, names in _OWN.items()) + " ELSE [] END"
_MEMBER = "json_extract(properties, '$.\"' || k || '\"')"
_SPELT = f"""CASE json_type({_MEMBER}) WHEN 'VARCHAR' THEN {_MEMBER} ->> '$' WHEN 'BOOLEAN' THEN CASE WHEN {_MEMBER}::VARCHAR = 'true' THEN 'True' END WHEN 'NULL' THEN NULL
WHEN 'DOUBLE' THEN CASE WHEN {_MEMBER}::DOUBLE <> 0 THEN {_MEMBER}::DOUBLE::VARCHAR END WHEN 'ARRAY' THEN CASE WHEN json_array_length({_MEMBER}) > 0 THEN '[' || array_to_string(list_transform({_MEMBER}::VARCHAR[], lambda x: chr(39) || x || chr(39)), ', ') || ']' END
ELSE CASE WHEN {_MEMBER}::VARCHAR NOT IN ('0', '{{}}') THEN {_MEMBER}::VARCHAR END END"""
_KEPT = f"list_filter(list_transform(list_filter(json_keys(properties), lambda k: NOT list_contains({_OWN_SQL}, k)), lambda k: k || '=' || nullif({_SPELT}, '')), lambda x: x IS NOT NULL)"
_PROPS = f"CASE WHEN json_valid(properties) AND json_type(properties) = 'OBJECT' AND len({_KEPT}) > 0 THEN 'Properties: ' || array_to_string({_KEPT}, ', ') END"
_TEXT = f"concat_ws(' | ', 'Type: ' || type, 'Name: ' || name, CASE WHEN description <> '' THEN 'Description: ' || description END, {_PROPS})"
_VALID_VECTORS = "vv AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _version DESC, _seq DESC) AS rn FROM vectors WHERE id IS NOT NULL AND id <> '') WHERE rn = 1)"
_COSINE = f"""WITH {_VALID_VECTORS}, q AS (SELECT vector AS qv FROM vv WHERE len(list_filter(vector, lambda x: x <> 0)) > 0 ORDER BY id LIMIT 1),
ds AS (SELECT id, CASE WHEN len(list_filter(vector, lambda x: x <> 0)) = 0 THEN 1.0 ELSE 1 - list_cosine_similarity(vector::DOUBLE[], qv::DOUBLE[]) END AS d FROM vv, q WHERE vector IS NOT NULL)"""

_LOG = f"""{PRELUDE}, lg AS (SELECT source_id || '>' || target_id AS query_id, 'loader' AS user_name, 'select * from ' || source_id || ' a JOIN ' || target_id || ' b ON a.id = b.ref_id join ' || source_id AS query_text FROM e WHERE type IN ('DERIVED_FROM', 'JOINS_WITH')
UNION ALL SELECT doc_id::VARCHAR, source, text FROM documents)"""

_TERMS = ["raw shipment forecast", "raw", "shipment", "forecast", "show me the raw shipment forecast tables"]


def _score(t: str) -> str:
    return " + ".join(f"CASE WHEN contains(lower(coalesce({f}, '')), '{t}') THEN {s} ELSE 0 END" for f, s in (("name", 5), ("id", 4), ("description", 2), ("type", 1), ("properties", 1)))


_SCORED = f"sc AS (SELECT *, {' + '.join(f'({_score(t)})' for t in _TERMS)} AS score FROM n), tt AS (SELECT * FROM sc WHERE score > 0 ORDER BY score DESC, id LIMIT 10)"
_STOP = "['find','show','search','get','list','where','is','are','the','a','an','for','with','in','me','dataset','datasets','table','tables','column','columns','all','what','which','who','how','tell','about']"

_READABLE = """pl AS (SELECT * EXCLUDE (payload), regexp_replace(payload, '^[\\s\\x{FEFF}\\x{A0}]+|[\\s\\x{FEFF}\\x{A0}]+$', '', 'g') AS p FROM {t}),
pw AS (SELECT * EXCLUDE (p), CASE WHEN p LIKE '"%' AND json_valid(p) THEN regexp_replace(json_extract_string(p, '$'), '^[\\s\\x{FEFF}\\x{A0}]+|[\\s\\x{FEFF}\\x{A0}]+$', '', 'g') ELSE p END AS p FROM pl),
ok AS (SELECT * FROM pw WHERE json_valid(p))"""
_MANIFEST = f"""WITH {_READABLE.replace("{t}", "manifest_files")},
mem AS (SELECT file_id, 'nodes' AS section, unnest(json_keys(p, '$.nodes')) AS id, p -> '$.nodes' AS part FROM ok WHERE json_type(p, '$.nodes') = 'OBJECT' UNION ALL
        SELECT file_id, 'sources', unnest(json_keys(p, '$.sources')), p -> '$.sources' FROM ok WHERE json_type(p, '$.sources') = 'OBJECT'),
one AS (SELECT file_id, section, id, json_extract(part, '$."' || id || '"') AS x FROM mem),
ds AS (SELECT *, x ->> '$.resource_type' AS rt FROM one WHERE json_type(x) = 'OBJECT' AND (section = 'sources' OR x ->> '$.resource_type' IN ('model', 'seed', 'source')))"""
_RUNS = f"""WITH {_READABLE.replace("{t}", "run_files")},
ev0 AS (SELECT file_id, CASE WHEN json_type(p) = 'ARRAY' THEN json_extract(p, '$[*]') WHEN json_type(p) = 'OBJECT' THEN [p::JSON] ELSE []::JSON[] END AS a FROM ok),
ev AS (SELECT file_id, (i - 1)::INT AS pos, a[i] AS x FROM (SELECT file_id, a, unnest(range(1, len(a) + 1)) AS i FROM ev0) WHERE json_type(a[i]) = 'OBJECT'),
nm AS (SELECT file_id, pos, x, trim(concat_ws('.', nullif(x ->> '$.job.namespace', ''), nullif(x ->> '$.job.name', '')), '.') AS pipeline_id FROM ev),
po0 AS (SELECT file_id, pos, pipeline_id, 'inputs' AS side, unnest(json_extract(x, '$.inputs[*]')) AS m FROM nm UNION ALL SELECT file_id, pos, pipeline_id, 'outputs', unnest(json_extract(x, '$.outputs[*]')) FROM nm),
po AS (SELECT file_id, pos, pipeline_id, side, trim(concat_ws('.', nullif(m ->> '$.namespace', ''), nullif(m ->> '$.name', '')), '.') AS id FROM po0 WHERE json_type(m) = 'OBJECT')"""
_TRIPLE = "trim(concat_ws('.', coalesce(trim(table_catalog), ''), coalesce(trim(table_schema), ''), coalesce(trim(table_name), '')), '.')"

_HAS_DOWN = " OR ".join(f"contains(t, '{w}')" for w in ("blast", "impact", "affected", "break", "change", "downstream"))
_HAS_UP = " OR ".join(f"contains(t, '{w}')" for w in ("root cause", "upstream", "why", "origin", "source", "parent"))


def _merge(table: str, keys: str, where: str, fields: str) -> str:
    described = "description" if table == "nodes" else "''"
    return f"""WITH r AS (SELECT *, _version::HUGEINT * 9223372036854775807 + _seq AS o FROM {table} WHERE {where}),
kv AS (SELECT {keys}, k, o, regexp_replace(coalesce(json_extract_string(properties, '$."' || k || '"'), 'null'), '\\s', '', 'g') AS val FROM (SELECT {keys}, o, properties, unnest(json_keys(properties)) AS k FROM r)),
lk AS (SELECT {keys}, k, arg_max(val, o) AS val FROM kv GROUP BY {keys}, k), props AS (SELECT {keys}, string_agg(k || '=' || val, ',' ORDER BY k) AS merged FROM lk GROUP BY {keys})
SELECT {keys}{fields}, coalesce(merged, '') AS merged FROM (SELECT {keys}, arg_min(r, o) AS f, arg_min(CASE WHEN {described} <> '' THEN r END, CASE WHEN {described} <> '' THEN o END) AS d FROM r GROUP BY {keys}) LEFT JOIN props USING ({keys})"""


def _orphans() -> str:
    return f"""{PRELUDE}, rf AS (SELECT 'edges.source_id' AS ref_field, _version, source_id AS holder_a, target_id AS holder_b, type AS holder_type, source_id AS missing_id FROM ve UNION ALL
SELECT 'edges.target_id', _version, source_id, target_id, type, target_id FROM ve UNION ALL
SELECT 'nodes.dataset_id', _version, id, '', 'Column', json_extract_string(properties, '$.dataset_id') FROM vn WHERE type = 'Column'),
sp AS (SELECT id, min(_version) AS lo, max(_version) AS hi FROM vn GROUP BY id),
orp AS (SELECT rf.*, CASE WHEN lo < rf._version THEN 'gone' WHEN hi > rf._version THEN 'later' ELSE 'never' END AS reason FROM rf LEFT JOIN sp ON sp.id = missing_id
WHERE missing_id <> '' AND missing_id NOT IN (SELECT id FROM reference_nodes) AND NOT EXISTS (SELECT 1 FROM vn WHERE vn._version = rf._version AND vn.id = missing_id))"""


_HIER = f"""{PRELUDE}, lk AS MATERIALIZED (SELECT source_id AS child, min(target_id) AS parent FROM e WHERE type = 'BELONGS_TO' GROUP BY 1),
ids AS (SELECT child AS id FROM lk UNION SELECT parent FROM lk),
up AS (SELECT id, id AS anc, 0 AS d FROM ids UNION ALL SELECT up.id, lk.parent, d + 1 FROM up JOIN lk ON lk.child = up.anc WHERE d < 200),
tops AS (SELECT id, anc AS root_id, d FROM up WHERE anc NOT IN (SELECT child FROM lk)),
loops AS (SELECT DISTINCT id FROM up WHERE d > 0 AND id = anc),
below AS (SELECT anc AS id, count(*) AS n FROM up WHERE d > 0 AND id IN (SELECT id FROM tops) GROUP BY 1)"""

_DAG = f"""{PRELUDE}, bb AS (SELECT id FROM n WHERE type IN ('Dataset', 'Pipeline')),
be AS MATERIALIZED (SELECT DISTINCT source_id AS s, target_id AS t FROM e WHERE type <> 'BELONGS_TO' AND source_id <> target_id AND source_id IN (SELECT id FROM bb) AND target_id IN (SELECT id FROM bb)),
clo AS (SELECT s, t FROM be UNION SELECT clo.s, be.t FROM clo JOIN be ON be.s = clo.t),
bad AS (SELECT s AS id FROM clo WHERE s = t UNION SELECT t FROM clo WHERE s IN (SELECT s FROM clo WHERE s = t)),
lp AS (SELECT id, 0 AS level FROM bb WHERE id NOT IN (SELECT t FROM be) UNION SELECT be.t, level + 1 FROM lp JOIN be ON be.s = lp.id WHERE be.t NOT IN (SELECT id FROM bad)),
good AS (SELECT id, max(level) AS level FROM lp GROUP BY id),
bl AS (SELECT id, level FROM good UNION ALL SELECT b.id, coalesce(max(g.level) + 1, 0) FROM bad b LEFT JOIN be ON be.t = b.id LEFT JOIN good g ON g.id = be.s GROUP BY b.id),
cl AS (SELECT n.id, coalesce(bl.level, 0) AS level FROM n LEFT JOIN bl ON bl.id = json_extract_string(n.properties, '$.dataset_id') WHERE type = 'Column'),
kn AS (SELECT * FROM bl UNION ALL SELECT * FROM cl),
ul AS (SELECT n.id, coalesce(max(kn.level), 0) + 1 AS level FROM n LEFT JOIN e ON e.target_id = n.id LEFT JOIN kn ON kn.id = e.source_id WHERE n.type = 'User' GROUP BY n.id),
dl AS (SELECT * FROM kn UNION ALL SELECT * FROM ul UNION ALL SELECT id, 0 FROM n WHERE type NOT IN ('Dataset', 'Pipeline', 'Column', 'User'))"""


def _latex(text: str) -> str:
    """The same clean-up as nested calls."""
    steps = [(r"\\" + w + r"\{([^}]+)\}", r"\1") for w in ("text", "mathrm", "mathbf", "mathit")] + [(r"\\_", "_")]
    for names, char in (("rightarrow|to", "→"), ("leftarrow", "←"), ("Rightarrow", "⇒"), ("Leftarrow", "⇐"), ("leftrightarrow", "↔"), ("Leftrightarrow", "⇔"), ("longrightarrow|mapsto|implies", "⟶"),
                        ("approx", "≈"), ("neq", "≠"), ("le|leq", "≤"), ("ge|geq", "≥"), ("times", "×"), ("cdot", "·"), ("dots|cdots", "...")):
        steps += [(rf"\$\s*\\+(?:{names})\s*\$", char), (rf"\\+(?:{names})\b", char)]
    steps += [(r"\$([^$\n]*?[→←⇒⇐↔⇔⟶⟵⟹↦][^$\n]*?)\$", r"\1"), (r"\{([→←⇒⇐↔⇔⟶⟵⟹↦])\}", r"\1")]
    for a, b in steps:
        text = f"regexp_replace({text}, '{a}', '{b}', 'g')"
    return text


_JSON = """list_sort(list_filter(list_transform(json_keys(properties), lambda k: k || ':' || CASE json_type(properties, '$."' || k || '"') WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 's' || json_extract_string(properties, '$."' || k || '"')
WHEN 'UBIGINT' THEN 'n' || json_extract_string(properties, '$."' || k || '"')::DOUBLE::VARCHAR WHEN 'BIGINT' THEN 'n' || json_extract_string(properties, '$."' || k || '"')::DOUBLE::VARCHAR WHEN 'DOUBLE' THEN 'n' || json_extract_string(properties, '$."' || k || '"')::DOUBLE::VARCHAR
ELSE json_extract(properties, '$."' || k || '"')::VARCHAR END), lambda x: x IS NOT NULL))"""
_CHANGES = f"""{PRELUDE}, rec AS (SELECT 'node' AS rec_kind, _version, id AS key_a, '' AS key_b, '' AS key_c, concat_ws(chr(1), type, name, coalesce(description, ''), {_JSON}::VARCHAR) AS c FROM vn UNION ALL
SELECT 'edge', _version, source_id, target_id, type, {_JSON}::VARCHAR FROM ve),
st AS (SELECT coalesce(a.rec_kind, b.rec_kind) AS rec_kind, coalesce(b._version, a._version + 1) AS _version, coalesce(a.key_a, b.key_a) AS key_a, coalesce(a.key_b, b.key_b) AS key_b, coalesce(a.key_c, b.key_c) AS key_c,
CASE WHEN a.key_a IS NULL THEN 'added' WHEN b.key_a IS NULL THEN 'removed' WHEN a.c IS DISTINCT FROM b.c THEN 'changed' END AS change_kind
FROM rec a FULL JOIN rec b ON b._version = a._version + 1 AND a.rec_kind = b.rec_kind AND a.key_a = b.key_a AND a.key_b = b.key_b AND a.key_c = b.key_c)"""

_ITEMS = f"""{_RUNS.replace("WITH pl", "WITH RECURSIVE pl")}, mpl AS (SELECT file_id, regexp_replace(payload, '^[\\s\\x{{FEFF}}\\x{{A0}}]+|[\\s\\x{{FEFF}}\\x{{A0}}]+$', '', 'g') AS p FROM manifest_files),
mpw AS (SELECT file_id, CASE WHEN p LIKE '"%' AND json_valid(p) THEN regexp_replace(json_extract_string(p, '$'), '^[\\s\\x{{FEFF}}\\x{{A0}}]+|[\\s\\x{{FEFF}}\\x{{A0}}]+$', '', 'g') ELSE p END AS p FROM mpl), mok AS (SELECT * FROM mpw WHERE json_valid(p)),
mem AS (SELECT file_id, 'nodes' AS section, unnest(json_keys(p, '$.nodes')) AS id, p -> '$.nodes' AS part FROM mok WHERE json_type(p, '$.nodes') = 'OBJECT' UNION ALL
        SELECT file_id, 'sources', unnest(json_keys(p, '$.sources')), p -> '$.sources' FROM mok WHERE json_type(p, '$.sources') = 'OBJECT'),
one AS (SELECT file_id, section || '/' || id AS path, json_extract(part, '$."' || id || '"') AS x FROM mem WHERE json_type(json_extract(part, '$."' || id || '"')) = 'OBJECT'),
ck AS (SELECT file_id, path, k, json_extract(x, '$.columns."' || k || '"') AS c FROM (SELECT *, unnest(json_keys(x, '$.columns')) AS k FROM one WHERE json_type(x, '$.columns') = 'OBJECT') UNION ALL
       SELECT file_id, path, i::VARCHAR, json_extract(x, '$.columns[' || i || ']') FROM (SELECT *, unnest(range(json_array_length(x, '$.columns')::BIGINT)) AS i FROM one WHERE json_type(x, '$.columns') = 'ARRAY')),
dp AS (SELECT file_id, path, i, json_extract_string(x, '$.depends_on.nodes[' || i || ']') AS d FROM (SELECT *, unnest(range(json_array_length(x, '$.depends_on.nodes')::BIGINT)) AS i FROM one WHERE json_type(x, '$.depends_on.nodes') = 'ARRAY')),
io AS (SELECT file_id, pos, side, i, json_extract(x, '$.' || side || '[' || i || ']') AS m FROM (SELECT file_id, pos, side, x, unnest(range(json_array_length(x, '$.' || side)::BIGINT)) AS i FROM nm, (VALUES ('inputs'), ('outputs')) s(side) WHERE json_type(x, '$.' || side) = 'ARRAY')),
pt AS (SELECT file_id, pos || '/' || side || '/' || i AS path, pos::VARCHAR AS parent, trim(concat_ws('.', nullif(m ->> '$.namespace', ''), nullif(m ->> '$.name', '')), '.') AS name, m FROM io WHERE json_type(m) = 'OBJECT'),
fd AS (SELECT file_id, path, json_extract(m, '$.facets.schema.fields') AS f FROM pt WHERE name <> '' UNION ALL
       SELECT file_id, path || '/fields/' || i, json_extract(f, '$[' || i || '].fields') FROM (SELECT *, unnest(range(json_array_length(f)::BIGINT)) AS i FROM fd WHERE json_type(f) = 'ARRAY') WHERE json_type(f, '$[' || i || ']') = 'OBJECT'),
fi AS (SELECT file_id, path || '/fields/' || i AS path, path AS parent, json_extract(f, '$[' || i || ']') AS c FROM (SELECT *, unnest(range(json_array_length(f)::BIGINT)) AS i FROM fd WHERE json_type(f) = 'ARRAY'))
SELECT file_id, path AS item_path, '' AS parent_path, coalesce(x ->> '$.name', '') AS item_name FROM one UNION ALL
SELECT file_id, path || '/columns/' || k, path, coalesce(c ->> '$.name', '') FROM ck WHERE json_type(c) = 'OBJECT' UNION ALL
SELECT file_id, path || '/depends_on/' || i, path, d FROM dp WHERE d IS NOT NULL UNION ALL
SELECT file_id, pos::VARCHAR, '', pipeline_id FROM nm UNION ALL SELECT file_id, path, parent, name FROM pt WHERE name <> '' UNION ALL
SELECT file_id, path, parent, coalesce(c ->> '$.name', '') FROM fi WHERE json_type(c) = 'OBJECT'"""

SQL: dict[str, str] = {
    "graph_nodes": f"{PRELUDE} SELECT id, type, name, coalesce(description, '') AS description FROM n",
    "graph_edges": f"{PRELUDE} SELECT source_id, target_id, type FROM e",
    "full_graph_counts": f"{PRELUDE} SELECT _version, type, count(*) AS n, 'node' AS kind FROM vn GROUP BY 1, 2 UNION ALL SELECT _version, type, count(*), 'edge' FROM ve GROUP BY 1, 2",
    "dedupe_last_wins_nodes": f"{PRELUDE} SELECT _version, id, _seq FROM vn",
    "dedupe_last_wins_edges": f"{PRELUDE} SELECT _version, source_id, target_id, type, _seq FROM ve",
    "dedupe_last_wins_vectors": f"WITH {_VALID_VECTORS} SELECT id, _seq, coalesce(len(vector), -1)::INT AS dim FROM vv",
    "synthesized_endpoints": f"{PRELUDE} SELECT id, type, name, description FROM syn, v WHERE _version = version",
    "timeline": "SELECT version, strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, epoch_ms(ts) AS timestamp_ms, operation FROM commits",
    "as_of_version_join": "SELECT doc_id, (SELECT arg_max(version, ts) FROM commits c WHERE c.ts <= d.written_at + INTERVAL 100 MILLISECOND) AS version FROM documents d",
    "snapshot_as_of": f"{PRELUDE}, seen AS (SELECT arg_max(version, ts) AS av FROM commits WHERE ts <= TIMESTAMPTZ '2025-05-01 12:00:00.1+00') SELECT id, type, name FROM an, seen WHERE _version = av",
    "blast_radius_levels": f"{_walk('down0', 5)} SELECT id, level FROM lv",
    "blast_radius_depth_10": f"{_walk('down0', 10)} SELECT id, level FROM lv",
    "blast_radius_edges": _walk_edges("down0", 5),
    "blast_radius_from_column": f"{_walk('col0', 5)} SELECT id, level FROM lv",
    "root_cause_levels": f"{_walk('up0', 5, True)} SELECT id, level FROM lv",
    "root_cause_edges": _walk_edges("up0", 5, True),
    "multi_source_blast_counts": f"""{PRELUDE}, w AS (SELECT id AS root, id, 0 AS level FROM n WHERE type = 'Pipeline' UNION SELECT root, e.target_id, level + 1 FROM w JOIN e ON e.source_id = w.id WHERE level < 3 AND (level = 0 OR type <> 'BELONGS_TO'))
SELECT root, level, count(*) AS n_ids FROM (SELECT root, id, min(level)::INT AS level FROM w GROUP BY 1, 2) GROUP BY 1, 2""",
    "depth_by_type_summary": f"{_walk('down0', 5)} SELECT type, level, count(*) AS n FROM n JOIN lv USING (id) GROUP BY 1, 2",
    "scope_match": f"{PRELUDE}, {_scope('b', '(SELECT version FROM v)')} SELECT id, name FROM nb WHERE id IN (SELECT id FROM hitb)",
    "scoped_neighbourhood": f"{PRELUDE}, {_scope('b', '(SELECT version FROM v)')} SELECT id FROM scb",
    "diff_nodes": f"{_DIFF} SELECT * FROM nd WHERE status IS NOT NULL",
    "diff_edges": f"{_DIFF} SELECT * FROM ed",
    "diff_counts": f"{_DIFF} SELECT status, count(*) AS n, 'node' AS kind FROM nd WHERE status IS NOT NULL GROUP BY 1 UNION ALL SELECT status, count(*), 'edge' FROM ed GROUP BY 1",
    "diff_tags": f"{_DIFF} SELECT tag, count(*) AS n FROM (SELECT n.id, coalesce(nd.status, 'same') AS tag FROM n LEFT JOIN nd ON nd.id = n.id) GROUP BY 1",
    "diff_scoped": f"""{PRELUDE}, {_scope("a", "(SELECT version - 1 FROM v)")}, {_scope("b", "(SELECT version FROM v)")},
na2 AS (SELECT * FROM na WHERE id IN (SELECT id FROM sca)), nb2 AS (SELECT * FROM nb WHERE id IN (SELECT id FROM scb)), nd AS ({_NODE_DIFF.format(a="na2", b="nb2")}),
ea2 AS (SELECT source_id, target_id, type FROM ea WHERE source_id IN (SELECT id FROM sca) OR target_id IN (SELECT id FROM sca)), eb2 AS (SELECT source_id, target_id, type FROM eb WHERE source_id IN (SELECT id FROM scb) OR target_id IN (SELECT id FROM scb))
SELECT id, '' AS other, status FROM nd WHERE status IS NOT NULL UNION ALL SELECT source_id, type || ' ' || target_id, 'added' FROM (SELECT * FROM eb2 EXCEPT SELECT * FROM ea2) UNION ALL
SELECT source_id, type || ' ' || target_id, 'removed' FROM (SELECT * FROM ea2 EXCEPT SELECT * FROM eb2)""",
    "nodes_by_ids": f"{PRELUDE} SELECT pos::INT AS pos, id, type, name FROM (VALUES (0, 'team.data_platform'), (1, 'no.such.id'), (2, 'term.shared_churn'), (3, 'team.data_platform')) x(pos, id) JOIN n USING (id)",
    "search_terms": f"""{PRELUDE}, s AS (SELECT id, trim(lower(concat_ws(' ', name, description))) AS r FROM vn, v WHERE _version = version),
s2 AS (SELECT id, r, list_filter(regexp_split_to_array(r, '{_SPACE}'), lambda w: w <> '' AND NOT list_contains({_STOP}, w)) AS w FROM s),
s3 AS (SELECT id, list_concat(CASE WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END, w, [r]) AS l FROM s2),
s4 AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM s3), s5 AS (SELECT id, l[i] AS t, min(i) AS i FROM s4 WHERE length(l[i]) >= 2 GROUP BY 1, 2)
SELECT id, coalesce(string_agg(t, '|' ORDER BY i), '') AS terms FROM s5 GROUP BY id""",
    "term_search": f"{PRELUDE}, {_SCORED} SELECT id, score::INT AS score FROM tt",
    "vector_topk": f"{_COSINE} SELECT id, round(d, 5) AS distance FROM ds WHERE d <= 0.75 ORDER BY d, id LIMIT 10",
    "vector_within_distance": f"{_COSINE} SELECT id, round(d, 5) AS distance FROM ds WHERE d <= 0.9",
    "token_hash_embedding": f"{PRELUDE}, nn AS (SELECT vn.* FROM vn, v WHERE _version = version), {_token_sums('nn', _TEXT)} SELECT id, i::INT AS i, round(x, 6) + 0.0 AS x FROM sm",
    "hybrid_search": f"""{PRELUDE}, {_SCORED}, both_src AS (SELECT id, {_TEXT} AS txt FROM n UNION ALL SELECT chr(1), '{_TERMS[-1]}'), {_token_sums("both_src", "txt")},
qq AS (SELECT i, x FROM sm WHERE id = chr(1)), nv AS (SELECT * FROM sm WHERE id <> chr(1)),
dd AS (SELECT nv.id, 1 - sum(nv.x * qq.x) / sqrt(sum(nv.x * nv.x) * sum(qq.x * qq.x)) AS d FROM nv JOIN qq USING (i) GROUP BY nv.id),
vh AS (SELECT id, 1 AS stage, d AS k FROM dd WHERE d <= 0.75 ORDER BY d, id LIMIT 5), th AS (SELECT id, 2 AS stage, -score::DOUBLE AS k FROM tt), hb AS (SELECT * FROM vh UNION ALL SELECT * FROM th),
ph AS (SELECT DISTINCT p.id, 3 AS stage, 0.0::DOUBLE AS k FROM n c JOIN n p ON p.id = json_extract_string(c.properties, '$.dataset_id') WHERE c.id IN (SELECT id FROM hb) AND p.id NOT IN (SELECT id FROM hb)),
al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage) AS rn FROM (SELECT * FROM hb UNION ALL SELECT * FROM ph)) WHERE rn = 1)
SELECT id, stage::INT AS stage, row_number() OVER (ORDER BY stage, k, id)::INT AS pos FROM al ORDER BY stage, k, id LIMIT 10""",
    "parent_resolution": f"{PRELUDE} SELECT id, name FROM n WHERE type <> 'Column' AND id IN (SELECT json_extract_string(properties, '$.dataset_id') FROM n WHERE type = 'Column')",
    "visible_nodes": f"{PRELUDE} SELECT id, type FROM n WHERE type <> 'Column' AND (contains(lower(name), 'forecast') OR contains(lower(id), 'forecast') OR contains(lower(type), 'forecast'))",
    "column_parents": f"{_PARENTS} SELECT * FROM par",
    "column_rollup": f"{_ROLLED} SELECT DISTINCT source_id, target_id, type FROM rolled",
    "join_pair_collapse": f"{_ROLLED} SELECT * FROM jc",
    "display_edges": f"{_ROLLED} SELECT DISTINCT source_id, target_id, type FROM rolled WHERE type <> 'JOINS_WITH' UNION ALL SELECT source_id, target_id, 'JOINS_WITH' FROM jc",
    "column_clouds": f"""{_PARENTS}, cc AS (SELECT dataset_id, coalesce(TRY_CAST(json_extract_string(properties, '$.ordinal_position') AS INT), 1073741824) AS o, name, name || ' (' || coalesce(json_extract_string(properties, '$.data_type'), '') || ')' AS x FROM n JOIN par USING (id) WHERE type = 'Column')
SELECT dataset_id, count(*) AS n_columns, string_agg(x, ', ' ORDER BY o, name, x) AS columns FROM cc GROUP BY 1""",
    "degree_histogram": f"{PRELUDE}, dg AS (SELECT 'out' AS side, source_id AS id, count(*) AS degree FROM e GROUP BY 1, 2 UNION ALL SELECT 'in', target_id, count(*) FROM e GROUP BY 1, 2) SELECT side, degree, count(*) AS n_ids FROM dg GROUP BY 1, 2",
    "last_segment": f"{PRELUDE} SELECT id, regexp_extract(id, '[^.]*$') AS last FROM vn, v WHERE _version = version",
    "html_escape": "SELECT doc_id, md5(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html FROM documents",
    "intent_route": f"SELECT doc_id, CASE WHEN {_HAS_DOWN} THEN 'downstream' WHEN {_HAS_UP} THEN 'upstream' ELSE 'search' END AS intent FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)",
    "iso_to_epoch": f"""{_RUNS}, tm AS (SELECT file_id, pos, x ->> '$.eventTime' AS event_time FROM ev), ms AS (SELECT *, epoch_ms(TRY_CAST(event_time AS TIMESTAMPTZ)) + CASE WHEN contains(event_time, 'T') AND NOT contains(event_time, '.') THEN 999 ELSE 0 END AS ms FROM tm)
SELECT file_id, pos, event_time, ms, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM ms""",
    "regex_table_refs": f"{_LOG} SELECT DISTINCT query_id, unnest(regexp_extract_all(query_text, '(?i)(?:FROM|JOIN)\\s+([a-zA-Z0-9_\\.]+)', 1)) AS source_id, 'user:' || user_name AS target_id FROM lg WHERE user_name IS NOT NULL",
    "regex_pairs": f"""{_LOG}, jp AS (SELECT query_id, regexp_extract_all(query_text, '([a-zA-Z0-9_]+\\.[a-zA-Z0-9_\\.]+)\\s*=\\s*([a-zA-Z0-9_]+\\.[a-zA-Z0-9_\\.]+)', 1) AS l, regexp_extract_all(query_text, '([a-zA-Z0-9_]+\\.[a-zA-Z0-9_\\.]+)\\s*=\\s*([a-zA-Z0-9_]+\\.[a-zA-Z0-9_\\.]+)', 2) AS r FROM lg)
SELECT query_id, l AS source_id, r AS target_id, count(*) AS n FROM (SELECT query_id, unnest(l) AS l, unnest(r) AS r FROM jp) GROUP BY 1, 2, 3""",
    "node_merge": _merge("nodes", "id", "id IS NOT NULL", ", f.type AS type, f.name AS name, coalesce(d.description, '') AS description"),
    "edge_merge": _merge("edges", "source_id, target_id, type", "source_id <> '' AND target_id <> ''", ""),
    "alias_resolution": f"""{PRELUDE}, ds AS (SELECT id, name, _seq, json_extract_string(properties, '$.database') AS db, json_extract_string(properties, '$.schema') AS sch FROM vn, v WHERE _version = version AND type = 'Dataset'),
ak AS (SELECT lower(id) AS alias, id, _seq FROM ds UNION SELECT lower(name), id, _seq FROM ds UNION SELECT lower(sch || '.' || name), id, _seq FROM ds WHERE sch <> '' UNION SELECT lower(db || '.' || sch || '.' || name), id, _seq FROM ds WHERE sch <> '' AND db <> ''),
la AS (SELECT alias, arg_max(id, _seq) AS id FROM ak WHERE alias <> '' GROUP BY 1), rw AS (SELECT rec_id, {_TRIPLE} AS raw_id FROM info_tables),
r1 AS (SELECT rw.*, a.id AS whole, b.id AS pre FROM rw LEFT JOIN la a ON a.alias = lower(raw_id) LEFT JOIN la b ON contains(raw_id, '.') AND b.alias = regexp_replace(lower(raw_id), '\\.[^.]*$', '')),
r2 AS (SELECT *, pre || '.' || regexp_extract(raw_id, '[^.]*$') AS made FROM r1)
SELECT rec_id, raw_id, coalesce(whole, c.id, made, raw_id) AS canonical FROM r2 LEFT JOIN la c ON c.alias = lower(made)""",
    "ingest_dbt": f"""{_MANIFEST} SELECT file_id, section, id, x ->> '$.name' AS name, x ->> '$.schema' AS schema, x ->> '$.database' AS database, x ->> '$.meta.owner' AS owner,
CASE json_type(x, '$.columns') WHEN 'OBJECT' THEN len(json_keys(x, '$.columns')) WHEN 'ARRAY' THEN json_array_length(x, '$.columns') ELSE 0 END::INT AS n_columns,
CASE WHEN section = 'nodes' AND json_type(x, '$.depends_on.nodes') = 'ARRAY' THEN json_array_length(x, '$.depends_on.nodes') ELSE 0 END::INT AS n_depends_on FROM ds""",
    "ingest_dbt_lineage": f"{_MANIFEST} SELECT source_id, target_id, 'DERIVED_FROM' AS type, count(*) AS n FROM (SELECT id AS target_id, unnest(json_extract_string(x, '$.depends_on.nodes[*]')) AS source_id FROM ds WHERE section = 'nodes') WHERE source_id IS NOT NULL GROUP BY 1, 2",
    "ingest_sql_catalog": f"SELECT rec_id, {_TRIPLE} AS id, table_name AS name, table_catalog AS database, table_schema AS schema, coalesce(table_type, 'BASE TABLE') AS table_type FROM info_tables",
    "ingest_sql_columns": f"SELECT {_TRIPLE} || '.' || coalesce(column_name, '') AS id, {_TRIPLE} AS dataset_id, coalesce(is_nullable = 'YES', false) AS is_nullable, count(*) AS n FROM info_columns GROUP BY 1, 2, 3",
    "ingest_openlineage": f"{_RUNS} SELECT nm.file_id, nm.pos, nm.pipeline_id, count(*) FILTER (side = 'inputs' AND id <> '')::INT AS n_inputs, count(*) FILTER (side = 'outputs' AND id <> '')::INT AS n_outputs FROM nm LEFT JOIN po USING (file_id, pos) GROUP BY 1, 2, 3",
    "ingest_openlineage_edges": f"{_RUNS} SELECT CASE side WHEN 'inputs' THEN id ELSE pipeline_id END AS source_id, CASE side WHEN 'inputs' THEN pipeline_id ELSE id END AS target_id, CASE side WHEN 'inputs' THEN 'CONSUMED_BY' ELSE 'PRODUCED_BY' END AS type, count(*) AS n FROM po WHERE id <> '' AND pipeline_id <> '' GROUP BY 1, 2, 3",
    "dag_levels": f"{_DAG} SELECT id, level::INT AS level FROM dl",
    "layout_positions": f"{_DAG} SELECT id, level::INT AS level, level * 360.0::DOUBLE AS x, (row_number() OVER (PARTITION BY level ORDER BY id) - 1 - (count(*) OVER (PARTITION BY level) - 1) / 2.0::DOUBLE) * 280 AS y FROM dl",
    "latex_clean": "SELECT doc_id, md5(" + _latex(r"'$\rightarrow$ \text{x} ' || text || ' a\_b $\leq$ \times'") + ") AS clean FROM documents",
    "p3_found": f"{_CHANGES} SELECT st.* FROM st, v WHERE change_kind IS NOT NULL AND _version BETWEEN 2 AND version",
    "p7_found": _ITEMS,
    "p5_found": f"""{_HIER} SELECT i.id AS node_id, coalesce(t.root_id, '') AS root_id, coalesce(t.d, -1)::INT AS tree_depth, CASE WHEN t.id IS NULL THEN -1 ELSE coalesce(b.n, 0) END AS n_below,
CASE WHEN t.id IS NOT NULL THEN 'tree' WHEN i.id IN (SELECT id FROM loops) THEN 'on_cycle' ELSE 'under_cycle' END AS node_state FROM ids i LEFT JOIN tops t ON t.id = i.id LEFT JOIN below b ON b.id = i.id""",
    "p5_descendants": f"{_HIER} SELECT anc AS node_id, id AS below_id, d::INT AS levels_below FROM up WHERE d > 0 AND id IN (SELECT id FROM tops)",
    "p5_paths": f"{_HIER} SELECT id AS node_id, string_agg(anc, ' > ' ORDER BY d DESC) AS path FROM up WHERE id IN (SELECT id FROM tops) GROUP BY 1",
    "p6_found": f"{_orphans()} SELECT * FROM orp",
    "p6_report": f"{_orphans()} SELECT ref_field, _version, reason, count(*) AS n_orphans, count(DISTINCT missing_id) AS n_missing_ids FROM orp GROUP BY 1, 2, 3",
}
