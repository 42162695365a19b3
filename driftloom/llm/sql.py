"""DuckDB SQL for the queries that SQL can express: plain definitions, without the operators' methods."""

from __future__ import annotations

from .sharding import Feistel

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents), i AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)),
g AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
h AS (SELECT g.doc_id, g.k, g.n, w.item_id FROM g JOIN w ON g.n = w.n AND g.g = w.g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

#: kind, pattern, condition on the match m, whether it counts for the digest
_SECRETS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", r"""len(regexp_extract(m, '^[^:=]*[:=]\x20*["'']?(.*)$', 1)) >= 12""", True),
    ("access", "AKIA[A-Z0-9]+", "len(m) >= 18", True),
    ("hex", "[0-9a-f]+", "len(m) >= 16", True),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "true", False),
    ("gittoken", "gh[opsu]_[A-Za-z0-9]+", "len(m) >= 24", False),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "true", False),
]


def _found(rank: int, kind: str, pattern: str, condition: str) -> str:
    pieces, hits = f"string_split_regex(coalesce(text, ''), '{pattern}')", f"regexp_extract_all(coalesce(text, ''), '{pattern}')"
    return f"""SELECT doc_id, {rank} AS r, '{kind}' AS kind, m, s, x FROM (SELECT doc_id, x, unnest(hs) AS m, unnest(list_transform(range(1, len(hs) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: len(x))), 0)))::BIGINT AS s
FROM (SELECT doc_id, coalesce(text, '') AS x, {pieces} AS ps, {hits} AS hs FROM documents)) WHERE {condition}"""


def _secrets() -> str:
    parts = " UNION ALL ".join(_found(r, k, p, c) for r, (k, p, c, _) in enumerate(_SECRETS))
    counts = ", ".join(f"count(*) FILTER (r = {r}) AS n_{k}" for r, (k, _, _, base) in enumerate(_SECRETS) if base)
    names = [f"n_{k}" for k, _, _, base in _SECRETS if base]
    show = "kind || ':' || s || ':' || (s + len(m))"
    return f"""WITH f AS ({parts}), a AS (SELECT doc_id, {counts}, string_agg({show}, ',' ORDER BY s, r) FILTER (r < {len(names)}) AS b, string_agg({show}, ',' ORDER BY s, r) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce({n}, 0) AS {n}' for n in names)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a USING (doc_id)"""


OP5 = _secrets()

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT ELSE (2 * substr(reverse({_DIGITS}), i, 1)::INT) // 10 + (2 * substr(reverse({_DIGITS}), i, 1)::INT) % 10 END)) % 10 = 0"
_COMPACT = "replace(m, ' ', '')"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split(substr({_COMPACT}, 5) || substr({_COMPACT}, 1, 4), ''), lambda c: ascii(c))), lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1"
_ALONE = "NOT regexp_matches(CASE WHEN s > 0 THEN substr(x, s, 1) ELSE '' END || ' ' || substr(x, s + len(m) + 1, 1), '[A-Za-z0-9]')"
#: kind, pattern, condition on the match, score, context words
_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.9, "mail|write|contact|kontakt|correo"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda o: len(ltrim(o, '0')) > 3 OR coalesce(try_cast(ltrim(o, '0') AS INT), 0) > 255)) = 0", 0.7, "ip|host|server|address"),
    ("card", r"[0-9](?:[ -]?[0-9])+", f"len({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", 0.8, "card|visa|credit|pay|karte|carte|tarjeta"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15", 0.6, "phone|tel|call|mobile|fax"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", f"{_ALONE} AND len({_COMPACT}) BETWEEN 15 AND 34 AND {_MOD97}", 0.8, "iban|account|konto|compte|cuenta|bank"),
    ("ssn", r"[0-9]+(?:-[0-9]+)+", f"{_ALONE} AND regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')", 0.3, "ssn|social security"),
]


def _pii() -> str:
    near = "lower(substr(x, greatest(s + 1 - 48, 1), least(s, 48)) || ' ' || substr(x, s + len(m) + 1, 48))"
    parts = " UNION ALL ".join(f"SELECT *, least(1.0, {score} + CASE WHEN regexp_matches({near}, '(?:^|[^a-z])(?:{words})') THEN 0.3 ELSE 0 END) AS score FROM ({_found(r, k, p, c)})" for r, (k, p, c, score, words) in enumerate(_PII))
    names = [f"n_{k}" for k, *_ in _PII[:4]]
    counts = ", ".join(f"count(*) FILTER (r = {r}) AS {n}" for r, n in enumerate(names))
    show = "kind || ':' || s || ':' || (s + len(m))"
    return f"""WITH f AS (SELECT * FROM ({parts}) WHERE score >= 0.5), a AS (SELECT doc_id, {counts}, string_agg({show}, ',' ORDER BY r, s) FILTER (r < 4) AS b, string_agg({show}, ',' ORDER BY r, s) AS spans, string_agg(printf('%.2f', score::DOUBLE), ',' ORDER BY r, s) AS scores FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce({n}, 0) AS {n}' for n in names)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM documents d LEFT JOIN a USING (doc_id)"""


OP4 = _pii()

OP6 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLD}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a WHERE r.c < l.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id"""

OP8 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda p: (p[2] - p[1]) * (p[2] - p[1])), lambda a, b: a + b)) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10"""


def _sharding(key: int = 17, shards: int = 8) -> str:
    """crc32 by its table, byte by byte; each Feistel round as nested selects; cycle walking as recursion."""

    def times(x: str, c: int) -> str:
        return f"((({x})::UHUGEINT * {c}::UHUGEINT) & 18446744073709551615::UHUGEINT)::UBIGINT"

    keys = [int(k) for k in Feistel(10, key).keys]  # they don't depend on the number of rows
    body = "SELECT row_no, half, n, (y >> half)::UBIGINT AS l0, (y & ((1::UBIGINT << half) - 1))::UBIGINT AS r0, y FROM {src}"
    for i, k in enumerate(keys):
        step = f"SELECT *, xor(r{i}, {k}::UBIGINT) AS a FROM ({body})"
        step = f"SELECT * EXCLUDE (a), {times('xor(a, a >> 30)', 0xBF58476D1CE4E5B9)} AS a FROM ({step})"
        step = f"SELECT * EXCLUDE (a), {times('xor(a, a >> 27)', 0x94D049BB133111EB)} AS a FROM ({step})"
        body = f"SELECT * EXCLUDE (l{i}, r{i}, a), r{i} AS l{i + 1}, xor(l{i}, xor(a, a >> 31) & ((1::UBIGINT << half) - 1)) AS r{i + 1} FROM ({step})"
    r = len(keys)
    walk = f"SELECT row_no, half, n, ((r{r} << half) | l{r})::UBIGINT AS y FROM ({body})"
    return f"""WITH RECURSIVE ct AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, (len(h) // 2 + 1)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256)), 4294967295)::BIGINT AS text_crc32 FROM b CROSS JOIN ct),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS row_no, count(*) OVER () AS n FROM d),
s AS (SELECT row_no, n, greatest(1, (CASE WHEN n <= 1 THEN 2 ELSE length(bin(greatest(n - 1, 1))) + 1 END) // 2)::INT AS half, row_no::UBIGINT AS y FROM o),
w AS ({walk.replace("{src}", "s")} UNION ALL {walk.replace("{src}", "(SELECT * FROM w WHERE y >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (y % {shards})::INT AS shard, (y // {shards})::BIGINT AS slot, NULL::INT AS grown_shard, y::BIGINT AS global_slot, row_no FROM o JOIN (SELECT row_no, y FROM w WHERE y < n) USING (row_no)"""


OP2 = _sharding()
