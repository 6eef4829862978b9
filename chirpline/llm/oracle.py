"""SQL of the queries that SQL can express, over whole tables."""

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS, _SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"
_WINDOW = "array_to_string(list_slice(ws, i, i + {0} - 1), ' ')"


def _words(table: str, key: str, pattern: str, lower: bool) -> str:
    text = _LOW.format("text") if lower else "text"
    return f"SELECT {key}, ws, len(ws) AS n FROM (SELECT {key}, regexp_extract_all(coalesce({text}, ''), '{pattern}') AS ws FROM {table})"


OP2 = f"""WITH d AS ({_words('documents', 'doc_id', _LETTERS, True)}), t AS (SELECT *, least(n, 10) AS k FROM ({_words('benchmark', 'item_id', _LETTERS, True)}) WHERE n > 0),
 known AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, {_WINDOW.format('k')} AS g FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM t)),
 said AS (SELECT doc_id, i, k, {_WINDOW.format('k')} AS g FROM (SELECT d.*, z.k, unnest(range(1, n - z.k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t) z WHERE n >= z.k)),
 hits AS (SELECT doc_id, i, k, item FROM said JOIN known USING (k, g)),
 covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
 items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS ids FROM hits WHERE item IS NOT NULL GROUP BY doc_id)
 SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
 sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP4 = f"""WITH RECURSIVE d AS ({_words('documents', 'doc_id', _SPACED, True)}),
 s AS (SELECT DISTINCT doc_id, {_WINDOW.format('5')} AS g FROM (SELECT *, unnest(range(1, greatest(n - 4, 1) + 1)) AS i FROM d WHERE n > 0)),
 z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
 met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
 links AS (SELECT x, y FROM met JOIN z p ON p.doc_id = x JOIN z q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.size + q.size - shared)),
 sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 reach AS (SELECT DISTINCT x AS node, x AS other FROM sides UNION SELECT node, y FROM reach JOIN sides ON x = other)
 SELECT doc_id, CAST(coalesce(size, 0) AS BIGINT) AS n_shingles, coalesce(least(doc_id, c), doc_id) AS component_id
 FROM d LEFT JOIN z USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS c FROM reach GROUP BY node) USING (doc_id)"""

OP7 = f"""WITH d AS ({_words('documents', 'doc_id', _SPACED, False)}),
 w AS (SELECT doc_id, i, {_WINDOW.format('13')} AS g FROM (SELECT *, unnest(range(1, n - 11)) AS i FROM d WHERE n >= 13)),
 later AS (SELECT doc_id, i FROM w JOIN (SELECT g, min(doc_id) AS least_id FROM w GROUP BY g) USING (g) WHERE doc_id > least_id),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM later),
 words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n_kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
 SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

ORACLE = {"op2_decontaminate": OP2, "op4_ngram_join": OP4, "op7_substring_dedup": OP7}
