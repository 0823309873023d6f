"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from logweave.llm.paragraph_dedup import Banding
from logweave.llm.url_filter import REJECT_AT, RULES, SOFT_TERMS, SOFT_WEIGHT, STRICT_TERMS, STRICT_WEIGHT

ORACLE: dict[str, str] = {}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE["op1_line_dedup"] = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM lines
), repeated AS (
    SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id > r.first_doc, false) AS gone FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_has = lambda term: f"CAST(regexp_matches(u, '(^|[^0-9a-z]){term}([^0-9a-z]|$)') AS INTEGER)"
_score = " + ".join([f"{STRICT_WEIGHT} * {_has(t)}" for t in STRICT_TERMS] + [f"{SOFT_WEIGHT} * {_has(t)}" for t in SOFT_TERMS])
_rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

ORACLE["op6_url_vocabulary"] = f"""
WITH split AS (
    SELECT page_id, translate(coalesce(url, ''), {_LOWER}) AS u,
           CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), located AS (
    SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), rules(rule_host, rule_path, says) AS (VALUES {_rules}), fitting AS (
    SELECT page_id, rule_host || rule_path AS rule, says,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
    FROM located JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), scored AS (SELECT *, {_score} AS term_score FROM located)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN term_score >= {REJECT_AT} THEN 'block' ELSE 'allow' END) AS verdict, term_score
FROM scored LEFT JOIN (SELECT page_id, rule, says FROM fitting WHERE place = 1) USING (page_id)
"""

# Links of nodes by shared shingles, then the smallest node that each can reach.
_REACH = """
reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)
"""

ORACLE["op8_lsh_forest"] = f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM worded
), nodes AS (
    SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (SELECT id, n, unnest(s) AS x FROM nodes), common AS (
    SELECT p.id AS a, q.id AS b, count(*) AS c, any_value(p.n) AS na, any_value(q.n) AS nb
    FROM shingles p JOIN shingles q ON p.x = q.x AND p.id < q.id AND 100 * p.n >= 80 * q.n AND 100 * q.n >= 80 * p.n GROUP BY p.id, q.id
), links AS (
    SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM common WHERE 100 * c >= 80 * (na + nb - c)
), {_REACH}
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.component, n.id, d.doc_id) AS component_id,
       d.doc_id = coalesce(l.component, n.id, d.doc_id) AS kept
FROM sets d LEFT JOIN nodes n ON n.s = d.s LEFT JOIN least l ON l.id = n.id
"""

_ALNUM = "[0-9a-z\\x{80}-\\x{10FFFF}]+"

ORACLE["op9_decontamination"] = f"""
WITH grams AS (
    SELECT kind, id, unnest(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')))) AS x
    FROM (
        SELECT 'doc' AS kind, doc_id AS id, regexp_extract_all(translate(text, {_LOWER}), '{_ALNUM}') AS w FROM documents WHERE text IS NOT NULL
        UNION ALL SELECT 'item', item_id, regexp_extract_all(translate(text, {_LOWER}), '{_ALNUM}') FROM benchmark WHERE text IS NOT NULL
    ) WHERE len(w) >= 5
), item AS (SELECT id, x, count(*) OVER (PARTITION BY id) AS n FROM grams WHERE kind = 'item')
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS common, any_value(i.n) AS item_shingles
FROM grams d JOIN item i ON d.x = i.x WHERE d.kind = 'doc' GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(i.n)
"""

_PARTS_OF_WORD = "[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"
_near = lambda frame: f"OVER (PARTITION BY doc_id, paragraph ORDER BY pos ROWS BETWEEN {frame})"
_banding = Banding()

ORACLE["op10_paragraph_dedup"] = f"""
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all(text, '{_PARTS_OF_WORD}') AS parts FROM documents WHERE text IS NOT NULL
), words AS (
    SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut
), lowered AS (
    SELECT doc_id, part, pos, translate(rtrim(part, {_BLANKS}), {_LOWER}) AS word,
           coalesce(lag(length(part) - length(replace(part, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY pos) > 1, false) AS blank_line FROM words
), hashed AS (
    SELECT *, md5(word) AS h, sum(CAST(blank_line AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS paragraph FROM lowered
), cuts AS (
    SELECT *, blank_line OR (h < min(h) {_near(f"{_banding.reach} PRECEDING AND 1 PRECEDING")}
           AND h <= min(h) {_near(f"1 FOLLOWING AND {_banding.reach} FOLLOWING")}
           AND count(*) {_near(f"{_banding.reach} PRECEDING AND {_banding.reach} FOLLOWING")} = {2 * _banding.reach + 1}) AS starts FROM hashed
), placed AS MATERIALIZED (
    SELECT doc_id, part, pos, word, CAST(sum(CAST(coalesce(starts, false) AND pos > 1 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS place FROM cuts
), units AS MATERIALIZED (
    SELECT doc_id, place, list(word ORDER BY pos) AS w, string_agg(word, ' ' ORDER BY pos) AS key FROM placed GROUP BY 1, 2
    HAVING count(*) >= {_banding.min_words}
), nodes AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY min(doc_id * 1000000 + place)) AS id, key, min(doc_id * 1000000 + place) AS head, any_value(w) AS w FROM units GROUP BY key
), sets AS (
    SELECT id, list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM nodes
), shingles AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS x FROM sets), common AS (
    SELECT p.id AS a, q.id AS b, count(*) AS c, any_value(p.n) AS na, any_value(q.n) AS nb
    FROM shingles p JOIN shingles q ON p.x = q.x AND p.id < q.id GROUP BY p.id, q.id
), links AS MATERIALIZED (
    SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM common WHERE 100 * c >= 80 * (na + nb - c)
), {_REACH}, heads AS (
    SELECT n.key, h.head FROM nodes n LEFT JOIN least l ON l.id = n.id JOIN nodes h ON h.id = coalesce(l.component, n.id)
), repeated AS (
    SELECT doc_id, place, len(w) AS n, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run
    FROM units JOIN heads USING (key) WHERE doc_id * 1000000 + place > head
), gone AS (
    SELECT doc_id, place FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, run) AS total FROM repeated) WHERE total >= {_banding.run_words}
), kept AS (
    SELECT doc_id, string_agg(part, '' ORDER BY pos) AS rest FROM placed p ANTI JOIN gone g USING (doc_id, place) GROUP BY 1
), counted AS (
    SELECT doc_id, count(*) AS n_removed, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS removed FROM gone GROUP BY 1
)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed,
       sha256(CASE WHEN n_removed IS NULL THEN coalesce(text, '') ELSE regexp_extract(text, '^[\\x20\\x09-\\x0D]*') || coalesce(rest, '') END) AS kept_sha256
FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _clusters(clusters: int, rounds: int, scale: int, salt: str) -> str:
    """Every round as table expressions: the nearest centroid of every vector, then the means of the clusters."""
    steps = [f"""
kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), vec_id) - 1 AS rid, vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), parts AS MATERIALIZED (
    SELECT rid, unnest(generate_series(1, 64)) AS dim, CAST(floor({scale} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept
), c0 AS MATERIALIZED (SELECT rid AS cluster, dim, x FROM parts WHERE rid < {clusters})"""]
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT p.rid, c.cluster, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS distance FROM parts p JOIN c{r} c USING (dim) GROUP BY 1, 2),
a{r} AS MATERIALIZED (
    SELECT rid, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) AS place FROM d{r}) WHERE place = 1
)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN parts USING (rid) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (
    SELECT c.cluster, c.dim, CASE WHEN n IS NULL THEN x ELSE CAST((s - ((s % n) + n) % n) / n AS BIGINT) END AS x FROM c{r} c LEFT JOIN m{r} USING (cluster, dim)
)""")
    return "WITH " + ",".join(steps) + f""",
shas AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN shas USING (cluster)
"""


ORACLE["op12_bit_plane_clusters"] = _clusters(8, 10, 1024, "3:")

# The crc32 of a text, bit by bit: the register shifts right, and takes the polynomial where the bit that leaves it is set.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        generate_series(0, length(bits) - 1), lambda k: CAST(bits[k - k % 8 + 8 - k % 8] AS BIGINT))),
        lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))))"""

ORACLE["op11_spelling_variants"] = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, run, count(*) AS times FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
    ) WHERE length(run) >= 5 GROUP BY 1, 2
), coded AS (
    SELECT run, times, CAST(CAST(encode(doc_id || ':' || run) AS BIT) AS VARCHAR) AS bits FROM runs
), hashed AS (
    SELECT run, times, {_CRC} AS h FROM coded
), words AS (
    SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, times FROM hashed
), vocabulary AS MATERIALIZED (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3
), places AS (
    SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM vocabulary
), shorter AS MATERIALIZED (
    SELECT DISTINCT word, n, word[: i - 1] || word[i + 1 :] AS rest FROM places
), holed AS MATERIALIZED (
    SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM places
), near AS MATERIALIZED (
    SELECT s.word, s.n, v.word AS other, v.n AS other_n FROM shorter s JOIN vocabulary v ON s.rest = v.word
    UNION ALL SELECT v.word, v.n, s.word, s.n FROM shorter s JOIN vocabulary v ON s.rest = v.word
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM holed a JOIN holed b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
), best AS (
    SELECT word, count(*) OVER (PARTITION BY word) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n,
           row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place
    FROM near
), forms AS MATERIALIZED (SELECT word, form FROM best WHERE place = 1 AND form IS NOT NULL), chain(word, root) AS (
    SELECT word, form FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word
), ends AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM forms))
SELECT v.word, b.form, coalesce(e.root, v.word) AS root, v.n, coalesce(b.n_near, 0) AS n_near, b.form_n
FROM vocabulary v LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (word) LEFT JOIN ends e USING (word)
"""

ORACLE["op13_jaccard_join"] = f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM worded
), nodes AS (
    SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (SELECT id, n, unnest(s) AS x FROM nodes), common AS (
    SELECT p.id AS a, q.id AS b, count(*) AS c, any_value(p.n) AS na, any_value(q.n) AS nb
    FROM shingles p JOIN shingles q ON p.x = q.x AND p.id < q.id AND 100 * p.n >= 90 * q.n AND 100 * q.n >= 90 * p.n GROUP BY p.id, q.id
), links AS (
    SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c) UNION ALL SELECT b, a FROM common WHERE 100 * c >= 90 * (na + nb - c)
), {_REACH}
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.component, n.id, d.doc_id) AS component_id
FROM sets d LEFT JOIN nodes n ON n.s = d.s LEFT JOIN least l ON l.id = n.id
"""
