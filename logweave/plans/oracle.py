"""The same queries as SQL over the test tables, for comparison in another engine.

Each statement is put together from named table expressions (``PARTS``).
"""

from __future__ import annotations

import re

from logweave.plans.catalog import K, ORDER, PATTERN_SHARE, PATTERNS, SIZE, STRIDE, TREE_SHARE

PARTS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def _order(sql: str, placed: list[str], open_: tuple[str, ...] = ()) -> list[str]:
    """Append the table expressions ``sql`` reads, each after the ones it reads itself."""
    for name in PARTS:
        used = re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql)
        if used and name not in placed and name not in open_:
            _order(PARTS[name], placed, (*open_, name))
            placed.append(name)
    return placed


def statement(sql: str) -> str:
    """Put the table expressions the statement needs in front of it."""
    used = _order(sql, [])
    if not used:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in used) + "\n" + sql


def add(name: str, sql: str) -> None:
    ORACLE[name] = statement(sql)


# ---- views ----------------------------------------------------------------------------------

PARTS["log_events"] = r"""
  SELECT event_id AS line_id, ts, user_id, value,
         'evt blk_' || user_id || ' to blk_-' || (user_id % 10) || ' again blk_' || user_id AS content,
         event_type || '_' || (CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) % 4) AS template,
         CAST(CASE WHEN event_type = 'error' AND value > 20 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM events"""
PARTS["block_ids"] = r"""
  SELECT DISTINCT unnest(['blk_' || user_id, 'blk_-' || (user_id % 10)]) AS entity_id FROM log_events"""
PARTS["block_labels"] = """
  SELECT entity_id, CAST(CASE WHEN abs(CAST(substr(entity_id, 5) AS BIGINT)) % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM block_ids"""
PARTS["entity_log"] = r"""
  SELECT unnest(list_distinct(regexp_extract_all(content, '(blk_-?\d+)', 1))) AS session_id, line_id, template, label
  FROM log_events"""
PARTS["user_log"] = "SELECT 'blk_' || user_id AS session_id, line_id, template, label FROM log_events"
PARTS["doc_split"] = r"""
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents"""
PARTS["doc_numbered"] = r"""
  SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) AS n FROM doc_split"""
PARTS["log_docs"] = r"""
  SELECT doc_id * 2147483648 + n - 1 AS line_id, doc_id, content,
         regexp_replace(trim(content), '[0-9]+', '<*>', 'g') AS template
  FROM doc_numbered WHERE trim(content) <> ''"""
PARTS["conv_log"] = """
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS pos, conv_id * 2147483648 + turn AS line_id, role AS template,
         CAST(role = 'system' AS INTEGER) AS label FROM conversations"""

PARTS["item_log"] = """
  SELECT CAST(l_suppkey AS VARCHAR) AS session_id, l_returnflag || l_linestatus || l_linenumber AS template,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity) AS line_id,
         CAST(l_quantity >= 49 AS INTEGER) AS label FROM lineitem"""

# ---- sources and sinks ----------------------------------------------------------------------

add("s1_structured_csv", """
  SELECT line_id AS LineId, content AS Content, CASE WHEN line_id % 5 = 0 THEN '' ELSE template END AS EventTemplate,
         CASE WHEN label = 1 THEN 'FATAL' ELSE '-' END AS Label FROM log_events""")
add("s2_entity_labels", "SELECT entity_id, label FROM block_labels")
PARTS["id_rows"] = """
  SELECT session_id::BIGINT AS id, string_agg(template, ',' ORDER BY pos) AS templates FROM conv_log GROUP BY 1"""
add("s3_id_sequences", """
  SELECT CASE WHEN id % 3 = 0 THEN 'train' ELSE 'test' END AS split,
         CAST(row_number() OVER (PARTITION BY CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END ORDER BY id % 3, id) - 1 AS BIGINT) AS session_id,
         templates, CAST(CASE WHEN id % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM id_rows""")

# ---- splits of the user sessions: the data set used by features, detectors, evaluation --------

PARTS["user_sessions"] = """
  SELECT session_id, count(*) AS length, max(label) AS label, min(line_id) AS first_line FROM user_log GROUP BY 1"""
PARTS["user_split"] = """
  SELECT *, CASE WHEN r <= CAST(trunc(CAST(1 - 0.2::DOUBLE AS DOUBLE) * n) AS BIGINT) THEN 'train'
                 WHEN r > n - CAST(trunc(0.2::DOUBLE * n) AS BIGINT) THEN 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || session_id), session_id) AS r, count(*) OVER () AS n FROM user_sessions)"""
PARTS["user_lines"] = """
  SELECT l.*, s.split, row_number() OVER (PARTITION BY l.session_id ORDER BY l.line_id) - 1 AS pos
  FROM user_log l JOIN user_split s USING (session_id) WHERE s.split IS NOT NULL"""
PARTS["train_vocab"] = """
  SELECT template, CAST(row_number() OVER (ORDER BY f, template) + 1 AS INTEGER) AS template_id
  FROM (SELECT template, min(line_id) AS f FROM user_lines WHERE split = 'train' GROUP BY 1)"""
PARTS["coded_lines"] = """
  SELECT u.*, coalesce(v.template_id, 1) AS template_id FROM user_lines u LEFT JOIN train_vocab v USING (template)"""

add("s4_session_dataset", """
  SELECT session_id, line_id, pos, template, label, split, 0.2::DOUBLE AS test_ratio FROM coded_lines""")
add("s5_session_summary", """
  SELECT split, count(*) AS sessions, round(avg(CAST(label > 0 AS INTEGER)), 6) AS anomalous_share
  FROM user_split WHERE split IS NOT NULL GROUP BY 1""")
add("s6_word_vectors", """
  SELECT 'w' || vec_id AS token, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
         CAST(CAST(unnest(embedding) AS VARCHAR) AS DOUBLE) AS value FROM embeddings""")
PARTS["value_counts"] = """
  SELECT cut, sum(CAST(value > cut AND label = 1 AS INTEGER)) AS tp, sum(CAST(value > cut AND label = 0 AS INTEGER)) AS fp,
         sum(CAST(value <= cut AND label = 1 AS INTEGER)) AS fn FROM log_events, (SELECT unnest([20, 60]) AS cut) GROUP BY 1"""
add("s7_run_results", """
  SELECT substr(md5(params), 1, 8) AS run_id, 'threshold' AS model, params,
         round(CASE WHEN tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)::DOUBLE AS f1,
         round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS rc, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS pc
  FROM (SELECT *, '{"cut": ' || cut || ', "dataset": "events"}' AS params FROM value_counts)""")

# ---- projections ----------------------------------------------------------------------------

SECOND = "CAST(epoch_us(date_trunc('second', ts)) AS BIGINT)"
add("p1_compact_timestamp", f"SELECT line_id AS LineId, {SECOND} AS ts FROM log_events")
add("p2_microsecond_timestamp", "SELECT line_id AS LineId, CAST(epoch_us(ts) AS BIGINT) AS ts FROM log_events")
add("p3_dotted_timestamp", f"SELECT line_id AS LineId, {SECOND} AS ts FROM log_events")
PARTS["first_time"] = "SELECT arg_min(epoch_us(ts), line_id) AS t0 FROM log_events"
PARTS["second_lines"] = """
  SELECT line_id, user_id, CAST(trunc((epoch_us(ts) - t0) / 1000000.0) AS BIGINT) AS sec FROM log_events, first_time"""
add("p4_seconds_since_first", "SELECT line_id, sec FROM second_lines")
add("p5_alert_label", "SELECT line_id AS LineId, label FROM log_events")
add("p6_entity_ids", "SELECT line_id, 'blk_' || user_id || ',blk_-' || (user_id % 10) AS entities FROM log_events")
PARTS["line_hits"] = """
  SELECT e.line_id, max(b.label) AS label FROM entity_log e JOIN block_labels b ON b.entity_id = e.session_id GROUP BY 1"""
add("p7_normalize", f"""
  SELECT 'hdfs' AS family, line_id, {SECOND} AS ts, content, template, h.label FROM log_events JOIN line_hits h USING (line_id)
  UNION ALL SELECT 'bgl', line_id, CAST(epoch_us(ts) AS BIGINT), content, template, label FROM log_events
  UNION ALL SELECT 'thunderbird', line_id, {SECOND}, content, template, label FROM log_events""")

# ---- joins and lookups ----------------------------------------------------------------------

add("l1_session_labels", """
  SELECT e.session_id, count(*) AS length, max(b.label) AS label
  FROM entity_log e JOIN block_labels b ON b.entity_id = e.session_id GROUP BY 1""")
add("l2_line_labels", "SELECT line_id, label FROM line_hits")
add("l3_template_ids", "SELECT session_id, line_id, template_id FROM coded_lines WHERE split = 'test'")

TOKENS = """list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace({text}, '[^a-zA-Z]+', ' ', 'g'),
  '([A-Z][a-z][^A-Z ]*)', ' \\1 ', 'g'), ' +'), lambda w: w <> ''), lambda w: lower(w))"""
PARTS["doc_templates"] = "SELECT template, count(*) AS lines FROM log_docs GROUP BY 1"
PARTS["template_lists"] = f"SELECT template, lines, {TOKENS.format(text='template')} AS toks FROM doc_templates"
PARTS["template_words"] = """
  SELECT template, lines, unnest(toks) AS token, CAST(generate_subscripts(toks, 1) AS INTEGER) AS token_pos FROM template_lists"""
PARTS["token_counts"] = "SELECT token, count(*) AS n FROM template_words GROUP BY 1"
for least in (1, 2, 3):
    PARTS[f"token_vocab{least}"] = f"""
  SELECT token, CAST(row_number() OVER (ORDER BY token) + 1 AS INTEGER) AS token_id, n FROM token_counts WHERE n >= {least}"""
add("l4_token_ids", """
  SELECT md5(w.template) AS template_md5, w.token_pos, coalesce(v.token_id, 1) AS token_id FROM template_words w LEFT JOIN token_vocab3 v USING (token)""")
PARTS["doc_split30"] = """
  SELECT doc_id, CASE WHEN r <= CAST(trunc(CAST(1 - 0.3::DOUBLE AS DOUBLE) * n) AS BIGINT) THEN 'train'
                      WHEN r > n - CAST(trunc(0.3::DOUBLE * n) AS BIGINT) THEN 'test' END AS split
  FROM (SELECT doc_id, row_number() OVER (ORDER BY f) AS r, count(*) OVER () AS n
        FROM (SELECT doc_id, min(line_id) AS f FROM log_docs GROUP BY 1))"""
add("l5_new_templates", """
  SELECT DISTINCT template FROM log_docs JOIN doc_split30 USING (doc_id) WHERE split = 'test'
  EXCEPT SELECT template FROM log_docs JOIN doc_split30 USING (doc_id) WHERE split = 'train'""")
add("l6_filter_unseen_normal", """
  SELECT line_id, template, CAST(length(content) % 11 = 0 AS INTEGER) AS label FROM log_docs
  WHERE doc_id % 2 = 1 AND (length(content) % 11 = 0 OR template IN (SELECT template FROM log_docs WHERE doc_id % 2 = 0))""")
PARTS["all_tokens"] = """
  SELECT 'PADDING' AS token, 0 AS token_id UNION ALL SELECT 'OOV', 1 UNION ALL SELECT token, token_id FROM token_vocab1"""
# The reserved ids have embeddings by number, but no token of the vocabulary carries them.
PARTS["token_vectors"] = """
  SELECT a.token, a.token_id, CAST(e.embedding IS NOT NULL AS INTEGER) AS has_vec,
         coalesce(CAST(e.embedding AS DOUBLE[]), list_transform(range(64), lambda x: 0.0::DOUBLE)) AS vec
  FROM all_tokens a LEFT JOIN embeddings e ON e.vec_id = a.token_id AND a.token_id >= 2"""
PARTS["vector_dims"] = """
  SELECT token, token_id, has_vec, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim, unnest(vec) AS v FROM token_vectors"""
add("l7_vocabulary_vectors", """
  SELECT token, token_id, has_vec, dim, round(v, 6) AS value FROM vector_dims WHERE has_vec = 1
  UNION ALL SELECT token, token_id, has_vec, NULL, NULL FROM token_vectors WHERE has_vec = 0""")
add("l7_vector_coverage", """
  SELECT count(*) AS entries, CAST(sum(has_vec) AS BIGINT) AS with_vector, round(avg(has_vec), 6) AS coverage FROM token_vectors""")

# ---- sessions -------------------------------------------------------------------------------

PARTS["entity_lines"] = """
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_id) - 1 AS pos FROM entity_log"""
add("g1_entity_sessions", "SELECT session_id, pos, line_id, template FROM entity_lines")
PARTS["tops"] = "SELECT line_id, sec, max(sec) OVER (ORDER BY line_id) AS m FROM second_lines"
PARTS["top_set"] = "SELECT DISTINCT m FROM tops"
PARTS["hops"] = """
  SELECT m, min(m) OVER (ORDER BY m RANGE BETWEEN 3601 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM top_set"""
PARTS["anchors"] = "SELECT min(m) AS a FROM top_set UNION ALL SELECT h.nxt FROM anchors x JOIN hops h ON h.m = x.a WHERE h.nxt IS NOT NULL"
add("g2_anchored_sessions", "SELECT t.line_id, t.sec, a.a AS session_id FROM tops t ASOF JOIN anchors a ON t.m >= a.a")
PARTS["user_tops"] = "SELECT user_id, line_id, sec, max(sec) OVER (PARTITION BY user_id ORDER BY line_id) AS m FROM second_lines"
PARTS["user_top_set"] = "SELECT DISTINCT user_id, m FROM user_tops"
PARTS["user_hops"] = """
  SELECT user_id, m, min(m) OVER (PARTITION BY user_id ORDER BY m RANGE BETWEEN 21601 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM user_top_set"""
PARTS["user_anchors"] = """
  SELECT user_id, min(m) AS a FROM user_top_set GROUP BY 1
  UNION ALL SELECT h.user_id, h.nxt FROM user_anchors x JOIN user_hops h ON h.m = x.a AND h.user_id = x.user_id WHERE h.nxt IS NOT NULL"""
add("g2_anchored_sessions_by_user", """
  SELECT t.user_id, t.line_id, t.sec, a.a AS session_id
  FROM user_tops t ASOF JOIN user_anchors a ON t.user_id = a.user_id AND t.m >= a.a""")


def _gap_chunk(keys: str, interval: int) -> str:
    """Session ids by gap and chunk with plain windows; ``keys`` is empty or ends in a comma."""
    part = f"PARTITION BY {keys[:-1]}" if keys else ""
    part_group = f"PARTITION BY {keys} g"
    cut = keys[:-1] + "," if keys else ""
    return f"""
  SELECT {cut} line_id, CAST(dense_rank() OVER ({part} ORDER BY g, c) AS BIGINT) AS session_id FROM (
    SELECT {cut} line_id, g, (s - min(s) OVER ({part_group})) // {interval} AS c FROM (
      SELECT {cut} line_id, s, sum(o) OVER ({part} ORDER BY s, line_id) AS g FROM (
        SELECT {cut} line_id, s, CAST(coalesce(s - lag(s) OVER ({part} ORDER BY s, line_id), 0) > {interval} AS INTEGER) AS o
        FROM (SELECT {cut} line_id, epoch_us(ts) // 1000000 AS s FROM log_events))))"""


add("g3_gap_chunk_sessions", _gap_chunk("", 600))
add("g3_gap_chunk_sessions_by_user", _gap_chunk("user_id,", 36000))
add("g4_whole_log_session", """
  SELECT 'all' AS session_id, row_number() OVER (ORDER BY line_id) - 1 AS pos, line_id, template, label FROM log_events""")
PARTS["entity_rolled"] = """
  SELECT session_id, count(*) AS length, CAST(max(label) > 0 AS INTEGER) AS label, min(line_id) AS first_line FROM entity_log GROUP BY 1"""
add("g5_session_rollup", "SELECT session_id, length, label, first_line FROM entity_rolled")

# ---- splits ---------------------------------------------------------------------------------


def _split(source: str, order: str, train: str, test: str) -> str:
    return f"""
  SELECT * EXCLUDE (r, n) FROM (
    SELECT *, CASE WHEN r <= CAST(trunc({train} * n) AS BIGINT) THEN 'train'
                   WHEN r > n - CAST(trunc({test} * n) AS BIGINT) THEN 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS r, count(*) OVER () AS n FROM {source})) WHERE split IS NOT NULL"""


SHUFFLED = "md5('42:' || session_id), session_id"
PARTS["entity_split"] = _split("entity_rolled", SHUFFLED, "CAST(1 - 0.2::DOUBLE AS DOUBLE)", "0.2::DOUBLE")
add("t1_session_split_random", "SELECT session_id, split FROM entity_split")
add("t1_session_split_ordered", f"""
  SELECT session_id, split FROM ({_split("entity_rolled", "first_line, session_id", "0.5::DOUBLE", "0.3::DOUBLE")})""")
UNIT = "CAST(('0x' || substr(md5('7:' || {key}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
add("t2_anomaly_sampling", f"""
  SELECT s.session_id, s.split, b.label FROM entity_split s JOIN block_labels b ON b.entity_id = s.session_id
  WHERE s.split = 'test' OR b.label = 0 OR {UNIT.format(key='s.session_id')} < 0.5""")


def _line_split(order: str, train: str) -> str:
    kept = f"""SELECT * FROM ({_split("(SELECT line_id, template, label FROM log_events)", order, train, "0.6::DOUBLE")})
      WHERE split = 'test' OR label = 0 OR {UNIT.format(key='line_id')} < 0.25"""
    return f"""
  SELECT split, 'all' AS session_id, row_number() OVER (PARTITION BY split ORDER BY line_id) - 1 AS pos, line_id, template, label
  FROM ({kept}) WHERE split = 'train' OR label = 1 OR template IN (SELECT template FROM ({kept}) WHERE split = 'train')"""


PARTS["ordered_lines"] = _line_split("line_id", "CAST(1 - 0.6::DOUBLE AS DOUBLE)")
add("t3_line_split", "SELECT * FROM ordered_lines")
add("t3_line_split_random", _line_split("md5('42:' || line_id), line_id", "0.3::DOUBLE"))
add("t4_split_report", """
  SELECT split, count(*) AS n, round(100 * avg(CAST(label > 0 AS INTEGER)), 6) AS anomaly_pct
  FROM user_split WHERE split IS NOT NULL GROUP BY 1""")
add("t4_line_split_report", """
  SELECT split, count(*) AS n, round(100 * avg(label), 6) AS anomaly_pct FROM ordered_lines GROUP BY 1""")

# ---- vocabularies ---------------------------------------------------------------------------

PARTS["doc_firsts"] = "SELECT template, min(line_id) AS f FROM log_docs GROUP BY 1"
PARTS["doc_vocab"] = """
  SELECT template, CAST(row_number() OVER (ORDER BY f, template) + 1 AS INTEGER) AS template_id FROM doc_firsts"""
add("v1_template_vocabulary", "SELECT template, template_id FROM doc_vocab")
PARTS["event_ids"] = """
  SELECT template, CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS ID
  FROM (SELECT template, min(line_id) AS f FROM log_events GROUP BY 1)"""
add("v2_first_seen_ids", "SELECT template, ID FROM event_ids")
PARTS["prior_ids"] = """
  SELECT template, CAST(row_number() OVER (ORDER BY f, template) AS INTEGER) AS ID
  FROM (SELECT template, min(line_id) AS f FROM log_docs WHERE doc_id % 2 = 0 GROUP BY 1)"""
add("v2_first_seen_ids_continued", """
  SELECT template, ID FROM prior_ids
  UNION ALL
  SELECT template, CAST(row_number() OVER (ORDER BY f, template) + (SELECT max(ID) FROM prior_ids) AS INTEGER)
  FROM doc_firsts WHERE template NOT IN (SELECT template FROM prior_ids)""")
add("v3_tokens", f"SELECT line_id, array_to_string({TOKENS.format(text='content')}, ',') AS tokens FROM log_docs")
add("v4_token_vocabulary", "SELECT token, token_id, n FROM token_vocab2")
add("v5_metadata", """
  SELECT 'next_log' AS label_type, 'sequentials' AS feature_type, t AS num_labels, t AS vocab_size
  FROM (SELECT count(*) + 2 AS t FROM doc_templates)
  UNION ALL SELECT 'next_log', 'semantics', (SELECT count(*) + 2 FROM doc_templates), (SELECT count(*) + 2 FROM token_vocab1)
  UNION ALL SELECT 'anomaly', 'sequentials', 2, (SELECT count(*) + 2 FROM doc_templates)""")

# ---- windows --------------------------------------------------------------------------------

PARTS["log_vocab"] = """
  SELECT template, CAST(row_number() OVER (ORDER BY f) + 1 AS INTEGER) AS template_id
  FROM (SELECT template, min(line_id) AS f FROM log_events GROUP BY 1)"""


def _windows(source: str, size: int, stride: int, extra: str = "") -> str:
    """Windows of ``source(session_id, pos, template, template_id, label)`` with list functions."""
    lists = f"""SELECT session_id, list(template ORDER BY pos) AS ts, list(template_id ORDER BY pos) AS ids,
      list(CASE WHEN label > 0 THEN template_id ELSE 0 END ORDER BY pos) AS cls, list(label ORDER BY pos) AS labels{extra},
      count(*) AS n FROM {source} GROUP BY 1"""
    starts = f"""SELECT *, unnest(range(0, CAST(ceil(greatest(n - {size}, 0) / {stride}::DOUBLE) AS BIGINT) * {stride} + 1, {stride})) AS i
      FROM ({lists})"""
    return f"""
  SELECT *, i // {stride} AS window_idx, i + {size} < n AS is_full,
         CASE WHEN i + {size} < n THEN {size} ELSE greatest(n - 1 - i, 0) END AS len,
         CASE WHEN i + {size} < n THEN ids[i + {size} + 1] ELSE ids[n] END AS next_id,
         CAST(list_contains(labels[i + 1:i + {size} + 1], 1) AS INTEGER) AS anomaly FROM ({starts})"""


def _padded(column: str, size: int, filler: str) -> str:
    return f"list_concat({column}[i + 1:i + len], list_transform(range(CAST({size} - len AS BIGINT)), lambda x: {filler}))"


PARTS["entity_coded"] = "SELECT e.*, v.template_id FROM entity_lines e JOIN log_vocab v USING (template)"
for step in (STRIDE, 3, 4):
    PARTS[f"entity_windows{step}"] = _windows("entity_coded", SIZE, step)
IDS = f"array_to_string({_padded('ids', SIZE, '1')}, ',')"
CLASSES = f"array_to_string({_padded('cls', SIZE, '0')}, ',')"
add("s8_feature_cache", f"SELECT session_id, window_idx, {IDS} AS ids, next_id, anomaly FROM entity_windows1")
WINDOW_TEXT = "array_to_string({}, ',') AS \"window\""
add("w1_sliding_windows", f"""
  SELECT session_id, window_idx, {WINDOW_TEXT.format(_padded('ts', SIZE, "'PADDING'"))}, next_id FROM entity_windows1""")
PARTS["conv_vocab"] = """
  SELECT template, CAST(row_number() OVER (ORDER BY f, template) + 1 AS INTEGER) AS template_id
  FROM (SELECT template, min(line_id) AS f FROM conv_log GROUP BY 1)"""
PARTS["conv_coded"] = "SELECT c.*, v.template_id FROM conv_log c JOIN conv_vocab v USING (template)"
PARTS["conv_windows"] = _windows("conv_coded", 3, 5)
add("w1_short_sessions", f"""
  SELECT session_id, window_idx, {WINDOW_TEXT.format(_padded('ts', 3, "'PADDING'"))}, next_id, anomaly,
         array_to_string({_padded('cls', 3, '0')}, ',') AS an_classes FROM conv_windows""")
add("w2_window_anomaly", "SELECT session_id, window_idx, anomaly FROM entity_windows3")
add("w3_window_classes", f"SELECT session_id, window_idx, {CLASSES} AS an_classes FROM entity_windows1")
add("w3_window_classes_compat", f"""
  SELECT session_id, window_idx, array_to_string(CASE WHEN is_full THEN cls[i + 1:i + {SIZE}]
    ELSE list_concat(cls[1:greatest(n - i, 0)], list_transform(range(CAST({SIZE} - greatest(n - i, 0) AS BIGINT)), lambda x: 1)) END, ',') AS an_classes
  FROM entity_windows4""")
PARTS["item_vocab"] = """
  SELECT template, CAST(row_number() OVER (ORDER BY f) + 1 AS INTEGER) AS template_id
  FROM (SELECT template, min(line_id) AS f FROM item_log GROUP BY 1)"""
PARTS["item_coded"] = """
  SELECT i.*, v.template_id, row_number() OVER (PARTITION BY session_id ORDER BY line_id) - 1 AS pos
  FROM item_log i JOIN item_vocab v USING (template)"""
PARTS["item_windows5"] = _windows("item_coded", SIZE, 5)
PARTS["item_windows1"] = _windows("item_coded", SIZE, STRIDE)
add("w1_supplier_windows", f"SELECT session_id, window_idx, {IDS} AS ids, next_id, anomaly FROM item_windows5")
PARTS["user_all"] = """
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_id) - 1 AS pos FROM user_log"""
add("w4_session_windows", """
  SELECT session_id, 0::BIGINT AS window_idx, u.pos, u.template, v.template_id, CAST(CASE WHEN u.label > 0 THEN v.template_id ELSE 0 END AS INTEGER) AS an_class,
         count(*) OVER (PARTITION BY session_id) AS length, max(u.label) OVER (PARTITION BY session_id) AS window_label,
         max(u.label) OVER (PARTITION BY session_id) AS anomaly
  FROM user_all u JOIN log_vocab v USING (template)""")


def _frames(start_filter: str) -> str:
    return f"""
  SELECT g AS "group", i // 3 AS frame_idx,
         array_to_string(list_concat(ids[i + 1:i + 10], list_transform(range(CAST(greatest(i + 10 - n, 0) AS BIGINT)), lambda x: 0)), ',') AS "window",
         array_to_string(list_concat(labels[i + 1:i + 10], list_transform(range(CAST(greatest(i + 10 - n, 0) AS BIGINT)), lambda x: 0)), ',') AS labels
  FROM (SELECT *, unnest(range(0, n, 3)) AS i
        FROM (SELECT user_id AS g, list(ID ORDER BY line_id) AS ids, list(label ORDER BY line_id) AS labels, count(*) AS n
              FROM log_events JOIN event_ids USING (template) GROUP BY 1))
  WHERE i = 0 OR (n >= 10 {start_filter})"""


add("w5_frame_windows", _frames(""))
add("w5_frame_windows_compat", _frames("AND i + 1 < 10"))
PARTS["entity_index"] = """
  SELECT session_id, CAST(row_number() OVER (ORDER BY first_line, session_id) - 1 AS BIGINT) AS session_idx FROM entity_rolled"""
add("w6_samples", f"""
  SELECT x.session_idx, w.window_idx, {IDS} AS ids, w.next_id, w.anomaly, {CLASSES} AS an_classes
  FROM entity_windows1 w JOIN entity_index x USING (session_id)""")
# The whole log as one list is too long to slice ten thousand times; the windows are taken as row frames.
PARTS["whole_rows"] = f"""
  SELECT row_number() OVER (ORDER BY line_id) - 1 AS i, count(*) OVER () AS n,
         max(label) OVER (ORDER BY line_id ROWS BETWEEN CURRENT ROW AND {SIZE} FOLLOWING) AS anomaly FROM log_events"""
add("w7_window_report", f"""
  SELECT count(*) AS windows, round(avg(anomaly), 6) AS anomalous_share FROM whole_rows WHERE i <= greatest(n - {SIZE}, 0)""")

PARTS["item_rows"] = f"""
  SELECT row_number() OVER (ORDER BY line_id) - 1 AS i, count(*) OVER () AS n,
         max(label) OVER (ORDER BY line_id ROWS BETWEEN CURRENT ROW AND {SIZE} FOLLOWING) AS anomaly FROM item_log"""
add("w7_long_window_report", f"""
  SELECT count(*) AS windows, round(avg(anomaly), 6) AS anomalous_share FROM item_rows WHERE i <= greatest(n - {SIZE}, 0)""")

# ---- features -------------------------------------------------------------------------------

PARTS["test_lines"] = "SELECT * FROM coded_lines WHERE split = 'test'"
PARTS["train_lines"] = "SELECT * FROM coded_lines WHERE split = 'train'"
PARTS["test_windows"] = _windows("test_lines", SIZE, STRIDE)
PARTS["train_windows"] = _windows("train_lines", SIZE, STRIDE)
add("f1_sequential", f"SELECT session_id, window_idx, {IDS} AS features FROM test_windows")
PARTS["test_filled"] = f"SELECT *, {_padded('ids', SIZE, '1')} AS filled FROM test_windows"
PARTS["vocab_ids"] = "SELECT unnest(range(1, (SELECT count(*) + 2 FROM train_vocab))) AS k"
add("f2_quantitative", """
  SELECT session_id, window_idx, string_agg(CAST(len(list_filter(filled, lambda z: z = k)) AS VARCHAR), ',' ORDER BY k) AS features
  FROM test_filled, vocab_ids GROUP BY session_id, window_idx""")
add("a1_feature_extractor", """
  SELECT session_id, window_idx, string_agg(CAST(len(list_filter(filled, lambda z: z = k)) AS VARCHAR), ',' ORDER BY k) AS features,
         next_id, anomaly
  FROM test_filled, vocab_ids GROUP BY session_id, window_idx, next_id, anomaly""")
for least in (1, 2):
    PARTS[f"template_ids_{least}"] = f"""
  SELECT t.template, coalesce(w.ids, []) AS token_ids
  FROM doc_templates t LEFT JOIN (
    SELECT w.template, list(coalesce(v.token_id, 1) ORDER BY w.token_pos) AS ids
    FROM template_words w LEFT JOIN token_vocab{least} v USING (token) GROUP BY 1) w USING (template)"""
add("f3_template_token_ids", "SELECT template, array_to_string(token_ids, ',') AS token_ids FROM template_ids_2")
PARTS["doc_coded"] = """
  SELECT CAST(d.doc_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY d.line_id) - 1 AS pos,
         d.template, v.template_id, 0 AS label, array_to_string(t.token_ids, ' ') AS toks
  FROM log_docs d JOIN doc_vocab v USING (template) JOIN template_ids_2 t USING (template)"""
PARTS["doc_windows"] = _windows("doc_coded", 3, 2, ", list(toks ORDER BY pos) AS toks")
add("f3_window_token_ids", f"""
  SELECT session_id, window_idx, array_to_string({_padded('toks', 3, "''")}, ',') AS token_ids, next_id FROM doc_windows""")


def _tfidf(train_filter: str, tokens_of: str) -> str:
    total = f"(SELECT count(*) FROM log_docs {train_filter})"
    idf = f"""SELECT token, ln((1 + {total}) / (1 + sum(lines))::DOUBLE) + 1 AS idf FROM (
        SELECT DISTINCT template, lines, unnest({tokens_of}) AS token
        FROM (SELECT template, count(*) AS lines FROM log_docs {train_filter} GROUP BY 1)) GROUP BY 1"""
    return f"""
  SELECT template, token_id, raw / sum(raw) OVER (PARTITION BY template) AS weight FROM (
    SELECT t.template, v.token_id, t.tf * coalesce(i.idf, ln((1 + {total})::DOUBLE) + 1) AS raw
    FROM (SELECT template, token, count(*) AS tf FROM (SELECT template, unnest({tokens_of}) AS token FROM doc_templates) GROUP BY 1, 2) t
    JOIN token_vocab1 v USING (token) LEFT JOIN ({idf}) i USING (token))"""


PARTS["doc_tfidf"] = _tfidf("", TOKENS.format(text="template"))
add("f4_tfidf", "SELECT md5(template) AS template_md5, token_id, round(weight, 6) AS weight FROM doc_tfidf")
add("f4_tfidf_lower_first", f"""
  SELECT md5(template) AS template_md5, token_id, round(weight, 6) AS weight FROM ({_tfidf("WHERE doc_id % 2 = 0", TOKENS.format(text="lower(template)"))})""")
add("f5_word_vectors", """
  SELECT token_id, token, round(sum(v * v), 6) AS squared_length FROM vector_dims GROUP BY 1, 2""")

# Pairs of tokens at most two places apart, from both sides.
PARTS["doc_words"] = f"""
  SELECT t, count(*) AS w FROM (SELECT template, {TOKENS.format(text="template")} AS t FROM log_docs) GROUP BY template, t"""
PARTS["doc_pairs"] = """
  SELECT t[i] AS a, t[i + d] AS b, sum(w) AS n
  FROM (SELECT t, w, unnest(range(1, len(t) + 1)) AS i FROM doc_words), (SELECT unnest([1, 2]) AS d) WHERE i + d <= len(t) GROUP BY 1, 2"""
PARTS["near_tokens"] = """
  SELECT token, near, CAST(sum(n) AS BIGINT) AS n FROM (SELECT a AS token, b AS near, n FROM doc_pairs UNION ALL SELECT b, a, n FROM doc_pairs) GROUP BY 1, 2"""


def _information(least: int) -> str:
    """Positive pointwise mutual information of the pairs that occur so often."""
    return f"""SELECT token, near, n, ln(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY token)::DOUBLE * sum(n) OVER (PARTITION BY near))) AS ppmi
      FROM near_tokens WHERE n >= {least}"""


add("f5_mutual_information", f"SELECT token, near, n, round(ppmi, 6) AS ppmi FROM ({_information(5)}) WHERE ppmi > 0")
add("f6_learned_vectors", f"""
  SELECT token, round(sum(ppmi * ppmi), 4) AS squared_length, 1 AS "within" FROM ({_information(200)}) WHERE ppmi > 0 GROUP BY 1""")
PARTS["template_vectors"] = """
  SELECT t.template, d.dim, sum(d.v) AS value
  FROM (SELECT template, unnest(CASE WHEN len(token_ids) = 0 THEN [0] ELSE token_ids END) AS token_id FROM template_ids_1) t JOIN vector_dims d USING (token_id) GROUP BY 1, 2"""
add("f6_summed_embedding", "SELECT md5(template) AS template_md5, dim, round(value, 6) AS value FROM template_vectors")
add("f7_weighted_embedding", """
  SELECT md5(t.template) AS template_md5, d.dim, round(sum(t.weight * d.v), 6) AS value
  FROM doc_tfidf t JOIN vector_dims d USING (token_id) GROUP BY t.template, d.dim""")
PARTS["doc_positions"] = """
  SELECT CAST(doc_id AS VARCHAR) AS session_id, template, row_number() OVER (PARTITION BY doc_id ORDER BY line_id) - 1 AS pos,
         count(*) OVER (PARTITION BY doc_id) AS n FROM log_docs"""
# Windows of four lines every four lines: a line sits in window pos // 4, unless it is the last line of the
# session, which no tail window holds. When the rest after a full window is empty, the tail has zeros only.
PARTS["pooled_windows"] = """
  SELECT DISTINCT session_id, unnest(range(0, CAST(ceil(greatest(n - 4, 0) / 4.0) AS BIGINT) + 1)) AS window_idx FROM doc_positions"""
add("f8_mean_pooled", """
  SELECT w.session_id, w.window_idx, CAST(k.dim AS INTEGER) AS dim, round(coalesce(sum(v.value), 0) / 4, 6) AS value
  FROM pooled_windows w CROSS JOIN (SELECT unnest(range(64)) AS dim) k
  LEFT JOIN doc_positions p ON p.session_id = w.session_id AND p.pos // 4 = w.window_idx AND (p.pos < p.n - 1)
  LEFT JOIN template_vectors v ON v.template = p.template AND v.dim = k.dim
  GROUP BY 1, 2, 3""")

PARTS["time_log"] = """
  SELECT CAST(a.a AS VARCHAR) AS session_id, t.line_id, e.template, e.label
  FROM tops t ASOF JOIN anchors a ON t.m >= a.a JOIN log_events e ON e.line_id = t.line_id"""
PARTS["time_split"] = _split(
    "(SELECT session_id, min(line_id) AS f FROM time_log GROUP BY 1)", SHUFFLED, "CAST(1 - 0.2::DOUBLE AS DOUBLE)", "0.2::DOUBLE")
PARTS["time_vocab"] = """
  SELECT template, CAST(row_number() OVER (ORDER BY f, template) + 1 AS INTEGER) AS template_id
  FROM (SELECT template, min(line_id) AS f FROM time_log JOIN time_split USING (session_id) WHERE split = 'train' GROUP BY 1)"""
PARTS["time_coded"] = """
  SELECT l.*, coalesce(v.template_id, 1) AS template_id, row_number() OVER (PARTITION BY l.session_id ORDER BY l.line_id) - 1 AS pos
  FROM time_log l JOIN time_split s USING (session_id) LEFT JOIN time_vocab v USING (template) WHERE s.split = 'test'"""
PARTS["time_windows"] = _windows("time_coded", SIZE, 5)
add("a4_time_session_samples", f"SELECT session_id, window_idx, {IDS} AS features, next_id, anomaly FROM time_windows")

# ---- detectors ------------------------------------------------------------------------------

CONTEXT = "array_to_string(ids[i + 1:i + len][greatest(len - {last} + 1, 1):len], ' ')"
def _top(windows: str, order: int = ORDER) -> str:
    """The first K next events of each context, of every length, in ``windows``."""
    contexts = " UNION ALL ".join(
        f"SELECT {CONTEXT.format(last=m)} AS context, next_id FROM {windows} WHERE len >= {m}" if m else
        f"SELECT '' AS context, next_id FROM {windows}" for m in range(order + 1))
    return f"""
  SELECT context, array_to_string(list(next_id ORDER BY r), ',') AS topk, list(next_id ORDER BY r) AS tops
  FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, next_id) AS r
        FROM (SELECT context, next_id, count(*) AS n FROM ({contexts}) GROUP BY 1, 2)) WHERE r <= {K} GROUP BY 1"""


PARTS["context_top"] = _top("train_windows")
add("d1_supplier_model", f"SELECT context, topk FROM ({_top('item_windows1')})")
add("d1_next_event_model", "SELECT context, topk FROM context_top")
PARTS["tries"] = " UNION ALL ".join(
    f"SELECT session_id, window_idx, {m} AS used, " + (CONTEXT.format(last=m) if m else "''") + f" AS context FROM test_windows WHERE len >= {m}"
    for m in range(ORDER + 1))
PARTS["picked"] = """
  SELECT session_id, window_idx, arg_max(m.tops, used) AS tops, arg_max(m.topk, used) AS topk
  FROM tries t JOIN context_top m USING (context) GROUP BY 1, 2"""

# The suffix tree: counts of all contexts, what each explains beyond its parent, and the nodes that stay with those before them.
PARTS["all_contexts"] = "SELECT m, context, next_id, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT {m} AS m, " + (CONTEXT.format(last=m) if m else "''") + f" AS context, next_id FROM train_windows WHERE len >= {m}"
    for m in range(SIZE + 1)) + ") GROUP BY ALL"
_PARENT = "CASE WHEN contains(context, ' ') THEN substr(context, strpos(context, ' ') + 1) ELSE '' END"
PARTS["seen_contexts"] = f"""
  SELECT *, CASE WHEN m > 0 THEN {_PARENT} END AS parent, sum(n) OVER (PARTITION BY context) AS total, count(*) OVER (PARTITION BY context) AS kinds
  FROM all_contexts"""
PARTS["context_gains"] = """
  SELECT c.context, sum(c.n * ln((c.n / c.total) / (p.n / p.total))) AS gain
  FROM seen_contexts c JOIN seen_contexts p ON c.parent = p.context AND c.next_id = p.next_id GROUP BY 1"""
PARTS["tree_contexts"] = f"""
  SELECT context FROM context_gains, (SELECT sum(n * ln(total / n)) AS whole FROM seen_contexts WHERE m = 0)
  WHERE gain >= {TREE_SHARE}::DOUBLE * whole AND gain > 0 UNION SELECT {_PARENT} FROM tree_contexts WHERE context <> ''"""
PARTS["tree_nodes"] = """
  SELECT DISTINCT m, context, parent, total, kinds FROM seen_contexts WHERE m = 0 OR context IN (SELECT context FROM tree_contexts)"""
PARTS["tree_level0"] = "SELECT context, next_id, n / total AS p FROM seen_contexts WHERE m = 0"
for m in range(1, SIZE + 1):
    PARTS[f"tree_level{m}"] = f"""
  SELECT t.context, l.next_id, (coalesce(s.n, 0) + t.kinds * l.p) / (t.total + t.kinds) AS p
  FROM tree_nodes t JOIN tree_level{m - 1} l ON t.parent = l.context LEFT JOIN all_contexts s ON s.context = t.context AND s.next_id = l.next_id
  WHERE t.m = {m}"""
PARTS["tree_top"] = f"""
  SELECT context, array_to_string(list(next_id ORDER BY r), ',') AS topk, list(next_id ORDER BY r) AS tops
  FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY p DESC, next_id) AS r
        FROM ({" UNION ALL ".join(f"SELECT * FROM tree_level{m}" for m in range(SIZE + 1))})) WHERE r <= {K} GROUP BY 1"""
add("d1_suffix_tree", "SELECT context, topk FROM tree_top")
PARTS["tree_tries"] = " UNION ALL ".join(
    f"SELECT session_id, window_idx, next_id, {m} AS used, " + (CONTEXT.format(last=m) if m else "''") + f" AS context FROM test_windows WHERE len >= {m}"
    for m in range(SIZE + 1))
PARTS["tree_picked"] = """
  SELECT session_id, window_idx, any_value(next_id) AS next_id, arg_max(m.tops, used) AS tops FROM tree_tries JOIN tree_top m USING (context) GROUP BY 1, 2"""
add("d1_suffix_tree_hits", f"""
  SELECT model, CAST(k AS INTEGER) AS k, count(*) FILTER (hit BETWEEN 1 AND k) AS hits, count(*) AS windows
  FROM (SELECT 'tree' AS model, coalesce(list_position(tops, next_id), 0) AS hit FROM tree_picked
        UNION ALL SELECT 'order', coalesce(list_position(tops, next_id), 0) FROM picked JOIN test_windows USING (session_id, window_idx)),
       (SELECT unnest(range(1, {K + 1})) AS k) GROUP BY 1, 2""")
PARTS["scored"] = """
  SELECT w.session_id, w.window_idx, w.next_id, w.anomaly, w.cls, w.i, w.len, p.topk,
         CAST(coalesce(list_position(p.tops, w.next_id), 0) AS INTEGER) AS hit_rank
  FROM test_windows w JOIN picked p USING (session_id, window_idx)"""
for name in ("d5_batch_scoring", "d6_saved_model"):
    add(name, "SELECT session_id, window_idx, next_id, topk FROM scored")
PARTS["cuts"] = f"SELECT CAST(unnest(range(1, {K + 1})) AS INTEGER) AS k"
PARTS["flags"] = """
  SELECT s.*, c.k, CAST(hit_rank = 0 OR hit_rank > c.k AS INTEGER) AS flag FROM scored s, cuts c"""
PARTS["rolled"] = """
  SELECT session_id, k, CAST(sum(flag) > 0 AS INTEGER) AS pred, CAST(sum(anomaly) > 0 AS INTEGER) AS truth FROM flags GROUP BY 1, 2"""


def _metrics(source: str) -> str:
    return f"""
  SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
         CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS rc,
         CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS pc, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS acc
  FROM (SELECT k, CAST(sum(CAST(pred = 1 AND truth = 1 AS INTEGER)) AS BIGINT) AS tp,
               CAST(sum(CAST(pred = 1 AND truth = 0 AS INTEGER)) AS BIGINT) AS fp,
               CAST(sum(CAST(pred = 0 AND truth = 1 AS INTEGER)) AS BIGINT) AS fn,
               CAST(sum(CAST(pred = 0 AND truth = 0 AS INTEGER)) AS BIGINT) AS tn FROM {source} GROUP BY 1)"""


PARTS["measured"] = _metrics("rolled")
SCORES = "round(f1, 6)::DOUBLE AS f1, round(rc, 6)::DOUBLE AS rc, round(pc, 6)::DOUBLE AS pc"
ACC = "round(acc, 6)::DOUBLE AS acc"
PARTS["patience"] = """
  SELECT *, max(CASE WHEN best IS NULL OR f1 > best THEN k END) OVER (ORDER BY k) AS last
  FROM (SELECT *, max(f1) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM measured)"""
PARTS["patient"] = """
  SELECT * FROM patience WHERE k <= coalesce((SELECT min(k) FROM patience WHERE k - last >= 2), 1000000)"""
add("d7_best_candidate", """
  SELECT k AS candidate, round(f1, 6)::DOUBLE AS f1, (SELECT max(k) FROM patient) AS stopped_at FROM patient
  ORDER BY patient.f1 DESC, k LIMIT 1""")

# ---- evaluation -----------------------------------------------------------------------------

add("e1_hit_flags", "SELECT session_id, window_idx, k, hit_rank, flag FROM flags")
add("e2_sum_rollup", "SELECT session_id, k, pred, truth FROM rolled")
PARTS["user_max"] = """
  SELECT user_id AS session_id, max(value) AS score, CAST(max(label) > 0 AS INTEGER) AS truth FROM log_events GROUP BY 1"""
add("e3_max_rollup", "SELECT * FROM user_max")
add("e4_percentile_flags", """
  SELECT user_id AS session_id, line_id AS window_idx, value AS score,
         CAST(value > (SELECT quantile_cont(score, 0.97) FROM user_max) AS INTEGER) AS pred FROM log_events""")
add("e4_percentile", " UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS p, round(quantile_cont(value, {p}), 6)::DOUBLE AS threshold FROM log_events" for p in (0.03, 0.2, 0.5, 0.97)))
add("e5_binary_metrics", f"SELECT k, tp, fp, fn, tn, {SCORES}, {ACC} FROM measured")
add("a4_next_event_detection", f"SELECT k, {SCORES}, {ACC} FROM measured")
PARTS["window_cases"] = "SELECT k, flag AS pred, anomaly AS truth FROM flags"
add("e5_window_metrics", f"SELECT k, tp, fp, fn, tn, {SCORES}, {ACC} FROM ({_metrics('window_cases')})")
add("e6_best_k", f"SELECT k, {SCORES} FROM measured ORDER BY measured.f1 DESC, k DESC LIMIT 1")
add("e7_normal_window_share", "SELECT round(1 - avg(anomaly), 6) AS normal_window_share FROM test_windows")
PARTS["class_lines"] = f"""
  SELECT k, flag, unnest({_padded('cls', SIZE, '0')}) AS real FROM flags WHERE k IN (1, {K})"""
PARTS["class_pairs"] = "SELECT k, real, CASE WHEN flag = 1 THEN real ELSE 0 END AS guess FROM class_lines"
PARTS["class_sums"] = """
  SELECT k, c, sum(sup) AS support, sum(pre) AS predicted, sum(tp) AS tp FROM (
    SELECT k, real AS c, 1 AS sup, 0 AS pre, CAST(real = guess AS INTEGER) AS tp FROM class_pairs
    UNION ALL SELECT k, guess, 0, 1, 0 FROM class_pairs) GROUP BY 1, 2"""
PARTS["class_scores"] = """
  SELECT k, c, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted,
         CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END AS f1,
         CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS rc,
         CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS pc FROM class_sums"""
add("e8_class_report", f'SELECT c AS "class", support, predicted, {SCORES} FROM class_scores WHERE k = 1')
add("e8_macro_average", """
  SELECT k, round(avg(f1), 6)::DOUBLE AS f1, round(avg(rc), 6)::DOUBLE AS rc, round(avg(pc), 6)::DOUBLE AS pc,
         CAST(sum(support) AS BIGINT) AS support FROM class_scores GROUP BY 1""")
add("e9_class_counts", 'SELECT c AS "class", predicted, support AS actual FROM class_scores WHERE k = 1')
add("e9_line_counts", """
  SELECT (SELECT CAST(sum(flag) AS BIGINT) FROM flags WHERE k = 1) AS flagged_windows, (SELECT count(*) FROM flags WHERE k = 1) AS windows,
         CAST(sum(CAST(guess > 0 AS INTEGER)) AS BIGINT) AS predicted_lines, CAST(sum(CAST(real > 0 AS INTEGER)) AS BIGINT) AS anomalous_lines,
         count(*) AS lines FROM class_pairs WHERE k = 1""")

# ---- ml surface -----------------------------------------------------------------------------

PARTS["timed_ids"] = _gap_chunk("", 3600)
PARTS["timed_rows"] = """
  SELECT t.session_id AS g, e.ID AS id, l.label, l.line_id FROM log_events l
  JOIN timed_ids t USING (line_id) JOIN event_ids e USING (template)"""
add("a2_transformer_chain", """
  SELECT g AS "group", i AS frame_idx,
         array_to_string(list_concat(ids[i + 1:i + 5], list_transform(range(CAST(greatest(i + 5 - n, 0) AS BIGINT)), lambda x: 0)), ',') AS "window",
         array_to_string(list_concat(labels[i + 1:i + 5], list_transform(range(CAST(greatest(i + 5 - n, 0) AS BIGINT)), lambda x: 0)), ',') AS labels
  FROM (SELECT *, unnest(range(0, n)) AS i
        FROM (SELECT g, list(id ORDER BY line_id) AS ids, list(label ORDER BY line_id) AS labels, count(*) AS n FROM timed_rows GROUP BY 1))
  WHERE i = 0 OR i + 5 <= n""")

# ---- what fits must agree with --------------------------------------------------------------

PARTS["test_counts"] = """
  SELECT session_id, window_idx, anomaly, id AS template_id, CAST(count(*) AS INTEGER) AS n
  FROM (SELECT session_id, window_idx, anomaly, unnest(filled) AS id FROM test_filled) GROUP BY ALL"""
add("d6_model_registry", """
  SELECT unnest(['next_event', 'classifier', 'directions']) AS kind, 2 AS version, count(*) AS equal_scores FROM test_windows""")
add("d2_best_threshold", """
  SELECT value AS threshold, round(CASE WHEN tp > 0 THEN 2 * tp / (flagged + (SELECT sum(label) FROM log_events)) ELSE 0.0 END, 6) AS f1
  FROM (SELECT value, sum(sum(label)) OVER (ORDER BY value DESC) AS tp, sum(count(*)) OVER (ORDER BY value DESC) AS flagged FROM log_events GROUP BY 1)
  ORDER BY CASE WHEN tp > 0 THEN 2 * tp / (flagged + (SELECT sum(label) FROM log_events)) ELSE 0.0 END DESC, value DESC LIMIT 1""")
add("d2_window_classifier", """
  SELECT *, (SELECT round(avg(anomaly), 3) FROM train_windows) AS mean_train_score FROM test_counts""")
PARTS["train_filled"] = f"SELECT *, {_padded('ids', SIZE, '1')} AS filled FROM train_windows"


def _patterns(source: str) -> str:
    """Distinct runs of two to four ids in each window."""
    runs = " UNION ALL ".join(
        f"SELECT session_id, window_idx, anomaly, array_to_string(filled[j:j + {n - 1}], ' ') AS pattern "
        f"FROM {source}, (SELECT unnest(range(1, {SIZE - n + 2})) AS j)" for n in (2, 3, 4))
    return f"SELECT DISTINCT * FROM ({runs})"


PARTS["train_patterns"] = _patterns("train_filled")
PARTS["test_patterns"] = _patterns("test_filled")
PARTS["pattern_ids"] = """
  SELECT pattern, CAST(row_number() OVER (ORDER BY md5('42:' || pattern), pattern) - 1 AS INTEGER) AS pattern_id
  FROM (SELECT DISTINCT pattern FROM train_patterns)"""
add("d3_pattern_classifier", """
  SELECT session_id, window_idx, anomaly, pattern_id FROM test_patterns JOIN pattern_ids USING (pattern)""")


def _runs(source: str) -> str:
    """Distinct runs of two to four events in each window, without its filler."""
    runs = " UNION ALL ".join(
        f"SELECT session_id, window_idx, anomaly, {n} AS width, array_to_string(ids[i + j:i + j + {n - 1}], ' ') AS pattern "
        f"FROM {source}, (SELECT unnest(range(1, {SIZE - n + 2})) AS j) WHERE j + {n - 1} <= len" for n in (2, 3, 4))
    return f"SELECT DISTINCT * FROM ({runs})"


PARTS["train_runs"] = _runs("train_windows")
PARTS["frequent_runs"] = f"""
  SELECT pattern, CAST(width AS INTEGER) AS width, count(*) AS support, CAST(sum(anomaly) AS BIGINT) AS anomalous FROM train_runs
  GROUP BY 1, 2 HAVING count(*) >= {PATTERN_SHARE}::DOUBLE * (SELECT count(*) FROM train_windows)"""
add("d3_frequent_patterns", "SELECT * FROM frequent_runs")
PARTS["told_runs"] = """
  SELECT *, CASE WHEN base > 0 THEN n * x * x / base ELSE 0.0 END AS chi2 FROM (
    SELECT *, anomalous::DOUBLE * ((n - bad) - (support::DOUBLE - anomalous)) - (support::DOUBLE - anomalous) * (bad - anomalous) AS x,
           support::DOUBLE * (n - support) * bad * (n - bad) AS base
    FROM frequent_runs, (SELECT count(*)::DOUBLE AS n, sum(anomaly)::DOUBLE AS bad FROM train_windows))"""
PARTS["best_runs"] = f"""
  SELECT *, row_number() OVER (ORDER BY chi2 DESC, support DESC, pattern) - 1 AS pattern_id FROM told_runs
  ORDER BY chi2 DESC, support DESC, pattern LIMIT {PATTERNS}"""
PARTS["test_runs"] = _runs("test_windows")
add("d3_telling_patterns", """
  SELECT b.pattern, CAST(pattern_id AS INTEGER) AS pattern_id, b.width, support, anomalous, round(chi2, 6) AS chi2,
         coalesce(tw, 0) AS test_windows, coalesce(ta, 0) AS test_anomalous
  FROM best_runs b LEFT JOIN (SELECT pattern, count(*) AS tw, CAST(sum(anomaly) AS BIGINT) AS ta FROM test_runs GROUP BY 1) t USING (pattern)""")
PARTS["id_means"] = """
  SELECT k, (SELECT count(*) FROM (SELECT unnest(filled) AS id FROM train_filled) WHERE id = k) / (SELECT count(*) FROM train_filled)::DOUBLE AS mean
  FROM vocab_ids"""
add("d4_reconstruction_error", """
  SELECT session_id, window_idx, anomaly, round(sum((len(list_filter(filled, lambda z: z = k)) - mean) ** 2) / count(*), 6) AS total,
         0.0::DOUBLE AS rest, 1 AS "between"
  FROM test_filled, id_means GROUP BY 1, 2, 3""")
# The covariance as a list of rows. Squaring it again and again leaves the square of its strongest direction, which is then taken out.
PARTS["covariance"] = """
  SELECT list(line ORDER BY k) AS m FROM (
    SELECT a.k, list(coalesce(s, 0) / n - a.mean * b.mean ORDER BY b.k) AS line
    FROM id_means a CROSS JOIN id_means b CROSS JOIN (SELECT count(*) AS n FROM train_filled)
    LEFT JOIN (
      SELECT x.id AS i, y.id AS j, sum(x.n * y.n) AS s FROM train_cells x JOIN train_cells y USING (session_id, window_idx) GROUP BY 1, 2
    ) ON i = a.k AND j = b.k GROUP BY a.k)"""
PARTS["train_cells"] = """
  SELECT session_id, window_idx, id, count(*) AS n FROM (SELECT session_id, window_idx, unnest(filled) AS id FROM train_filled) GROUP BY ALL"""


def _trace(m: str) -> str:
    return f"list_sum(list_transform({m}, lambda r, i: r[i]))"


def _strongest(source: str) -> str:
    """Thirty squarings of the matrix ``m`` of ``source``, each divided by its trace."""
    return f"""SELECT step + 1 AS step, list_transform(s, lambda r: list_transform(r, lambda x: x / {_trace('s')})) AS m
      FROM (SELECT step, list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q))) AS s FROM {source} WHERE step < 30)"""


def _deflated(m: str, p: str) -> str:
    """The matrix without its part in the direction whose square is ``p``."""
    strength = f"list_sum(list_transform({m}, lambda r, i: list_dot_product(r, {p}[i])))"
    return f"list_transform({m}, lambda r, i: list_transform(r, lambda x, j: x - {strength} * {p}[i][j]))"


for place, before in enumerate(("m0", "m1", "m2"), 1):
    PARTS[f"m{place - 1}"] = "SELECT m FROM covariance" if place == 1 else f"SELECT {_deflated('a.m', 'b.m')} AS m FROM m{place - 2} a, top{place - 1} b"
    PARTS[f"power{place}"] = f"SELECT 0 AS step, m FROM {before} UNION ALL ({_strongest(f'power{place}')})"
    PARTS[f"top{place}"] = f"SELECT m FROM power{place} WHERE step = 30"
PARTS["centred"] = """
  SELECT session_id, window_idx, list(len(list_filter(filled, lambda z: z = k)) - mean ORDER BY k) AS c FROM test_filled, id_means GROUP BY 1, 2"""
_inside = " + ".join(f"list_dot_product(c, list_transform(p{k}.m, lambda r: list_dot_product(r, c)))" for k in (1, 2, 3))
add("d4_main_directions", f"""
  SELECT session_id, window_idx, round(greatest(list_dot_product(c, c) - ({_inside}), 0) / len(c), 6) AS score, round(list_dot_product(c, c) / len(c), 6) AS total
  FROM centred, top1 p1, top2 p2, top3 p3""")
PARTS["test_units"] = """
  SELECT count(*) AS units, CAST(sum(anomaly) AS BIGINT) AS anomalous, 1 AS valid
  FROM (SELECT session_id, max(anomaly) AS anomaly FROM test_windows GROUP BY 1)"""
add("a4_window_classification", "SELECT unnest(['counts', 'patterns']) AS features, * FROM test_units")
add("a4_semantic_classification", "SELECT unnest(['embedding', 'tfidf']) AS features, * FROM test_units")
add("a4_reconstruction_detection", "SELECT * FROM test_units")
add("a4_window_results", f"""
  SELECT count(*) AS units, CAST(sum(anomaly) AS BIGINT) AS anomalous, 1 AS valid, count(*) * {SIZE} AS lines FROM test_windows""")

PARTS["hdfs_log"] = """
  SELECT line_id, ts, template, h.label FROM log_events JOIN line_hits h USING (line_id)"""
PARTS["hdfs_hops"] = """
  SELECT m, min(m) OVER (ORDER BY m RANGE BETWEEN 61 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM top_set"""
PARTS["hdfs_anchors"] = """
  SELECT min(m) AS a FROM top_set UNION ALL SELECT h.nxt FROM hdfs_anchors x JOIN hdfs_hops h ON h.m = x.a WHERE h.nxt IS NOT NULL"""
PARTS["hdfs_lines"] = """
  SELECT CAST(a.a AS VARCHAR) AS session_id, t.line_id, e.template, e.label
  FROM tops t ASOF JOIN hdfs_anchors a ON t.m >= a.a JOIN hdfs_log e ON e.line_id = t.line_id"""
PARTS["hdfs_split"] = _split(
    "(SELECT session_id, min(line_id) AS f FROM hdfs_lines GROUP BY 1)", SHUFFLED, "CAST(1 - 0.2::DOUBLE AS DOUBLE)", "0.2::DOUBLE")
PARTS["hdfs_vocab"] = """
  SELECT template, CAST(row_number() OVER (ORDER BY f, template) + 1 AS INTEGER) AS template_id
  FROM (SELECT template, min(line_id) AS f FROM hdfs_lines JOIN hdfs_split USING (session_id) WHERE split = 'train' GROUP BY 1)"""
PARTS["hdfs_coded"] = """
  SELECT l.*, coalesce(v.template_id, 1) AS template_id, row_number() OVER (PARTITION BY l.session_id ORDER BY l.line_id) - 1 AS pos
  FROM hdfs_lines l JOIN hdfs_split s USING (session_id) LEFT JOIN hdfs_vocab v USING (template) WHERE s.split = 'test'"""
PARTS["hdfs_windows"] = _windows("hdfs_coded", 50, 5)
add("a4_hdfs_time_sessions", f"""
  SELECT session_id, window_idx, array_to_string({_padded('ids', 50, '1')}, ',') AS features, next_id, anomaly FROM hdfs_windows""")

PARTS["gappy"] = """
  SELECT CASE WHEN user_id % 5 <> 0 THEN user_id END AS user_id, line_id, CASE WHEN line_id % 7 <> 0 THEN sec END AS sec FROM second_lines"""
PARTS["gappy_tops"] = """
  SELECT coalesce(user_id, -1) AS u, user_id, line_id, sec, max(sec) OVER (PARTITION BY user_id ORDER BY line_id) AS m FROM gappy"""
PARTS["gappy_set"] = "SELECT DISTINCT u, m FROM gappy_tops WHERE m IS NOT NULL"
PARTS["gappy_hops"] = """
  SELECT u, m, min(m) OVER (PARTITION BY u ORDER BY m RANGE BETWEEN 21601 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM gappy_set"""
PARTS["gappy_anchors"] = """
  SELECT u, min(m) AS a FROM gappy_set GROUP BY 1
  UNION ALL SELECT h.u, h.nxt FROM gappy_anchors x JOIN gappy_hops h ON h.m = x.a AND h.u = x.u WHERE h.nxt IS NOT NULL"""
add("g2_incomplete_lines", """
  SELECT t.user_id, t.line_id, t.sec, a.a AS session_id FROM gappy_tops t ASOF LEFT JOIN gappy_anchors a ON t.u = a.u AND t.m >= a.a""")
PARTS["gappy_events"] = """
  SELECT CASE WHEN user_id % 5 <> 0 THEN user_id ELSE -1 END AS user_id, line_id, ts FROM log_events WHERE line_id % 7 <> 0"""
PARTS["gappy_ids"] = _gap_chunk("user_id,", 36000).replace("FROM log_events", "FROM gappy_events")
add("g3_incomplete_lines", """
  SELECT CASE WHEN e.user_id % 5 <> 0 THEN e.user_id END AS user_id, e.line_id, i.session_id
  FROM log_events e LEFT JOIN gappy_ids i USING (line_id)""")

PARTS["event_words"] = f"SELECT template, {TOKENS.format(text='template')} AS toks FROM train_vocab"
PARTS["event_tokens"] = """
  SELECT token, row_number() OVER (ORDER BY token) + 1 AS token_id FROM (SELECT DISTINCT unnest(toks) AS token FROM event_words)"""
PARTS["all_event_words"] = f"""
  SELECT template, {TOKENS.format(text='template')} AS toks FROM (SELECT DISTINCT template FROM user_lines)"""
PARTS["event_token_ids"] = """
  SELECT template, array_to_string(list(coalesce(token_id, 1) ORDER BY p), ' ') AS toks FROM (
    SELECT template, unnest(toks) AS token, generate_subscripts(toks, 1) AS p FROM all_event_words) LEFT JOIN event_tokens USING (token) GROUP BY 1"""
PARTS["semantic_lines"] = "SELECT c.*, t.toks FROM coded_lines c JOIN event_token_ids t USING (template) WHERE split = 'test'"
PARTS["semantic_windows"] = _windows("semantic_lines", SIZE, STRIDE, ", list(toks ORDER BY pos) AS toks")
add("a1_semantic_extractor", f"""
  SELECT session_id, window_idx, array_to_string({_padded('toks', SIZE, "''")}, ',') AS features, anomaly,
         2 AS num_labels, (SELECT CAST(count(*) + 2 AS INTEGER) FROM event_tokens) AS vocab_size
  FROM semantic_windows""")

# Best order of the next-event model: one table of contexts up to the longest order serves all candidates.
PARTS["context_top4"] = _top("train_windows", 4)
PARTS["order_tries"] = " UNION ALL ".join(
    f"SELECT session_id, window_idx, anomaly, next_id, {m} AS used, " + (CONTEXT.format(last=m) if m else "''")
    + f" AS context FROM test_windows WHERE len >= {m}" for m in range(5))
PARTS["order_picked"] = """
  SELECT o.candidate, session_id, window_idx, any_value(anomaly) AS anomaly, any_value(next_id) AS next_id, arg_max(m.tops, used) AS tops
  FROM order_tries t JOIN context_top4 m USING (context) JOIN (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS candidate) o ON t.used <= o.candidate
  GROUP BY 1, 2, 3"""
PARTS["order_sessions"] = """
  SELECT candidate AS k, session_id, CAST(max(CAST(coalesce(tops[1] <> next_id, true) AS INTEGER)) AS INTEGER) AS pred, CAST(max(anomaly) > 0 AS INTEGER) AS truth
  FROM order_picked GROUP BY 1, 2"""
PARTS["order_measured"] = _metrics("order_sessions")
PARTS["order_patience"] = """
  SELECT *, max(CASE WHEN best IS NULL OR f1 > best THEN k END) OVER (ORDER BY k) AS last
  FROM (SELECT *, max(f1) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM order_measured)"""
PARTS["order_patient"] = """
  SELECT * FROM order_patience WHERE k <= coalesce((SELECT min(k) FROM order_patience WHERE k - last >= 2), 1000000)"""
add("d7_order_search", """
  SELECT k AS candidate, round(f1, 6)::DOUBLE AS f1, (SELECT max(k) FROM order_patient) AS stopped_at FROM order_patient
  ORDER BY order_patient.f1 DESC, k LIMIT 1""")
ORACLE["d7_shared_search"] = ORACLE["d7_order_search"]
# The lines of a document's windows with their weights; windows as in f3.
PARTS["tfidf_windows"] = f"SELECT session_id, window_idx, unnest(ts[i + 1:i + len]) AS template FROM ({_windows('doc_coded', 3, 2)})"
add("a1_tfidf_windows", """
  SELECT session_id, window_idx, count(*) AS tokens, round(sum(weight * weight), 6) AS squared_length
  FROM (SELECT session_id, window_idx, token_id, sum(weight) / 3 AS weight FROM tfidf_windows JOIN doc_tfidf USING (template) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
