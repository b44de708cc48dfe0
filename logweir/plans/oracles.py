"""SQL for the registered queries, written against the typed tables.

No statement here parses a log line: the expected answer comes from the columns the logs
were rendered from.
"""

from __future__ import annotations

# Rendered events: one header line each.
EVENTS = """ev AS (
  SELECT event_id, 'events.log.' || CAST(event_id // 4096 AS VARCHAR) AS file,
    CAST(event_id % 4096 + 1 AS BIGINT) AS line_number,
    date_trunc('second', ts) AS ts_local,
    CAST(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 120 ELSE -330 END AS BIGINT) AS tz_offset_min,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING'
      WHEN 'purchase' THEN 'NOTICE' WHEN 'view' THEN 'INFO' ELSE 'DEBUG' END AS level,
    CAST(CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 4
      WHEN 'purchase' THEN 5 WHEN 'view' THEN 6 ELSE 7 END AS BIGINT) AS severity,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE 'u' || CAST(user_id AS VARCHAR) END AS request_id,
    'App.' || event_type || '.Service' AS component,
    event_type || ' amount ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS head,
    ' - ' || props AS rest, event_type, user_id, props,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
), e AS (
  SELECT *, head || rest AS message,
    ts_local - to_minutes(CAST(tz_offset_min AS INTEGER)) AS ts,
    strftime(ts_local, '%a, %d %b %Y %H:%M:%S ')
      || CASE event_id % 3 WHEN 0 THEN '+0000' WHEN 1 THEN '+0200' ELSE '-0530' END
      || ' [' || level || '] request="' || coalesce(request_id, '') || '" component="'
      || component || '": ' || head || rest AS value
  FROM ev
)"""

# Rendered documents: header, two blank lines, the text, a blank line.
LEVEL_OF_DOC = """(['EMERGENCY', 'ALERT', 'CRITICAL', 'ERROR', 'WARNING', 'NOTICE', 'INFO',
      'DEBUG'])[doc_id % 8 + 1]"""
DOCUMENTS = f"""dv AS (
  SELECT *, TIMESTAMP '2024-03-01' + to_minutes(CAST(doc_id AS INTEGER)) AS ts_local,
    {LEVEL_OF_DOC} AS level, CAST(doc_id % 8 AS BIGINT) AS severity,
    'd' || CAST(doc_id // 5 AS VARCHAR) AS request_id, 'Docs.' || source AS component,
    'document ' || CAST(doc_id AS VARCHAR) || ' - {{"lang":"' || lang || '","n":'
      || CAST(n_chars AS VARCHAR) || '}}' AS message,
    len(string_split(text, chr(10))) AS n_text
  FROM documents
), du AS (
  SELECT *, strftime(ts_local, '%a, %d %b %Y %H:%M:%S') || ' +0100 [' || level || '] request="'
      || request_id || '" component="' || component || '": ' AS start
  FROM dv
), d AS (
  SELECT *, 'documents-' || lang || '.log' AS file,
    start || message || chr(10) || chr(10) || '  ' || chr(10) || text || chr(10) AS value,
    CAST(sum(n_text + 4) OVER (PARTITION BY lang ORDER BY doc_id) - (n_text + 4) + 1 AS BIGINT)
      AS line_number,
    CAST(sum(n_text + 4) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS end_line
  FROM du
), dl AS (
  SELECT file, line_number AS head_line, level, severity, pieces[i] AS value,
    CAST(line_number + i - 1 AS BIGINT) AS line_number
  FROM (SELECT file, line_number, level, severity, string_split(value, chr(10)) AS pieces,
          unnest(range(1, n_text + 5)) AS i FROM d)
), x AS (
  SELECT *, 'crashes-' || lang || '.log' AS file,
    CAST(2 * row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS line_number,
    '{{"exception":' || CAST(to_json(text) AS VARCHAR) || ',' AS json_start,
    '"meta":{{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"tags":["' || lang || '","' || source
      || '"]}}}}' AS json_end
  FROM du
)"""

CONVERSATIONS = """cv AS (
  SELECT *, TIMESTAMP '2024-05-01' + to_minutes(CAST(conv_id AS INTEGER))
      + to_seconds(CAST(turn AS INTEGER)) AS ts_local,
    CASE role WHEN 'user' THEN 'INFO' WHEN 'assistant' THEN 'NOTICE' ELSE 'DEBUG' END AS level,
    'c' || CAST(conv_id AS VARCHAR) AS request_id, 'Chat.' || role AS component,
    role || ' turn ' || CAST(turn AS VARCHAR) AS message,
    len(string_split(text, chr(10))) AS n_text
  FROM conversations
), c AS (
  SELECT *, 'conversations.log' AS file,
    CAST(sum(n_text + 1) OVER w - n_text AS BIGINT) AS line_number,
    CAST(sum(n_text + 1) OVER w AS BIGINT) AS end_line
  FROM cv WINDOW w AS (ORDER BY conv_id, turn)
)"""

LABEL = """CASE WHEN {0} >= 1073741824 THEN printf('%.1f GB', {0} / 1073741824.0)
    WHEN {0} >= 1048576 THEN printf('%.1f MB', {0} / 1048576.0)
    WHEN {0} >= 1024 THEN printf('%.1f KB', {0} / 1024.0)
    ELSE CAST({0} AS VARCHAR) || ' B' END"""

SIZES = """sizes AS (
  SELECT file AS name, CAST(sum(strlen(value) + 1) AS BIGINT) AS size_bytes,
    count(*) AS total FROM {0} GROUP BY file
)"""

# Lines of the events logs in eight kinds; 1 to 3 continue the entry before them.
DIRTY = """kinds AS (SELECT *, line_number % 8 AS kind FROM e),
heads AS (
  SELECT *, CASE WHEN kind = 4 THEN 1380 ELSE tz_offset_min END AS zone,
    CASE WHEN kind = 0 THEN least(line_number + 3, last_line) ELSE line_number END AS end_line
  FROM (SELECT *, max(line_number) OVER (PARTITION BY file) AS last_line FROM kinds)
  WHERE kind NOT IN (1, 2, 3)),
tails AS (
  SELECT file, line_number - kind AS line_number, string_agg(CASE kind
      WHEN 1 THEN (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun', 'Mon'])[
        list_position(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'], value[1:3]) + 1] || value[4:]
      WHEN 2 THEN value[1:5] || '31 Feb' || value[12:]
      ELSE replace(value, ' [' || level || '] request=', ' [VERBOSE] request=') END,
    chr(10) ORDER BY line_number) AS extra_data
  FROM kinds WHERE kind IN (1, 2, 3) GROUP BY file, line_number - kind)"""

TEXT_TIME = "CAST({0} AS VARCHAR) AS {0}"


def on_events(select: str, more: str = "") -> str:
    return f"WITH {EVENTS}{', ' + more if more else ''} {select}"


def on_documents(select: str, more: str = "") -> str:
    return f"WITH {DOCUMENTS}{', ' + more if more else ''} {select}"


def on_conversations(select: str) -> str:
    return f"WITH {CONVERSATIONS} {select}"


def filtered(condition: str) -> str:
    return on_events(f"SELECT file, line_number, level, message FROM e WHERE {condition}")


DAY = "CAST(ts_local AS DATE)"
RANKED_ERRORS = """er AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_number) AS position,
    count(*) OVER (PARTITION BY file) AS total FROM e WHERE severity <= 3
)"""
DETAIL_HEAD = """'Zeitpunkt:  ' || strftime({0}, '%d.%m.%Y, %H:%M:%S') || {1} || chr(10)
  || 'Level:      ' || level || chr(10) || 'Request:    ' || coalesce(request_id, '-') || chr(10)
  || 'Component:  ' || component || chr(10)
  || 'Zeile:      ' || CAST(line_number AS VARCHAR) || chr(10) || chr(10)"""

KEPT_LINES = """kept AS (
  SELECT file, value, row_number() OVER (PARTITION BY file ORDER BY line_number) AS line_number
  FROM dl WHERE severity > 3
)"""


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    # scan and catalog
    sql["scan_lines"] = on_documents("SELECT file, line_number, value FROM dl")
    sql["file_catalog"] = on_events(
        f"""SELECT name, size_bytes, {LABEL.format('size_bytes')} AS size_label,
          size_bytes = 0 AS is_empty, CAST(last_ts AS VARCHAR) AS last_ts,
          last_ts >= TIMESTAMP '2024-01-30 00:00:00' AS is_recent
        FROM sizes JOIN (SELECT file AS name, arg_max(ts, line_number) AS last_ts FROM e
          GROUP BY file) USING (name)""",
        SIZES.format("e"),
    )
    sql["log_names"] = """SELECT doc_id, source || (['.log', '.log.20260310163451', '.txt', '.log.',
          '', '.logfile', '.log.1', '.log.1.logx'])[doc_id % 8 + 1] AS name,
        doc_id % 8 IN (0, 1, 6) AS is_log FROM documents"""
    sql["open_one_log"] = on_documents(
        """SELECT file AS name, CAST(sum(strlen(value) + 1) AS BIGINT) AS size_bytes,
          CAST(CASE WHEN file = 'documents-en.log' THEN sum(n_text + 4) ELSE 0 END AS BIGINT)
            AS lines_read FROM d GROUP BY file"""
    )
    sql["line_totals"] = on_documents(
        "SELECT file, CAST(max(end_line) AS BIGINT) AS lines_read FROM d GROUP BY file"
    )

    # parse and assemble
    sql["parse_headers"] = on_events(
        """SELECT file, line_number, CAST(ts AS VARCHAR) AS ts, CAST(ts_local AS VARCHAR) AS ts_local,
          tz_offset_min, level, severity, request_id, component, message FROM e"""
    )
    sql["parse_timestamps"] = on_conversations(
        """SELECT file, line_number, CAST(ts_local + INTERVAL 5 HOUR AS VARCHAR) AS ts,
          CAST(ts_local AS VARCHAR) AS ts_local, CAST(-300 AS BIGINT) AS tz_offset_min FROM c"""
    )
    sql["parse_levels"] = on_documents("SELECT file, line_number, level, severity FROM d")
    sql["missing_requests"] = on_events(
        "SELECT file, line_number, component FROM e WHERE request_id IS NULL"
    )
    sql["assemble_entries"] = on_documents(
        """SELECT file, line_number, end_line, CAST(ts_local AS VARCHAR) AS ts_local, level, message,
          text AS extra_data FROM d"""
    )
    sql["assemble_conversations"] = on_conversations(
        "SELECT file, line_number, end_line, request_id, component, message, text AS extra_data FROM c"
    )
    sql["line_offset"] = on_events(
        "SELECT file, line_number + 10 AS line_number, level, message FROM e"
    )
    sql["parse_text"] = on_documents(
        """SELECT CAST(doc_id AS VARCHAR) AS file, CAST(1 AS BIGINT) AS line_number,
          CAST(n_text + 3 AS BIGINT) AS end_line, message, text AS extra_data FROM d"""
    )

    # filters
    conditions = {
        "filter_min_level": "severity <= 4",
        "filter_search_text": "contains(lower(message), 'purchase') OR contains(lower(component), 'purchase')",
        "filter_component": "contains(lower(component), 'app.sign')",
        "filter_request": "request_id = 'u42'",
        "filter_message_prefix": "head = 'error amount 655'",
        "filter_date_from": f"{DAY} >= DATE '2024-01-15'",
        "filter_date_to": f"{DAY} <= DATE '2024-01-09'",
        "filter_all_fields": f"""severity <= 6 AND contains(lower(message), 'amount 1')
          AND contains(lower(component), 'service')
          AND {DAY} BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""",
        "filter_cleared": "TRUE",
        "filter_today": f"{DAY} = DATE '2024-01-15'",
        "filter_last_month": f"{DAY} BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'",
        "filter_last_months": f"{DAY} BETWEEN DATE '2024-01-20' AND DATE '2024-07-20'",
        "filter_typed_dates": f"{DAY} BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'",
        "filter_dates_cleared": "severity <= 3",
    }
    sql |= {name: filtered(condition) for name, condition in conditions.items()}
    sql["filter_shortcuts"] = on_events(
        """SELECT file, count(*) FILTER (severity <= 3) AS key_1, count(*) FILTER (severity <= 4)
          AS key_2, count(*) FILTER (severity <= 6) AS key_3, count(*) AS key_4 FROM e GROUP BY file"""
    )
    sql["filtered_entries"] = on_documents(
        """SELECT file, line_number, end_line, level, text AS extra_data FROM d
        WHERE severity <= 2 AND contains(lower(component), 'docs.src1')"""
    )

    sql["filtered_store"] = on_events(
        f"""SELECT file, line_number, level, message, CAST(ts_local AS VARCHAR) AS ts_local FROM e
        WHERE severity <= 4 AND {DAY} BETWEEN DATE '2024-01-15' AND DATE '2024-01-20'"""
    )

    # scalar functions
    sql["split_message"] = on_events("SELECT file, line_number, head, rest FROM e")
    sql["previews"] = """SELECT doc_id, CASE WHEN strlen(text) <= 120 THEN text ELSE
          left(text, list_max([n for n in range(0, 118) if strlen(left(text, n)) <= 117])) || '...'
        END AS preview FROM documents"""
    sql["typed_dates"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3
        THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders"""
    sql["timestamp_formats"] = on_events(
        """SELECT file, line_number, strftime(ts_local, '%d.%m.%y %H:%M:%S') AS short_ts,
          strftime(ts_local, '%d.%m.%Y, %H:%M:%S') AS full_ts FROM e"""
    )
    sql["shifted_times"] = on_events(
        """SELECT file, line_number,
          strftime(ts_local + INTERVAL 13 HOUR, '%d.%m.%y %H:%M:%S') AS later,
          strftime(ts_local - INTERVAL 3 HOUR, '%d.%m.%y %H:%M:%S') AS earlier,
          strftime(ts_local, '%d.%m.%y %H:%M:%S') AS same, '+13h' AS label FROM e"""
    )
    sql["entry_labels"] = on_events(
        """SELECT file, line_number, '[' || level || ']' AS level_label,
          coalesce(request_id, '-') AS request_label FROM e"""
    )
    sql["severity_classes"] = on_documents(
        """SELECT CASE WHEN severity <= 2 THEN 'critical' WHEN severity = 3 THEN 'error'
            WHEN severity = 4 THEN 'warning' WHEN severity <= 6 THEN 'info' ELSE 'debug' END
            AS severity_class, count(*) AS entries FROM d GROUP BY 1"""
    )
    size = "(n_chars * n_chars * (doc_id + 1))"
    sql["size_labels"] = f"SELECT doc_id, {LABEL.format(size)} AS size_label FROM documents"
    sql["date_labels"] = on_events(
        f"""SELECT '15.01.2024' AS label, count(*) FILTER ({DAY} = DATE '2024-01-15') AS matched FROM e
        UNION ALL SELECT '15.01.2024 – 20.01.2024',
          count(*) FILTER ({DAY} BETWEEN DATE '2024-01-15' AND DATE '2024-01-20') FROM e
        UNION ALL SELECT 'ab 15.01.2024', count(*) FILTER ({DAY} >= DATE '2024-01-15') FROM e
        UNION ALL SELECT 'bis 15.01.2024', count(*) FILTER ({DAY} <= DATE '2024-01-15') FROM e"""
    )
    head = DETAIL_HEAD.format("ts_local + INTERVAL 2 HOUR", "' (angepasst, +2h)'")
    sql["detail_blocks"] = on_events(
        f"""SELECT file, line_number, {head} || head || chr(10) || chr(10) || 'JSON:' || chr(10)
          || chr(10) || '{{"k":' || CAST(k AS VARCHAR) || '}}' AS detail FROM e"""
    )
    head = DETAIL_HEAD.format("ts_local", "''")
    sql["detail_of_crashes"] = on_documents(
        f"""SELECT file, line_number, {head} || 'Uncaught failure' || chr(10) || chr(10)
          || 'Zusätzliche Daten:' || chr(10) || chr(10) || '{{' || json_end AS detail FROM x"""
    )

    # JSON
    sql["message_json"] = on_events(
        """SELECT file, line_number, head AS prefix, '{"k":' || CAST(k AS VARCHAR) || '}' AS json, k
        FROM e"""
    )
    sql["first_line_json"] = """SELECT doc_id, 'load' AS prefix,
        '{"doc":' || CAST(doc_id AS VARCHAR) || '}' AS json FROM documents"""
    sql["json_blocks"] = on_events(
        """SELECT file, line_number, CAST(0 AS BIGINT) AS block_no,
          CAST(length(head) + 3 AS BIGINT) AS char_offset, '{"k":' || CAST(k AS VARCHAR) || '}' AS json
        FROM e UNION ALL
        SELECT file, line_number, 1, length(message) + 6, '[1,{"a":"]"}]' FROM e"""
    )
    sql["normalized_json"] = on_documents(
        "SELECT file, line_number, json_start || json_end AS json FROM x"
    )
    sql["json_fields"] = on_documents(
        """SELECT file, line_number, CAST(0 AS BIGINT) AS field_no, '$.exception' AS path,
          'exception' AS key, CAST(i - 1 AS BIGINT) AS text_line, pieces[i] AS text
        FROM (SELECT file, line_number, string_split(text, chr(10)) AS pieces,
                unnest(range(1, n_text + 1)) AS i FROM x)
        UNION ALL SELECT file, line_number, 1, '$.meta.doc_id', 'doc_id', 0,
          CAST(doc_id AS VARCHAR) FROM x
        UNION ALL SELECT file, line_number, 2, '$.meta.tags[0]', 'tags', 0, lang FROM x
        UNION ALL SELECT file, line_number, 3, '$.meta.tags[1]', 'tags', 0, source FROM x"""
    )
    sql["hidden_exceptions"] = on_documents("SELECT file, line_number, '{' || json_end AS json FROM x")
    sql["exception_values"] = on_documents("SELECT file, line_number, text AS exception FROM x")

    # order and slices
    sql["file_order"] = on_events("SELECT file, line_number, level FROM e ORDER BY file, line_number")
    sql["catalog_order"] = on_documents("SELECT name, size_bytes FROM sizes ORDER BY name", SIZES.format("d"))
    sql["tail"] = on_events(
        "SELECT file, line_number, message FROM e ORDER BY file DESC, line_number DESC LIMIT 20"
    )
    sql["tail_per_file"] = on_events(
        "SELECT file, line_number, message FROM er WHERE position > total - 10", RANKED_ERRORS
    )
    sql["head"] = on_events("SELECT file, line_number, message FROM e ORDER BY file, line_number LIMIT 20")
    sql["page"] = on_events(
        """SELECT file, line_number, position, total FROM er
        WHERE (position - 1) // 100 = least(3, (total - 1) // 100)""",
        RANKED_ERRORS,
    )
    sql["positions"] = on_events("SELECT file, line_number, position, total FROM er", RANKED_ERRORS)
    sql["marked_slice"] = on_events(
        "SELECT file, line_number, position FROM er WHERE position BETWEEN 50 AND 80", RANKED_ERRORS
    )
    sql["neighbours"] = on_conversations(
        """SELECT file, line_number,
          coalesce(lag(line_number) OVER (ORDER BY line_number), 0) AS previous_line,
          coalesce(lead(line_number) OVER (ORDER BY line_number), 0) AS next_line FROM c"""
    )

    # summaries
    sql["query_summary"] = on_events(
        f"""SELECT name AS file, size_bytes, total, matched, name || ' (' || {LABEL.format('size_bytes')}
          || ', ' || CAST(total AS VARCHAR) || ' Einträge) [Filter: 15.01.2024, weiterer Filter — '
          || CAST(matched AS VARCHAR) || ' von ' || CAST(total AS VARCHAR) || ' Einträgen]' AS title
        FROM sizes JOIN (SELECT file AS name, count(*) FILTER (severity <= 4
          AND {DAY} = DATE '2024-01-15') AS matched FROM e GROUP BY file) USING (name)""",
        SIZES.format("e"),
    )
    sql["delete_preview"] = on_events(
        """SELECT file, count(*) FILTER (line_number = 7) AS one_row,
          count(*) FILTER (line_number BETWEEN 10 AND 19) AS marked_range,
          count(*) FILTER (severity <= 3) AS by_filter, count(*) AS whole_file FROM e GROUP BY file"""
    )
    sql["last_timestamps"] = on_events(
        "SELECT file, CAST(arg_max(ts, line_number) AS VARCHAR) AS last_ts FROM e GROUP BY file"
    )
    sql["recency"] = on_events(
        """SELECT file, arg_max(ts, line_number) >= TIMESTAMP '2024-01-19 12:00:00' AS is_recent
        FROM e GROUP BY file"""
    )
    sql["request_summary"] = on_events(
        """SELECT file, request_id, count(*) AS entries, min(line_number) AS first_line,
          max(line_number) AS last_line, min(severity) AS worst_severity
        FROM e WHERE request_id IS NOT NULL GROUP BY file, request_id"""
    )
    sql["template_summary"] = on_conversations(
        "SELECT message AS message_prefix, count(*) AS entries FROM c GROUP BY message"
    )
    sql["template_summary_events"] = on_events(
        "SELECT head AS message_prefix, count(*) AS entries FROM e GROUP BY head"
    )
    sql["level_summary"] = on_documents(
        """SELECT level, severity, count(*) AS entries,
          CAST(sum(count(*)) OVER (ORDER BY severity) AS BIGINT) AS at_or_above
        FROM d GROUP BY level, severity"""
    )

    # differences and deletes
    sql["new_entries"] = on_events(
        f"SELECT file, line_number, message FROM e WHERE {DAY} > DATE '2024-01-15'"
    )
    sql["delete_one_entry"] = on_documents(
        """SELECT file, line_number, value FROM dl
        WHERE NOT (file = 'documents-en.log' AND head_line = 1)"""
    )
    sql["delete_range"] = on_documents(
        """SELECT file, line_number, value FROM dl WHERE NOT (file = 'documents-de.log' AND head_line IN (
          SELECT line_number FROM (SELECT line_number, row_number() OVER (ORDER BY line_number) AS p
            FROM d WHERE file = 'documents-de.log' AND severity <= 3) WHERE p BETWEEN 2 AND 4))"""
    )
    sql["delete_by_filter"] = on_documents("SELECT file, line_number, value FROM kept", KEPT_LINES)
    sql["delete_twice"] = on_documents(
        """SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_number) AS line_number,
          value, lines_before
        FROM dl JOIN (SELECT file, count(*) AS lines_before FROM dl GROUP BY file) USING (file)
        WHERE severity > 3 AND NOT (file = 'documents-en.log' AND head_line = (
          SELECT min(head_line) FROM dl WHERE file = 'documents-en.log' AND severity > 3))"""
    )
    sql["entries_after_delete"] = on_events(
        """SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_number) AS line_number,
          level, message FROM e WHERE severity <= 3"""
    )
    sql["truncate_log"] = on_documents(
        """SELECT name, CASE WHEN name = 'documents-fr.log' THEN 0 ELSE size_bytes END AS size_bytes,
          name = 'documents-fr.log' AS is_empty FROM sizes""",
        SIZES.format("d"),
    )
    sql["export_details"] = on_conversations(
        f"""SELECT value, count(*) AS n FROM (SELECT unnest(string_split({head} || message || chr(10)
          || chr(10) || 'Zusätzliche Daten:' || chr(10) || chr(10) || text, chr(10))) AS value FROM c)
        GROUP BY value"""
    )

    # streaming
    looks = """looks AS (SELECT file, CAST(max(end_line) // 2 AS BIGINT) AS cut FROM d GROUP BY file)"""
    sql["tail_growing"] = on_documents(
        """SELECT file, line_number, end_line, CAST(1 AS BIGINT) AS generation, level, message,
          text AS extra_data, line_number > cut AS is_new FROM d JOIN looks USING (file)""",
        looks,
    )
    sql["tail_rotated"] = on_documents(
        """SELECT file, line_number, CAST(2 AS BIGINT) AS generation, level, FALSE AS is_new
        FROM d JOIN looks USING (file) WHERE line_number <= cut""",
        looks,
    )
    sql["tail_filtered"] = on_events(
        """SELECT file, line_number, level, message, FALSE AS is_new FROM e
        WHERE severity <= 4 AND contains(message, 'amount 2')"""
    )
    sql["tail_missing"] = on_documents(
        """SELECT file, line_number, CAST(1 AS BIGINT) AS generation, message, FALSE AS is_new
        FROM d"""
    )
    sql["tail_same_size"] = on_documents(
        """SELECT file, line_number, CAST(2 AS BIGINT) AS generation,
          CASE WHEN line_number > 1 THEN 'DOCUMENT' || substr(message, 9) ELSE message END AS message,
          FALSE AS is_new FROM d"""
    )
    sql["tail_renamed"] = on_documents(
        """SELECT file || '.1' AS file, max(line_number) AS line_number,
          CAST(1 AS BIGINT) AS generation, arg_max(message, line_number) AS message, FALSE AS is_new
        FROM d GROUP BY file"""
    )
    sql["tail_same_banner"] = on_documents(
        """SELECT file, line_number + 1 AS line_number, CAST(1 AS BIGINT) AS generation, message,
          FALSE AS is_new FROM d
        UNION ALL SELECT 'documents-xx.log', line_number + 1, 1, 'DOCUMENT' || substr(message, 9),
          FALSE FROM d WHERE file = 'documents-de.log'"""
    )
    sql["tail_touched"] = on_documents(
        """SELECT file, line_number, CAST(1 AS BIGINT) AS times, CAST(1 AS BIGINT) AS generation
        FROM d"""
    )
    sql["tail_returned"] = on_documents(
        """SELECT file, line_number + 1 AS line_number, end_line + 1 AS end_line,
          CAST(1 AS BIGINT) AS generation, message, line_number > cut AS is_new
        FROM d JOIN looks USING (file)""",
        looks,
    )
    sql["tail_from_backlog"] = on_documents(
        """SELECT file, line_number, end_line, CAST(1 AS BIGINT) AS generation, message,
          text AS extra_data, line_number > cut AS is_new
        FROM d JOIN looks USING (file) WHERE end_line > cut
          OR line_number = (SELECT max(x.line_number) FROM d x WHERE x.file = d.file
            AND x.line_number <= cut)""",
        looks,
    )
    sql["dirty_entries"] = on_events(
        """SELECT file, line_number, CAST(end_line AS BIGINT) AS end_line,
          CAST(ts_local - to_minutes(CAST(zone AS INTEGER)) AS VARCHAR) AS ts,
          CAST(ts_local AS VARCHAR) AS ts_local, CAST(zone AS BIGINT) AS tz_offset_min, level,
          message || CASE WHEN kind = 6 THEN ' {oops' ELSE '' END AS message, extra_data,
          CASE WHEN kind <> 6 THEN '{"k":' || CAST(k AS VARCHAR) || '}' END AS json
        FROM heads LEFT JOIN tails USING (file, line_number)""",
        DIRTY,
    )
    return sql
