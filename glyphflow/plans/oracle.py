"""The same answers as DuckDB SQL over the driver tables."""

from __future__ import annotations

from glyphflow.settings import (
    BATCH_SIZE_BOUNDS,
    INFERENCE_BOUNDS,
    METRIC_FAMILIES,
    REQUEST_BOUNDS,
)

# ---- shared tables --------------------------------------------------------------------------

_ANSWER = """coalesce(total_lines, 0) AS total_lines, coalesce(total_characters, 0) AS total_characters,
  round(coalesce(avg_confidence, 0) + 1e-9, 6) AS avg_confidence, coalesce(texts, '') AS texts,
  CASE WHEN fine THEN iw ELSE 0 END AS image_width, CASE WHEN fine THEN ih ELSE 0 END AS image_height"""

_FOUND = """lines AS (
  SELECT payload_id, md5(b) AS text, (n * 7 % 101) / 100 AS confidence, 0 AS i, threshold FROM checked WHERE fine
  UNION ALL SELECT payload_id, CAST(n AS VARCHAR), 0.5, 1, threshold FROM checked WHERE fine
  UNION ALL SELECT payload_id, 'plain', 1.0, 2, threshold FROM checked WHERE fine),
found AS (
  SELECT payload_id, count(*) AS total_lines, CAST(sum(length(text)) AS BIGINT) AS total_characters,
         avg(confidence) AS avg_confidence, string_agg(text, ',' ORDER BY i) AS texts
  FROM lines WHERE confidence >= threshold GROUP BY payload_id)"""

_IMAGES = """images AS (
  SELECT o_orderkey AS image_id, o_custkey AS batch_id,
         CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'order_' || o_orderkey END AS filename,
         list_extract(['en', 'de', 'fr', 'es'], o_orderkey % 4 + 1) AS lang,
         CAST(500 + o_orderkey % 5000 AS INTEGER) AS width,
         CAST(400 + o_orderkey % 4000 AS INTEGER) AS height,
         (o_orderkey % 5) / 10 AS min_confidence,
         o_orderkey % 2 = 0 AS include_polygon,
         CASE WHEN o_orderkey % 11 = 0 OR o_custkey % 13 = 0 THEN 'error' ELSE 'success' END AS status
  FROM orders)"""

_DETECTIONS = """detections AS (
  SELECT l_orderkey AS image_id, l_linenumber AS line_no, l_partkey AS part_key, l_suppkey AS supp_key,
         p_name AS text, round(abs(l_discount) * 10, 6) AS confidence,
         l_quantity AS x0, 10.0::DOUBLE * l_linenumber AS y0,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS det_idx
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_KEPT = """kept AS (
  SELECT d.*, i.width, i.height, i.include_polygon
  FROM detections d JOIN images i USING (image_id) WHERE d.confidence >= i.min_confidence)"""

_SUMMARY = """summary AS (
  SELECT image_id, count(*) AS total_lines, sum(length(text)) AS total_characters, avg(confidence) AS avg_confidence
  FROM kept GROUP BY image_id)"""

_RAW_LINES = """raw_images AS (
  SELECT doc_id AS image_id, lang,
         CASE WHEN doc_id % 97 = 0 THEN 0 ELSE 1000 + doc_id % 500 END AS width,
         800 + doc_id % 300 AS height, (doc_id % 5) / 10 AS min_confidence,
         doc_id % 2 = 0 AS include_polygon, string_split(text, chr(10)) AS lines
  FROM documents),
all_lines AS (
  SELECT image_id, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS i FROM raw_images),
items AS (
  SELECT image_id, text, i,
         row_number() OVER (PARTITION BY image_id ORDER BY i) - 1 AS det_idx,
         CASE WHEN length(text) % 5 != 0 THEN ((length(text) * 7 + i) % 101) / 100 ELSE 1.0 END AS confidence,
         CASE WHEN length(text) % 7 != 0 THEN 4 ELSE 3 END AS n_points,
         10.0 AS x0, CAST(i * 20 AS DOUBLE) AS y0, CAST(length(text) * 8 + 10 AS DOUBLE) AS x1,
         CAST(i * 20 AS DOUBLE) + 16 AS y1
  FROM all_lines WHERE text != ''),
kept_items AS (
  SELECT t.*, r.width, r.height, r.include_polygon, r.lang
  FROM items t JOIN raw_images r USING (image_id) WHERE t.confidence >= r.min_confidence),
zero_sized AS (
  SELECT DISTINCT image_id FROM kept_items WHERE n_points = 4 AND (width = 0 OR height = 0))"""

_PAYLOADS = """contents AS (
  SELECT doc_id AS payload_id, lang,
         unhex(CASE WHEN doc_id % 16 = 8 THEN 'FFD8FFD9'
           WHEN doc_id % 8 = 0 THEN 'FFD8FFC0001108' || printf('%04X', h) || printf('%04X', w) || '03'
           WHEN doc_id % 8 = 1 THEN '89504E470D0A1A0A0000000D49484452' || printf('%08X', w) || printf('%08X', h) || '0802000000'
           WHEN doc_id % 8 = 2 THEN '424D' || repeat('00', 16) || substr(printf('%08X', w), 7, 2) || substr(printf('%08X', w), 5, 2)
             || substr(printf('%08X', w), 3, 2) || substr(printf('%08X', w), 1, 2) || substr(printf('%08X', h), 7, 2)
             || substr(printf('%08X', h), 5, 2) || substr(printf('%08X', h), 3, 2) || substr(printf('%08X', h), 1, 2)
           ELSE list_extract(['', '', '', '49492A00', '4D4D002A', '524946460000000057454250', '524946460000000057415645', ''],
                             doc_id % 8 + 1) END) || encode(text) AS content,
         CASE WHEN doc_id % 8 < 3 THEN CAST(w AS INTEGER) END AS iw, CASE WHEN doc_id % 8 < 3 THEN CAST(h AS INTEGER) END AS ih,
         CASE WHEN (doc_id // 40) % 2 = 0 THEN '/ocr' ELSE '/ocr/json' END AS endpoint
  FROM (SELECT *, 1 + doc_id % 3000 AS w, 1 + n_chars % 2000 AS h FROM documents)),
payloads AS (
  SELECT payload_id, lang, content, endpoint, iw, ih,
         CASE payload_id % 10
           WHEN 0 THEN 'data:image/jpeg;base64,' || to_base64(content)
           WHEN 1 THEN left(to_base64(content), length(to_base64(content)) - 1)
           WHEN 2 THEN '  ' || chr(9)
           WHEN 3 THEN to_base64(content) || 'é'
           ELSE to_base64(content) END AS payload
  FROM contents),
bodies AS (
  SELECT *, trim(CASE WHEN contains(payload, 'base64,') THEN string_split(payload, 'base64,')[2] ELSE payload END,
                 ' ' || chr(9) || chr(10) || chr(13)) AS body
  FROM payloads),
parts AS (
  SELECT *, rtrim(regexp_replace(body, '[^A-Za-z0-9+/=]', '', 'g'), '=') AS data,
         length(regexp_replace(body, '[^A-Za-z0-9+/=]', '', 'g'))
           - length(rtrim(regexp_replace(body, '[^A-Za-z0-9+/=]', '', 'g'), '=')) AS pads
  FROM bodies),
verdicts AS (
  SELECT *, CASE
      WHEN octet_length(encode(body)) != length(body)
        THEN 'Invalid base64 data: string argument should contain only ASCII characters'
      WHEN length(data) % 4 = 0 OR (length(data) % 4 >= 2 AND length(data) % 4 + pads >= 4) THEN NULL
      WHEN length(data) % 4 = 1
        THEN 'Invalid base64 data: Invalid base64-encoded string: number of data characters (' || length(data)
             || ') cannot be 1 more than a multiple of 4'
      ELSE 'Invalid base64 data: Incorrect padding' END AS decode_error
  FROM parts),
decoded AS (
  SELECT *, CASE WHEN decode_error IS NULL THEN from_base64(data || repeat('=', (4 - length(data) % 4) % 4)) END AS bytes
  FROM verdicts)"""

_FORMAT = """CASE
  WHEN starts_with(hex({x}), 'FFD8FF') THEN 'jpeg'
  WHEN starts_with(hex({x}), '89504E47') THEN 'png'
  WHEN starts_with(hex({x}), '424D') THEN 'bmp'
  WHEN starts_with(hex({x}), '49492A00') OR starts_with(hex({x}), '4D4D002A') THEN 'tiff'
  WHEN starts_with(hex({x}), '52494646') AND substr(hex({x}), 17, 8) = '57454250' THEN 'webp' END"""

_ASKED = f""", used AS (
  SELECT payload_id, endpoint,
         CASE WHEN endpoint = '/ocr/json' THEN bytes ELSE content END AS b,
         CASE WHEN endpoint = '/ocr/json' THEN decode_error END AS e,
         CASE WHEN payload_id % 3 = 1 THEN 'de' WHEN endpoint = '/ocr/json' THEN lang ELSE 'en' END AS lang,
         CASE WHEN payload_id % 4 = 1 THEN 0.6 WHEN endpoint = '/ocr/json' THEN (payload_id % 5) / 10 ELSE 0.0::DOUBLE END AS threshold
  FROM decoded),
coded AS (
  SELECT *, octet_length(b) AS n, CASE
    WHEN e IS NOT NULL THEN 'invalid_base64'
    WHEN coalesce(octet_length(b), 0) = 0 THEN 'image_empty'
    WHEN {_FORMAT.format(x="b")} IS NULL
      THEN CASE WHEN endpoint = '/ocr' THEN 'unsupported_format' ELSE 'unreadable_image' END
    WHEN payload_id % 16 = 8 THEN 'unreadable_image'
    WHEN octet_length(b) % 17 = 0 THEN 'ocr_failed' END AS error_code FROM used),
checked AS (SELECT *, error_code IS NULL AS fine,
    CASE WHEN error_code IS NULL THEN 'success'
      WHEN error_code IN ('unsupported_format', 'invalid_base64', 'unreadable_image') THEN 'error' END AS outcome FROM coded)"""

_REQUESTS = """requests AS (
  SELECT *, CASE
      WHEN NOT single AND batch_size > 20 THEN 'batch_too_large'
      WHEN single AND request_id % 11 = 0 THEN 'precheck'
      WHEN single AND request_id % 13 = 0 THEN 'ocr_failed'
      WHEN event_type = 'error' AND request_id % 17 = 0 THEN 'cancelled'
      WHEN event_type = 'error' AND request_id % 19 = 0 THEN 'crashed'
      ELSE status END AS outcome
  FROM (
    SELECT event_id AS request_id, ts, event_type, event_type IN ('view', 'click') AS single,
           CASE event_type WHEN 'view' THEN '/ocr' WHEN 'click' THEN '/ocr/json' WHEN 'purchase' THEN '/ocr/batch'
                           WHEN 'signup' THEN '/ocr/batch/json' ELSE '/ocr/jobs' END AS endpoint,
           list_extract(['en', 'de', 'fr', 'es'], user_id % 4 + 1) AS lang,
           CASE WHEN event_id % 7 = 0 THEN 'error'
                WHEN event_id % 7 = 1 AND event_type NOT IN ('view', 'click') THEN 'partial'
                ELSE 'success' END AS status,
           value AS duration,
           CASE WHEN event_type NOT IN ('view', 'click') THEN event_id % 25 + 1 END AS batch_size,
           CASE WHEN event_type = 'error' THEN 'async' WHEN event_type IN ('purchase', 'signup') THEN 'sync' END AS job_type,
           'model_' || list_extract(['en', 'de', 'fr', 'es'], user_id % 4 + 1) AS model,
           CASE WHEN user_id % 5 = 0 THEN 'gpu' ELSE 'cpu' END AS device
    FROM events)),
metered AS (SELECT * FROM requests WHERE outcome IN ('success', 'partial', 'error')),
calls AS (SELECT * FROM requests WHERE status = 'success')"""

_EVENTS = """job_events AS (
  SELECT 'job_' || user_id AS job_id, event_id AS seq, ts,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'progress'
                         WHEN 'purchase' THEN 'completed'
                         ELSE CASE WHEN event_id % 2 = 1 THEN 'failed' ELSE 'cancelled' END END AS kind,
         CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) END AS processed,
         CASE WHEN event_type = 'error' AND event_id % 2 = 1 AND event_id % 3 = 0
              THEN 'stopped at ' || event_id END AS error
  FROM events)"""

_STATE = """state AS (
  SELECT job_id,
         arg_max(kind, seq) FILTER (WHERE kind != 'progress') AS status,
         arg_min(ts, seq) FILTER (WHERE kind = 'queued') AS created_at,
         arg_min(ts, seq) FILTER (WHERE kind = 'running') AS started_at,
         arg_max(ts, seq) FILTER (WHERE kind IN ('completed', 'failed')) AS completed_at,
         arg_max(processed, seq) FILTER (WHERE processed IS NOT NULL) AS processed,
         arg_max(error, seq) FILTER (WHERE error IS NOT NULL) AS error,
         max(ts) AS last_event_at, max(seq) AS last_seq,
         arg_min(kind, seq) FILTER (WHERE kind IN ('completed', 'failed', 'cancelled')) AS first_end,
         arg_min(ts, seq) FILTER (WHERE kind IN ('completed', 'failed', 'cancelled')) AS first_end_at
  FROM job_events GROUP BY job_id)"""

_ITEMS = """job_items AS (
  SELECT 'job_' || o_custkey AS job_id, o_orderkey AS image_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(o_orderkey % 43200 AS BIGINT)) AS start_ts,
         CASE WHEN o_orderkey % 11 = 0 OR o_custkey % 13 = 0 THEN 'error' ELSE 'success' END AS status,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS idx,
         count(*) OVER (PARTITION BY o_custkey) AS n_images
  FROM orders),
accepted AS (SELECT * FROM job_items WHERE n_images <= 20)"""


def _iso(column: str) -> str:
    return (
        f"CASE WHEN date_trunc('second', {column}) = {column} THEN strftime({column}, '%Y-%m-%dT%H:%M:%SZ') "
        f"ELSE strftime({column}, '%Y-%m-%dT%H:%M:%S.%fZ') END"
    )


def _with(*tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n"


# Jobs of ten payloads, the messages about them, and how far each run got.
_RUNS = """numbers AS (
  SELECT CASE WHEN doc_id < 60 THEN doc_id // 30 ELSE doc_id // 10 END AS j, count(*) AS n,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(any_value(CASE WHEN doc_id < 60 THEN doc_id // 30 ELSE doc_id // 10 END) AS BIGINT)) AS created
  FROM documents GROUP BY 1),
messages AS (
  SELECT 'job_' || j AS job_id, 'cancel' AS kind, created + to_seconds(j * 97 % 1500) AS ts, NULL AS error FROM numbers WHERE j % 3 = 0
  UNION ALL SELECT 'job_' || j, 'cancel', created + to_seconds(j * 31 % 1500), NULL FROM numbers WHERE j % 6 = 0
  UNION ALL SELECT 'job_' || j, 'cancel', created - INTERVAL 5 SECOND, NULL FROM numbers WHERE j % 11 = 5
  UNION ALL SELECT 'job_' || j, 'crash', created + to_seconds(j * 61 % 1300), 'lost worker ' || j FROM numbers WHERE j % 4 = 0
  UNION ALL SELECT 'gone_' || j, 'cancel', created + INTERVAL 60 SECOND, NULL FROM numbers WHERE j % 50 = 0),
timed AS (SELECT 'job_' || j AS job_id, j, n, created, created + to_minutes(CAST(2 * n AS BIGINT)) AS end_at FROM numbers WHERE n <= 20),
met AS (
  SELECT t.job_id, min(ts) FILTER (kind = 'cancel') AS c, min(ts) FILTER (kind = 'crash') AS x, arg_min(error, ts) FILTER (kind = 'crash') AS crash_error
  FROM timed t JOIN messages m ON m.job_id = t.job_id AND ts >= created AND ts < end_at GROUP BY t.job_id),
granted AS (
  SELECT t.*, CASE WHEN x IS NULL OR c <= x THEN c END AS cancel_at, x, crash_error FROM timed t LEFT JOIN met USING (job_id)),
stopped AS (
  SELECT *, created + to_minutes(CAST(2 * ceil(epoch(cancel_at - created) / 120) AS BIGINT)) AS stop_at FROM granted),
run AS (
  SELECT *, CASE WHEN stop_at IS NULL OR x < stop_at THEN x END AS crash_at,
         (x IS NULL OR NOT (stop_at IS NULL OR x < stop_at)) AND (stop_at IS NULL OR stop_at >= end_at) AS whole FROM stopped)"""

_STATE_COLUMNS = ", ".join(
    ["job_id", "status"]
    + [f"{_iso(c)} AS {c}" for c in ("created_at", "started_at", "completed_at", "last_event_at")]
    + ["processed", "error", "last_seq"]
)


def _histogram(source: str, labels: list[str], value: str, bounds: list[float]) -> str:
    names = ", ".join(labels)
    rows = [
        f"SELECT {names}, 'bucket' AS sample, '{b!r}' AS le, "
        f"CAST(count(*) FILTER (WHERE {value} <= {b}) AS DOUBLE) AS value FROM {source} GROUP BY {names}"
        for b in bounds
    ]
    rows.append(f"SELECT {names}, 'bucket', '+Inf', CAST(count(*) AS DOUBLE) FROM {source} GROUP BY {names}")
    rows.append(f"SELECT {names}, 'count', NULL, CAST(count(*) AS DOUBLE) FROM {source} GROUP BY {names}")
    rows.append(f"SELECT {names}, 'sum', NULL, round(sum(CAST({value} AS DOUBLE)), 6) FROM {source} GROUP BY {names}")
    return "\nUNION ALL ".join(rows)


_SIZED = "(SELECT * FROM metered WHERE batch_size IS NOT NULL AND job_type IS NOT NULL)"
_DURATION_HIST = _histogram("metered", ["endpoint", "lang"], "duration", REQUEST_BOUNDS)
_BATCH_HIST = _histogram(_SIZED, ["job_type"], "batch_size", BATCH_SIZE_BOUNDS)
_INFERENCE_HIST = _histogram("calls", ["model", "device"], "duration", INFERENCE_BOUNDS)
_COUNTER = "SELECT endpoint, lang, status, count(*) AS value FROM metered GROUP BY ALL"
_GAUGE = """SELECT list_extract(['det', 'rec', 'cls', 'combined'], user_id % 4 + 1) AS model_type,
  CAST(arg_max(CASE WHEN value > 34 THEN 1 ELSE 0 END, event_id) AS DOUBLE) AS value FROM events GROUP BY 1"""

_OPENED = """opened AS (SELECT job_id, min(seq) AS seq FROM job_events WHERE kind = 'queued' GROUP BY job_id),
closed AS (SELECT e.job_id, min(e.seq) AS seq FROM job_events e JOIN opened o USING (job_id)
  WHERE e.kind IN ('completed', 'failed', 'cancelled') AND e.seq > o.seq GROUP BY e.job_id),
deltas AS (SELECT seq, job_id, 1 AS delta FROM opened UNION ALL SELECT seq, job_id, -1 FROM closed)"""

_STEPS = """steps AS (
  SELECT job_id, seq, kind, error, lag(kind) OVER (PARTITION BY job_id ORDER BY seq) AS prev_status
  FROM job_events WHERE kind != 'progress')"""


def _number(column: str) -> str:
    plain = f"regexp_replace(CAST(CAST(round({column}, 6) AS DECIMAL(32, 6)) AS VARCHAR), '0+$', '')"
    plain = f"CASE WHEN ends_with({plain}, '.') THEN {plain} || '0' ELSE {plain} END"
    return plain


def _exposition() -> str:
    heads = []
    for name, kind, text in METRIC_FAMILIES:
        heads.append(f"SELECT '# HELP {name} {text}' AS line")
        heads.append(f"SELECT '# TYPE {name} {kind}' AS line")
    samples = f"""SELECT 'ocr_requests_total{{endpoint="' || endpoint || '",lang="' || lang || '",status="' || status || '"}} ' AS head,
  CAST(value AS DOUBLE) AS value FROM counter
UNION ALL SELECT 'ocr_request_duration_seconds_' || sample || '{{endpoint="' || endpoint || '",lang="' || lang || '"'
  || coalesce(',le="' || le || '"', '') || '}} ', value FROM durations
UNION ALL SELECT 'ocr_batch_size_' || sample || '{{job_type="' || job_type || '"' || coalesce(',le="' || le || '"', '') || '}} ',
  value FROM sizes
UNION ALL SELECT 'ocr_job_queue_depth ', CAST(sum(delta) AS DOUBLE) FROM deltas
UNION ALL SELECT 'ocr_inference_time_seconds_' || sample || '{{device="' || device || '"' || coalesce(',le="' || le || '"', '')
  || ',model="' || model || '"}} ', value FROM inferences
UNION ALL SELECT 'model_ready{{model_type="' || model_type || '"}} ', value FROM gauge"""
    plain = _number("value")
    tables = _with(
        _REQUESTS, _EVENTS, _OPENED, f"counter AS ({_COUNTER})", f"durations AS ({_DURATION_HIST})",
        f"sizes AS ({_BATCH_HIST})", f"inferences AS ({_INFERENCE_HIST})", f"gauge AS ({_GAUGE})",
        f"samples AS ({samples})", f"texts AS (SELECT head, value, {plain} AS plain FROM samples)",
        "pointed AS (SELECT *, instr(plain, '.') - 1 AS dot, replace(plain, '.', '') AS digits FROM texts)",
    )
    return (
        tables
        + " UNION ALL ".join(heads)
        + """ UNION ALL SELECT head || CASE WHEN value > 0 AND dot > 6
  THEN rtrim(left(digits, 1) || '.' || substr(digits, 2), '0.') || 'e+0' || (dot - 1) ELSE plain END FROM pointed"""
    )


_NORMALISED = (
    _with(_RAW_LINES)
    + """SELECT r.image_id,
  CASE WHEN z.image_id IS NOT NULL THEN 'ocr_failed' END AS error_code,
  CASE WHEN z.image_id IS NOT NULL THEN 'float division by zero' END AS error_message,
  CASE WHEN z.image_id IS NULL THEN count(k.image_id) ELSE 0 END AS total_lines,
  CASE WHEN z.image_id IS NULL THEN CAST(coalesce(sum(length(k.text)), 0) AS BIGINT) ELSE 0 END AS total_characters,
  CASE WHEN z.image_id IS NULL THEN round(coalesce(avg(k.confidence), 0) + 1e-9, 6) ELSE 0 END AS avg_confidence,
  'ch_PP-OCRv4_' || r.lang AS model,
  CAST(CASE WHEN z.image_id IS NULL THEN r.width ELSE 0 END AS INTEGER) AS image_width,
  CASE WHEN z.image_id IS NULL
       THEN CAST(count(*) FILTER (WHERE k.n_points = 4 AND k.include_polygon) AS INTEGER) ELSE 0 END AS n_polygons,
  CASE WHEN z.image_id IS NULL THEN max(CASE WHEN k.n_points = 4 THEN k.x1 ELSE 0.0 END)
       FILTER (WHERE k.image_id IS NOT NULL) END AS x_max,
  CASE WHEN z.image_id IS NULL THEN max(CASE WHEN k.n_points = 4 THEN k.y1 / k.height ELSE 0.0 END)
       FILTER (WHERE k.image_id IS NOT NULL) END AS ny_max
FROM raw_images r LEFT JOIN kept_items k USING (image_id) LEFT JOIN zero_sized z USING (image_id)
GROUP BY r.image_id, r.lang, r.width, z.image_id"""
)

def _files(per_file: int) -> str:
    """Files of some documents each, in folders of 15, 20, 21 and 22 files in turn."""
    return f"""WITH files AS (
  SELECT doc_id // {per_file} AS n, string_agg(doc_id || ' ' || md5(text), ',' ORDER BY doc_id) AS body FROM documents GROUP BY 1),
placed AS (
  SELECT *, (n // 78) * 4 + CASE WHEN n % 78 < 15 THEN 0 WHEN n % 78 < 35 THEN 1 WHEN n % 78 < 56 THEN 2 ELSE 3 END AS folder FROM files)"""


# Bitmaps made of the documents, and what becomes of each.
_BITMAPS = _files(5) + """,
contents AS (
  SELECT n, folder, n % 100 + 1 + 256 * (n * 7 % 120) AS w, n % 90 + 1 + 256 * (n * 11 % 110) AS h, n % 9 != 8 AS is_image, (n % 5) / 10 AS threshold,
         CASE WHEN n % 9 != 8 THEN unhex('424D' || repeat('2E', 16) || printf('%02X', n % 100 + 1) || printf('%02X', n * 7 % 120) || '0000'
           || printf('%02X', n % 90 + 1) || printf('%02X', n * 11 % 110) || '0000') ELSE encode('no image ') END || encode(body || chr(10)) AS content
  FROM placed),
scaled AS (
  SELECT *, octet_length(content) AS size, w * h > 16777216 AS was_resized, CASE WHEN w * h > 16777216 THEN sqrt(16777216 / (w * h)) ELSE 1 END AS scale,
         row_number() OVER (PARTITION BY folder ORDER BY n) - 1 AS idx, count(*) OVER (PARTITION BY folder) AS n_images FROM contents),
judged AS (
  SELECT *, CAST(floor(w * scale) AS BIGINT) AS width, CAST(floor(h * scale) AS BIGINT) AS height,
    CASE WHEN NOT is_image THEN 'Image processing error: unsupported_format' WHEN size % 17 = 0 THEN 'engine stopped at ' || size
         WHEN size % 13 = 0 THEN 'Image processing error: confidence_range' END AS error,
    1 + CASE WHEN (size * 7 % 101) / 100 >= threshold THEN 1 ELSE 0 END + CASE WHEN 0.5 >= threshold THEN 1 ELSE 0 END AS total_lines
  FROM scaled)"""

_JOB_RUN = (
    _with(_PAYLOADS, _RUNS)
    + f""", texts AS (
  SELECT payload_id, j, idx, decode_error IS NOT NULL AS silent, bytes AS b, octet_length(bytes) AS n, (j % 5) / 10 AS threshold, CASE
    WHEN decode_error IS NOT NULL THEN 'Processing error: ' || decode_error
    WHEN coalesce(octet_length(bytes), 0) = 0 THEN 'image_empty'
    WHEN {_FORMAT.format(x="bytes")} IS NULL THEN 'unsupported_format'
    WHEN payload_id % 16 = 8 THEN 'unreadable_image: cannot identify image file'
    WHEN octet_length(bytes) % 17 = 0 THEN 'engine stopped at ' || octet_length(bytes) END AS error
  FROM (SELECT *, CASE WHEN payload_id < 60 THEN payload_id // 30 ELSE payload_id // 10 END AS j,
               CASE WHEN payload_id < 60 THEN payload_id % 30 ELSE payload_id % 10 END AS idx FROM decoded)),
checked AS (SELECT *, error IS NULL AS fine FROM texts),
{_FOUND},
reached AS (
  SELECT r.job_id, idx, silent, fine, CASE WHEN fine THEN 'image_' || idx || ':success:' || coalesce(total_lines, 0)
    ELSE 'image_' || idx || ':error:0:' || error END AS line
  FROM checked JOIN run r USING (j) LEFT JOIN found USING (payload_id)
  WHERE (cancel_at IS NULL OR created + to_minutes(CAST(2 * idx AS BIGINT)) < cancel_at)
    AND (crash_at IS NULL OR created + to_minutes(CAST(2 * idx + 2 AS BIGINT)) <= crash_at)),
progress AS (SELECT job_id, max(idx + 1) FILTER (NOT silent) AS last_write, count(*) FILTER (NOT fine) AS n_error FROM reached GROUP BY job_id),
state AS (
  SELECT r.*, CASE WHEN whole THEN r.n ELSE last_write END AS processed,
         CASE WHEN whole THEN CASE WHEN n_error = 0 THEN 'completed' ELSE 'failed' END WHEN crash_at IS NOT NULL THEN 'failed' ELSE 'cancelled' END AS status
  FROM run r LEFT JOIN progress USING (job_id)),
shown AS (SELECT job_id, string_agg(line, ';' ORDER BY idx) AS results FROM reached JOIN state USING (job_id) WHERE idx < processed GROUP BY job_id),
asked AS (SELECT 'job_' || j AS job_id FROM numbers UNION SELECT job_id FROM messages)
SELECT job_id, status, {_iso("created")} AS created_at, {_iso("created")} AS started_at,
  CASE WHEN whole THEN {_iso("end_at")} WHEN crash_at IS NOT NULL THEN {_iso("crash_at")} END AS completed_at,
  processed, n AS total, results, CASE WHEN crash_at IS NOT NULL THEN crash_error END AS error,
  CASE WHEN status IS NULL THEN 'job_not_found' END AS error_code, CASE WHEN status IS NULL THEN 'Job ' || job_id || ' not found' END AS error_detail,
  CASE WHEN status IS NULL THEN 404 WHEN status = 'failed' THEN 500 ELSE 200 END AS http_status
FROM asked LEFT JOIN state USING (job_id) LEFT JOIN shown USING (job_id)"""
)

_ANSWERED = (
    _with(_PAYLOADS) + _ASKED + """
SELECT endpoint, lang, outcome AS status, count(*) AS value FROM checked WHERE outcome IS NOT NULL GROUP BY ALL"""
)

_INFERRED = (
    _with(_PAYLOADS)
    + f"""SELECT 'ch_PP-OCRv4_' || lang AS model, 'cpu' AS device, count(*) AS n FROM decoded
WHERE decode_error IS NULL AND octet_length(bytes) > 0 AND {_FORMAT.format(x="bytes")} IS NOT NULL
  AND payload_id % 16 != 8 AND octet_length(bytes) % 17 != 0 GROUP BY lang"""
)

# In the order of the families.
_HEADS = "\n".join(f"# HELP {name} {text}\n# TYPE {name} {kind}" for name, kind, text in METRIC_FAMILIES)

_SUBMITTED = _with(_EVENTS) + "SELECT DISTINCT job_id FROM job_events WHERE kind = 'queued'"

_EXPIRED = (
    _with(_EVENTS)
    + """, mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM job_events WHERE kind = 'queued')
SELECT job_id FROM job_events WHERE kind = 'queued' GROUP BY job_id
HAVING date_trunc('milliseconds', min(ts)) + INTERVAL 24 HOUR <= (SELECT w FROM mark)"""
)

_STORED = (
    _with(_EVENTS, _STATE)
    + """SELECT job_id, CASE WHEN status = 'running' THEN 'completed' ELSE status END AS status, processed, last_seq
FROM state WHERE CAST(substr(job_id, 5) AS BIGINT) % 5 != 0"""
)

_FOLD = _with(_EVENTS, _STATE) + f"SELECT {_STATE_COLUMNS} FROM state"

ORACLE: dict[str, str] = {
    "r_image_summary": _with(_IMAGES, _DETECTIONS, _KEPT, _SUMMARY)
    + """SELECT image_id, coalesce(total_lines, 0) AS total_lines,
  CAST(coalesce(total_characters, 0) AS BIGINT) AS total_characters,
  round(coalesce(avg_confidence, 0) + 1e-9, 6) AS avg_confidence
FROM images LEFT JOIN summary USING (image_id)""",
    "r_bbox": _with(_IMAGES, _DETECTIONS, _KEPT)
    + """SELECT image_id, line_no, part_key, supp_key, text, confidence, 'text' AS type,
  CASE WHEN line_no != 7 THEN x0 ELSE 0.0 END AS x_min,
  CASE WHEN line_no != 7 THEN y0 ELSE 0.0 END AS y_min,
  CASE WHEN line_no != 7 THEN x0 + 50 ELSE 0.0 END AS x_max,
  CASE WHEN line_no != 7 THEN y0 + 20 ELSE 0.0 END AS y_max,
  CASE WHEN line_no != 7 THEN x0 / width ELSE 0.0 END AS nx_min,
  CASE WHEN line_no != 7 THEN y0 / height ELSE 0.0 END AS ny_min,
  CASE WHEN line_no != 7 THEN (x0 + 50) / width ELSE 0.0 END AS nx_max,
  CASE WHEN line_no != 7 THEN (y0 + 20) / height ELSE 0.0 END AS ny_max,
  CASE WHEN line_no != 7 AND include_polygon THEN 4 ELSE 0 END AS n_points
FROM kept""",
    "r_flatten": _with(_RAW_LINES)
    + """SELECT image_id, CAST(det_idx AS INTEGER) AS det_idx, text, confidence, n_points FROM items""",
    "r_normalise": _NORMALISED,
    "x_normalise": _NORMALISED,
    "r_response_json": _with(_RAW_LINES)
    + """, results AS (
  SELECT image_id, list(struct_pack(
      text := text, confidence := confidence,
      bbox := struct_pack(top_left := CASE WHEN n_points = 4 THEN [x0::DOUBLE, y0] ELSE [0.0::DOUBLE, 0.0::DOUBLE] END,
                          bottom_right := CASE WHEN n_points = 4 THEN [x1, y1] ELSE [0.0::DOUBLE, 0.0::DOUBLE] END),
      bbox_normalized := struct_pack(
          top_left := CASE WHEN n_points = 4 THEN [x0::DOUBLE / width, y0 / height] ELSE [0.0::DOUBLE, 0.0::DOUBLE] END,
          bottom_right := CASE WHEN n_points = 4 THEN [x1 / width, y1 / height] ELSE [0.0::DOUBLE, 0.0::DOUBLE] END),
      "type" := 'text',
      polygon := CASE WHEN n_points = 4 AND include_polygon
                      THEN [[x0::DOUBLE, y0], [x1, y0], [x1, y1], [x0::DOUBLE, y1]] ELSE [] END) ORDER BY det_idx) AS results,
    count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(confidence) + 1e-9, 6) AS mean
  FROM kept_items GROUP BY image_id)
SELECT image_id, CASE WHEN image_id IN (SELECT image_id FROM zero_sized) THEN CAST(to_json(struct_pack(
  error := 'ocr_failed', detail := 'float division by zero', request_id := 'req_' || image_id)) AS VARCHAR)
ELSE CAST(to_json(struct_pack(
  request_id := 'req_' || image_id, status := 'success',
  meta := struct_pack(engine := 'ocr', engine_version := '3.5.0', model := 'ch_PP-OCRv4_' || lang, lang := lang,
    inference_time_ms := 0, image_width := width, image_height := height, was_resized := false),
  results := coalesce(results, []),
  summary := struct_pack(total_lines := coalesce(n, 0), total_characters := coalesce(chars, 0),
    avg_confidence := coalesce(mean, 0.0::DOUBLE)))) AS VARCHAR) END AS response
FROM raw_images LEFT JOIN results USING (image_id)""",
    "r_response_parts": _with(_IMAGES, _DETECTIONS, _KEPT, _SUMMARY)
    + """, parts AS (
  SELECT image_id, CAST(det_idx // 4 AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS n_results,
         string_agg(text, '|' ORDER BY det_idx) AS texts
  FROM kept GROUP BY 1, 2)
SELECT image_id, coalesce(part, 0) AS part, coalesce(n_results, 0) AS n_results, coalesce(texts, '') AS texts,
  coalesce(total_lines, 0) AS total_lines, round(coalesce(avg_confidence, 0) + 1e-9, 6) AS avg_confidence,
  'ch_PP-OCRv4_' || lang AS model
FROM images LEFT JOIN summary USING (image_id) LEFT JOIN parts USING (image_id)""",
    "r_error_rows": _with(_IMAGES, _DETECTIONS, _KEPT, _SUMMARY)
    + """, sized AS (
  SELECT *, CAST(width AS BIGINT) * height AS pixels, (16777216::DOUBLE / (CAST(width AS BIGINT) * height)) ** 0.5 AS scale
  FROM images)
SELECT image_id, status,
  CASE WHEN status = 'error' THEN 'ocr_failed' END AS error_code,
  CASE WHEN status = 'error' THEN 'engine failed on ' || image_id END AS error_message,
  'ch_PP-OCRv4_' || lang AS model,
  CAST(CASE WHEN status = 'error' THEN 0 WHEN pixels > 16777216 THEN floor(width * scale) ELSE width END AS INTEGER) AS image_width,
  CAST(CASE WHEN status = 'error' THEN 0 WHEN pixels > 16777216 THEN floor(height * scale) ELSE height END AS INTEGER) AS image_height,
  status = 'success' AND pixels > 16777216 AS was_resized,
  CASE WHEN status = 'success' THEN coalesce(total_lines, 0) ELSE 0 END AS total_lines,
  CASE WHEN status = 'success' THEN round(coalesce(avg_confidence, 0) + 1e-9, 6) ELSE 0 END AS avg_confidence
FROM sized LEFT JOIN summary USING (image_id)""",
    "v_output_check": """WITH tests AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_filter([
      CASE WHEN round(abs(l_discount) * 12, 6) > 1 THEN 'confidence_range' END,
      CASE WHEN round(abs(l_tax) * 15, 6) > 1 THEN 'avg_confidence_range' END,
      CASE WHEN l_quantity < 3 THEN 'negative_size' END,
      CASE WHEN l_linenumber = 7 THEN 'bbox_length' END], lambda x: x IS NOT NULL) AS broken
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(array_to_string(broken, ','), '') AS violations,
  CAST(len(broken) AS INTEGER) AS n_violations FROM tests""",
    "b_batch_status": _with(_IMAGES)
    + """, counts AS (
  SELECT batch_id, count(*) AS n_images, count(*) FILTER (WHERE status = 'success') AS ok,
         count(*) FILTER (WHERE status = 'error') AS bad FROM images GROUP BY batch_id)
SELECT batch_id, n_images, CASE WHEN n_images > 20 THEN 0 ELSE ok END AS n_success,
  CASE WHEN n_images > 20 THEN 0 ELSE bad END AS n_error,
  CASE WHEN n_images > 20 THEN 'rejected' WHEN bad = 0 THEN 'success' WHEN ok > 0 THEN 'partial' ELSE 'error' END AS status,
  CASE WHEN n_images > 20 THEN 'batch_too_large' END AS error_code,
  CASE WHEN n_images > 20 THEN 'Batch size ' || n_images || ' exceeds maximum 20' END AS error_detail,
  CASE WHEN n_images > 20 THEN 400 ELSE 200 END AS http_status
FROM counts""",
    "b_batch_results": _with(_IMAGES)
    + """, placed AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY image_id) - 1 AS idx,
         count(*) OVER (PARTITION BY batch_id) AS n_images FROM images)
SELECT batch_id, CAST(count(*) AS INTEGER) AS n_results,
  string_agg(CASE WHEN filename = '' THEN 'image_' || idx ELSE filename END || '=' || status, ',' ORDER BY idx) AS results
FROM placed WHERE n_images <= 20 GROUP BY batch_id""",
    "b_item_errors": _with(_PAYLOADS)
    + f""", used AS (
  SELECT *, CASE WHEN endpoint = '/ocr/json' THEN bytes ELSE content END AS b,
         CASE WHEN endpoint = '/ocr/json' THEN decode_error END AS e FROM decoded),
texts AS (
  SELECT payload_id, CASE
    WHEN e IS NOT NULL THEN 'Image processing error: ' || e
    WHEN coalesce(octet_length(b), 0) = 0
      THEN CASE WHEN endpoint = '/ocr/json' THEN 'Image data is empty' ELSE 'Image file is empty' END
    WHEN octet_length(b) > 10000 THEN 'Image exceeds maximum size of 10000 bytes'
    WHEN {_FORMAT.format(x="b")} IS NULL THEN 'Image processing error: unsupported_format'
    WHEN payload_id % 17 = 0 THEN CASE WHEN payload_id % 2 = 0 THEN 'engine stopped' ELSE 'OCR failed' END
    WHEN payload_id % 19 = 0 THEN 'Unexpected error: disk gone' END AS error
  FROM used)
SELECT payload_id, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error FROM texts""",
    "v_decode": _with(_PAYLOADS)
    + """SELECT payload_id, CAST(octet_length(bytes) AS INTEGER) AS n_bytes, md5(bytes) AS content_md5, decode_error AS error,
  md5('data:image/png;base64,' || to_base64(bytes)) AS uri_md5 FROM decoded""",
    "v_format": _with(_PAYLOADS)
    + f""", found AS (
  SELECT payload_id, {_FORMAT.format(x="content")} AS format,
         list_extract(['.jpg', '.JPEG', '.png', '.gif', '.tif', '.webp', '', '.txt'], payload_id % 8 + 1) AS suffix
  FROM contents)
SELECT payload_id, format, CASE format WHEN 'jpeg' THEN '.jpg' ELSE '.' || format END AS extension,
  lower(suffix) AS path_extension,
  lower(suffix) IN ('.jpg', '.jpeg', '.png', '.bmp', '.tiff', '.tif', '.webp') AS is_allowed FROM found""",
    "v_chain": _with(_PAYLOADS)
    + f""", used AS (
  SELECT *, (payload_id % 13) / 10 AS conf, CASE WHEN endpoint = '/ocr/json' THEN bytes ELSE content END AS b,
         CASE WHEN endpoint = '/ocr/json' THEN decode_error END AS e FROM decoded),
found AS (
  SELECT *, {_FORMAT.format(x="b")} AS format FROM used),
messages AS (
  SELECT *, CASE
    WHEN e IS NOT NULL THEN e
    WHEN coalesce(octet_length(b), 0) = 0 THEN 'image_empty'
    WHEN octet_length(b) > 10000 THEN 'file_too_large: size ' || octet_length(b) || ' exceeds 10000'
    WHEN format IS NULL THEN 'unsupported_format'
    WHEN format = 'png' AND (octet_length(b) < 24 OR substr(hex(b), 25, 8) != '49484452')
      THEN 'unreadable_image: cannot identify image file'
    WHEN format = 'bmp' AND octet_length(b) < 26 THEN 'unreadable_image: cannot identify image file' END AS message
  FROM found),
codes AS (
  SELECT *, CASE
    WHEN message IS NULL THEN NULL
    WHEN message = 'image_empty' THEN 'image_empty'
    WHEN starts_with(message, 'file_too_large') THEN 'file_too_large'
    WHEN endpoint = '/ocr' AND message = 'unsupported_format' THEN 'unsupported_format'
    WHEN endpoint = '/ocr/json' AND starts_with(message, 'Invalid base64') THEN 'invalid_base64'
    ELSE 'unreadable_image' END AS error_code FROM messages)
SELECT payload_id, endpoint,
  CASE WHEN endpoint = '/ocr/json' AND trim(payload, ' ' || chr(9)) = '' THEN 'image_blank'
       WHEN conf > 1 THEN 'min_confidence_range' END AS violation,
  error_code,
  CASE error_code WHEN 'image_empty' THEN 400 WHEN 'invalid_base64' THEN 400 WHEN 'file_too_large' THEN 413
    WHEN 'unsupported_format' THEN 415 WHEN 'unreadable_image' THEN 422 ELSE 200 END AS http_status,
  CASE error_code
    WHEN 'image_empty' THEN CASE WHEN endpoint = '/ocr' THEN 'Image file is empty' ELSE 'Image data is empty' END
    WHEN 'invalid_base64' THEN 'Invalid base64 encoded image data'
    WHEN 'file_too_large' THEN CASE WHEN endpoint = '/ocr' THEN 'Image size ' || octet_length(b) || ' exceeds maximum 10000'
                                    ELSE 'Image size exceeds maximum 10000 bytes' END
    WHEN 'unsupported_format' THEN 'Unsupported image format. Allowed: JPEG, PNG, BMP, TIFF, WebP'
    WHEN 'unreadable_image' THEN 'Cannot process image: ' || message END AS error_detail
FROM codes""",
    "v_params": """WITH given AS (
  SELECT event_id,
    CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN list_extract(['en', 'de', 'fr', 'es'], event_id % 4 + 1) END AS x_lang,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE 'auto' END AS body_lang,
    CASE event_id % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN (event_id % 10) / 10 END AS x_conf,
    (event_id % 11) / 20 AS body_conf, event_id % 2 = 0 AS is_json
  FROM events)
SELECT event_id,
  coalesce(nullif(x_lang, ''), CASE WHEN is_json THEN nullif(body_lang, '') END, 'en') AS lang,
  coalesce(nullif(x_conf, 0.0), CASE WHEN is_json THEN body_conf ELSE 0.0 END) AS min_confidence
FROM given""",
    "v_resize_plan": _with(_IMAGES)
    + """, sized AS (
  SELECT *, CAST(width AS BIGINT) * height AS pixels, (3355443::DOUBLE / (CAST(width AS BIGINT) * height)) ** 0.5 AS scale,
    list_extract(['RGB', 'RGBA', 'L', '1', 'P', 'CMYK', 'LA'], image_id % 7 + 1) AS mode FROM images)
SELECT image_id, width, height, pixels > 3355443 AS was_resized,
  CAST(CASE WHEN pixels > 3355443 THEN floor(width * scale) ELSE width END AS BIGINT) AS new_width,
  CAST(CASE WHEN pixels > 3355443 THEN floor(height * scale) ELSE height END AS BIGINT) AS new_height,
  mode, CASE WHEN mode = 'RGBA' THEN 'flatten' WHEN mode IN ('RGB', 'L', '1') THEN 'keep' ELSE 'convert' END AS action
FROM sized""",
    "v_dimensions": """WITH made AS (
  SELECT doc_id, 1 + doc_id % 3000 AS w, 1 + n_chars % 2000 AS h,
    CASE WHEN doc_id % 4 = 0 THEN 'png' WHEN doc_id % 4 = 1 THEN 'bmp' WHEN doc_id % 8 = 3 THEN 'tiff' ELSE 'jpeg' END AS format,
    CASE WHEN doc_id % 4 = 0 THEN list_extract(['L', 'RGB', 'P', 'LA', 'RGBA', 'RGB'], doc_id % 6 + 1) END AS mode
  FROM documents)
SELECT doc_id, format, CASE WHEN doc_id % 4 < 3 THEN w END AS width, CASE WHEN doc_id % 4 < 3 THEN h END AS height,
  CASE WHEN doc_id % 4 < 3 THEN NULL WHEN format = 'tiff' THEN 'size_not_read' ELSE 'unreadable_header' END AS reason,
  mode, CASE WHEN mode = 'RGBA' THEN 'flatten' WHEN mode IN ('RGB', 'L') THEN 'keep' WHEN mode IS NOT NULL THEN 'convert' END AS action
FROM made""",
    "v_blank": """WITH hist AS (
  SELECT l_orderkey AS image_id, CASE WHEN l_orderkey % 3 = 0 THEN l_partkey % 16 + 240 ELSE l_partkey % 256 END AS level,
         CAST(l_quantity AS BIGINT) AS n FROM lineitem),
counts AS (
  SELECT image_id, CAST(max(level) FILTER (WHERE n > 0) AS INTEGER) AS max_level,
    CAST(coalesce(sum(n) FILTER (WHERE level >= 240), 0) AS BIGINT) AS bright_pixels, CAST(sum(n) AS BIGINT) AS pixels
  FROM hist GROUP BY image_id)
SELECT *, coalesce(max_level >= 250 AND bright_pixels / nullif(pixels, 0) > 0.95, false) AS is_blank FROM counts""",
    "m_counter": _with(_REQUESTS) + _COUNTER,
    "m_duration_hist": _with(_REQUESTS) + _DURATION_HIST,
    "m_batch_hist": _with(_REQUESTS) + _BATCH_HIST,
    "m_inference_hist": _with(_REQUESTS) + _INFERENCE_HIST,
    "m_metered": _with(_REQUESTS)
    + """SELECT endpoint, outcome, outcome IN ('success', 'partial', 'error') AS is_metered, count(*) AS n,
  CAST(sum(CAST(trunc(duration * 1000) AS BIGINT)) AS BIGINT) AS ms FROM requests GROUP BY ALL""",
    "m_gauge": _GAUGE,
    "m_queue_depth": _with(_EVENTS, _OPENED)
    + "SELECT seq, job_id, delta, CAST(sum(delta) OVER (ORDER BY seq) AS BIGINT) AS depth FROM deltas",
    "x_queue_depth": _with(_EVENTS, _OPENED)
    + "SELECT seq, job_id, delta, CAST(sum(delta) OVER (ORDER BY seq) AS BIGINT) AS depth FROM deltas",
    "m_queue_depth_literal": _with(_EVENTS, _STEPS)
    + """, deltas AS (
  SELECT seq, job_id, CASE WHEN kind = 'queued' THEN 1 WHEN kind = 'cancelled' AND prev_status = 'running' THEN -2
    WHEN kind = 'cancelled' THEN -1 WHEN kind = 'failed' AND error IS NOT NULL THEN -1 ELSE 0 END AS delta FROM steps)
SELECT seq, job_id, delta, CAST(sum(delta) OVER (ORDER BY seq) AS BIGINT) AS depth FROM deltas WHERE delta != 0""",
    "m_exposition": _exposition(),
    "s_metrics_text": f"""WITH printed AS ({_exposition()})
SELECT count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line)) AS lines_md5, '{_HEADS}' AS heads FROM printed""",
    "j_create": f"""WITH sized AS (
  SELECT o_custkey, count(*) AS n, min(o_orderdate) AS created FROM orders GROUP BY o_custkey),
timed AS (
  SELECT 'job_' || left(sha256('customer|' || o_custkey), 12) AS job_id, n, created,
         created + to_minutes(CAST(2 * n AS BIGINT)) AS done FROM sized WHERE n <= 20)
SELECT job_id, 'queued' AS status, {_iso("created")} AS created_at, '/ocr/jobs/' || job_id AS status_url,
  {_iso("done")} AS estimated_completion, CAST(0 AS BIGINT) AS processed, n AS total, true AS parses_back FROM timed""",
    "j_fold": _FOLD,
    "x_job_state": _FOLD,
    "j_fold_terminal_wins": _with(_EVENTS, _STATE)
    + """, final AS (SELECT * REPLACE (coalesce(first_end, status) AS status,
    CASE WHEN first_end IN ('completed', 'failed') THEN first_end_at END AS completed_at) FROM state)
"""
    + f"SELECT {_STATE_COLUMNS} FROM final",
    "j_transitions": _with(_EVENTS, _STEPS)
    + """SELECT job_id, seq, kind, prev_status,
  (coalesce(prev_status, ''), kind) IN (('', 'queued'), ('queued', 'running'), ('queued', 'cancelled'),
    ('running', 'completed'), ('running', 'failed'), ('running', 'cancelled')) AS is_legal FROM steps""",
    "j_progress": _with(_ITEMS)
    + "SELECT job_id, idx, image_id, CAST(idx + 1 AS INTEGER) AS processed, n_images AS total FROM accepted",
    "j_progress_writes": _with(_ITEMS)
    + """SELECT job_id, idx AS step, CAST(idx + 1 AS INTEGER) AS processed, n_images AS total FROM accepted WHERE image_id % 6 != 0
UNION ALL SELECT DISTINCT job_id, CAST(n_images AS INTEGER), CAST(n_images AS INTEGER), n_images FROM accepted""",
    "j_outcome": _with(_ITEMS)
    + """, counts AS (SELECT job_id, count(*) FILTER (WHERE status = 'success') AS n_success,
    count(*) FILTER (WHERE status = 'error') AS n_error FROM accepted GROUP BY job_id)
SELECT *, CASE WHEN n_error = 0 THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN n_error = 0 THEN 'success' WHEN n_success > 0 THEN 'partial' ELSE 'error' END AS request_status FROM counts""",
    "j_pending": _with(_EVENTS, _STATE, _ITEMS)
    + """SELECT job_id, idx, image_id FROM accepted
WHERE job_id IN (SELECT job_id FROM state WHERE status = 'running') AND image_id % 3 = 0""",
    "j_cancel": _with(_EVENTS, _STATE)
    + f""", asked AS (SELECT 'job_' || c_custkey AS job_id FROM customer)
SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'cancelled' ELSE status END AS status,
  CASE WHEN status IN ('queued', 'running') THEN {_iso("created_at")} END AS created_at,
  CASE WHEN status IS NULL THEN 'job_not_found' WHEN status NOT IN ('queued', 'running') THEN 'cannot_cancel' END AS error_code,
  CASE WHEN status IS NULL THEN 'Job ' || job_id || ' not found'
       WHEN status NOT IN ('queued', 'running') THEN 'Job with status ''' || status || ''' cannot be cancelled' END AS error_detail,
  CASE WHEN status IS NULL THEN 404 WHEN status IN ('queued', 'running') THEN 200 ELSE 400 END AS http_status
FROM asked LEFT JOIN state USING (job_id)""",
    "j_known": _with(_EVENTS)
    + """SELECT 'job_' || c_custkey AS job_id, 'job_' || c_custkey IN (SELECT job_id FROM job_events) AS is_known FROM customer""",
    "j_effective_images": _with(_EVENTS, _ITEMS)
    + f""", cancels AS (SELECT job_id, min(ts) AS cancel_ts FROM job_events WHERE kind = 'cancelled' GROUP BY job_id)
SELECT job_id, idx, image_id, {_iso("cancel_ts")} AS cancel_at FROM accepted LEFT JOIN cancels USING (job_id)
WHERE cancel_ts IS NULL OR start_ts < cancel_ts""",
    "j_status_view": _with(_EVENTS, _STATE, _ITEMS)
    + f""", asked AS (SELECT 'job_' || c_custkey AS job_id FROM customer),
totals AS (SELECT job_id, count(*) AS total FROM accepted GROUP BY job_id),
shown AS (SELECT job_id, string_agg('image_' || idx || '=' || status, ',' ORDER BY idx) AS results
  FROM accepted WHERE image_id % 3 != 0 GROUP BY job_id)
SELECT job_id, status, {_iso("created_at")} AS created_at, {_iso("started_at")} AS started_at,
  {_iso("completed_at")} AS completed_at, processed, total, results, error,
  CASE WHEN status IS NULL THEN 'job_not_found' END AS error_code,
  CASE WHEN status IS NULL THEN 'Job ' || job_id || ' not found' END AS error_detail,
  CASE WHEN status IS NULL THEN 404 WHEN status = 'failed' THEN 500 ELSE 200 END AS http_status
FROM asked LEFT JOIN state USING (job_id) LEFT JOIN shown USING (job_id) LEFT JOIN totals USING (job_id)""",
    "j_ttl_fixed": _with(_EVENTS, _STATE)
    + f""", aged AS (SELECT job_id, created_at AS since,
    coalesce(TIMESTAMP '2024-01-30 12:00:00' - created_at > INTERVAL 24 HOUR, false) AS is_expired FROM state)
SELECT job_id, {_iso("since")} AS since, is_expired, CASE WHEN is_expired THEN 404 ELSE 200 END AS http_status FROM aged""",
    "j_ttl_sliding": _with(_EVENTS, _STATE)
    + f""", aged AS (SELECT job_id, last_event_at AS since,
    TIMESTAMP '2024-01-30 12:00:00' - last_event_at > INTERVAL 24 HOUR AS is_expired FROM state)
SELECT job_id, {_iso("since")} AS since, is_expired, CASE WHEN is_expired THEN 404 ELSE 200 END AS http_status FROM aged""",
    "j_alive": _with(_EVENTS, _STATE)
    + f"""SELECT job_id, status, {_iso("created_at")} AS created_at FROM state
WHERE NOT coalesce(TIMESTAMP '2024-01-04 06:00:00' - created_at > INTERVAL 24 HOUR, false)""",
    "j_days": _with(_EVENTS, _STATE)
    + """SELECT job_id, status FROM state
WHERE CAST(created_at AS DATE) IN (SELECT CAST(ts AS DATE) FROM job_events WHERE error IS NOT NULL AND seq % 5 = 0)""",
    "j_lookup": _with(_EVENTS, _STATE)
    + "SELECT 'job_' || c_custkey AS job_id, status, processed, error FROM customer LEFT JOIN state ON state.job_id = 'job_' || c_custkey",
    "j_list": _with(_EVENTS, _STATE)
    + """SELECT job_id, status FROM (SELECT job_id, status FROM state ORDER BY job_id DESC LIMIT 100) WHERE status = 'failed'""",
    "j_list_filter_first": _with(_EVENTS, _STATE)
    + "SELECT job_id, status FROM state WHERE status = 'failed' ORDER BY job_id DESC LIMIT 100",
    "j_job_run": _JOB_RUN,
    "x_job_run": _JOB_RUN,
    "j_cancel_run": _with(_RUNS)
    + f"""SELECT m.job_id, {_iso("ts")} AS ts, CASE WHEN ts = cancel_at THEN 'cancelled' END AS status,
  CASE WHEN r.job_id IS NULL OR ts < created THEN 'job_not_found' WHEN ts = cancel_at THEN NULL ELSE 'cannot_cancel' END AS error_code,
  CASE WHEN r.job_id IS NULL OR ts < created THEN 404 WHEN ts = cancel_at THEN 200 ELSE 400 END AS http_status
FROM messages m LEFT JOIN run r USING (job_id) WHERE kind = 'cancel'""",
    "j_run": _with(_PAYLOADS)
    + f""", texts AS (
  SELECT payload_id, iw, ih, bytes AS b, octet_length(bytes) AS n, (payload_id % 5) / 10 AS threshold, CASE
    WHEN decode_error IS NOT NULL THEN 'Processing error: ' || decode_error
    WHEN coalesce(octet_length(bytes), 0) = 0 THEN 'image_empty'
    WHEN {_FORMAT.format(x="bytes")} IS NULL THEN 'unsupported_format'
    WHEN payload_id % 16 = 8 THEN 'unreadable_image: cannot identify image file'
    WHEN octet_length(bytes) % 17 = 0 THEN 'engine stopped at ' || octet_length(bytes) END AS error
  FROM decoded),
checked AS (SELECT *, error IS NULL AS fine FROM texts),
{_FOUND}
SELECT 'job_' || (payload_id // 10) AS job_id, CAST(payload_id % 10 AS INTEGER) AS idx,
  'image_' || (payload_id % 10) AS filename, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error,
  {_ANSWER}
FROM checked LEFT JOIN found USING (payload_id)""",
    "b_documents": _with(_PAYLOADS)
    + f""", texts AS (
  SELECT payload_id, iw, ih, bytes AS b, octet_length(bytes) AS n, (payload_id % 5) / 10 AS threshold, CASE
    WHEN decode_error IS NOT NULL THEN 'Image processing error: ' || decode_error
    WHEN coalesce(octet_length(bytes), 0) = 0 THEN 'Image data is empty'
    WHEN {_FORMAT.format(x="bytes")} IS NULL THEN 'Image processing error: unsupported_format'
    WHEN payload_id % 16 = 8 THEN 'Image processing error: unreadable_image: cannot identify image file'
    WHEN octet_length(bytes) % 17 = 0 THEN 'engine stopped at ' || octet_length(bytes) END AS error
  FROM decoded),
checked AS (SELECT *, error IS NULL AS fine FROM texts),
{_FOUND},
listed AS (SELECT CASE WHEN payload_id < 60 THEN payload_id // 30 ELSE payload_id // 10 END AS batch_id,
  CASE WHEN payload_id < 60 THEN payload_id % 30 ELSE payload_id % 10 END AS idx, payload_id, fine, error, coalesce(total_lines, 0) AS total_lines
  FROM checked LEFT JOIN found USING (payload_id)),
named AS (SELECT *, CASE WHEN payload_id % 3 = 0 THEN 'file_' || payload_id ELSE 'image_' || idx END AS filename FROM listed),
packed AS (SELECT batch_id, count(*) AS n_images, count(*) FILTER (fine) AS n_success,
  string_agg(CASE WHEN fine THEN filename || '|success|' || batch_id || '|' || total_lines ELSE filename || '|error|' || error END, ';' ORDER BY idx) AS results
  FROM named GROUP BY batch_id)
SELECT batch_id, n_images,
  CASE WHEN n_images > 20 THEN 'rejected' WHEN n_success = n_images THEN 'success' WHEN n_success > 0 THEN 'partial' ELSE 'error' END AS status,
  CASE WHEN n_images > 20 THEN 400 ELSE 200 END AS http_status, CAST(batch_id AS VARCHAR) AS request_id,
  CASE WHEN n_images > 20 THEN 'batch_too_large' END AS error,
  CASE WHEN n_images > 20 THEN 'Batch size ' || n_images || ' exceeds maximum 20' END AS detail,
  CASE WHEN n_images <= 20 THEN results END AS results
FROM packed""",
    "b_batch_run": _with(_PAYLOADS)
    + f""", texts AS (
  SELECT payload_id, iw, ih, bytes AS b, octet_length(bytes) AS n, (payload_id % 5) / 10 AS threshold, CASE
    WHEN decode_error IS NOT NULL THEN 'Image processing error: ' || decode_error
    WHEN coalesce(octet_length(bytes), 0) = 0 THEN 'Image data is empty'
    WHEN {_FORMAT.format(x="bytes")} IS NULL THEN 'Image processing error: unsupported_format'
    WHEN payload_id % 16 = 8 THEN 'Image processing error: unreadable_image: cannot identify image file'
    WHEN octet_length(bytes) % 17 = 0 THEN 'engine stopped at ' || octet_length(bytes) END AS error
  FROM decoded),
checked AS (SELECT *, error IS NULL AS fine FROM texts),
{_FOUND}
SELECT payload_id // 10 AS batch_id, CAST(payload_id % 10 AS INTEGER) AS idx,
  CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error, {_ANSWER}
FROM checked LEFT JOIN found USING (payload_id)""",
    "r_single_requests": _with(_PAYLOADS)
    + f""", used AS (
  SELECT payload_id, endpoint, iw, ih, (payload_id % 5) / 10 AS threshold,
         CASE WHEN endpoint = '/ocr/json' THEN bytes ELSE content END AS b,
         CASE WHEN endpoint = '/ocr/json' THEN decode_error END AS e FROM decoded),
coded AS (
  SELECT *, octet_length(b) AS n, CASE
    WHEN e IS NOT NULL THEN 'invalid_base64'
    WHEN coalesce(octet_length(b), 0) = 0 THEN 'image_empty'
    WHEN {_FORMAT.format(x="b")} IS NULL
      THEN CASE WHEN endpoint = '/ocr' THEN 'unsupported_format' ELSE 'unreadable_image' END
    WHEN payload_id % 16 = 8 THEN 'unreadable_image'
    WHEN octet_length(b) % 17 = 0 THEN 'ocr_failed' END AS error_code FROM used),
checked AS (SELECT *, error_code IS NULL AS fine FROM coded),
{_FOUND}
SELECT payload_id, CASE WHEN fine THEN 'success' ELSE 'error' END AS status, error_code,
  CASE error_code WHEN 'image_empty' THEN 400 WHEN 'invalid_base64' THEN 400 WHEN 'file_too_large' THEN 413
    WHEN 'unsupported_format' THEN 415 WHEN 'unreadable_image' THEN 422 WHEN 'ocr_failed' THEN 500 ELSE 200 END AS http_status,
  CASE error_code
    WHEN 'image_empty' THEN CASE WHEN endpoint = '/ocr' THEN 'Image file is empty' ELSE 'Image data is empty' END
    WHEN 'invalid_base64' THEN 'Invalid base64 encoded image data'
    WHEN 'unsupported_format' THEN 'Unsupported image format. Allowed: JPEG, PNG, BMP, TIFF, WebP'
    WHEN 'unreadable_image' THEN CASE WHEN payload_id % 16 = 8 THEN 'Cannot process image: unreadable_image: cannot identify image file'
                                      ELSE 'Cannot process image: unsupported_format' END
    WHEN 'ocr_failed' THEN 'engine stopped at ' || n END AS error_detail,
  {_ANSWER}
FROM checked LEFT JOIN found USING (payload_id)""",
    "r_single_answers": _with(_PAYLOADS) + _ASKED + f""",
{_FOUND}
SELECT payload_id,
  CASE error_code WHEN 'image_empty' THEN 400 WHEN 'invalid_base64' THEN 400 WHEN 'unsupported_format' THEN 415
    WHEN 'unreadable_image' THEN 422 WHEN 'ocr_failed' THEN 500 ELSE 200 END AS http_status,
  outcome, lang, threshold AS min_confidence, 'req_' || payload_id AS request_id,
  CASE WHEN NOT fine THEN CAST(to_json(struct_pack(error := error_code, detail := CASE error_code
    WHEN 'image_empty' THEN CASE WHEN endpoint = '/ocr' THEN 'Image file is empty' ELSE 'Image data is empty' END
    WHEN 'invalid_base64' THEN 'Invalid base64 encoded image data'
    WHEN 'unsupported_format' THEN 'Unsupported image format. Allowed: JPEG, PNG, BMP, TIFF, WebP'
    WHEN 'unreadable_image' THEN CASE WHEN payload_id % 16 = 8 THEN 'Cannot process image: unreadable_image: cannot identify image file'
                                      ELSE 'Cannot process image: unsupported_format' END
    WHEN 'ocr_failed' THEN 'engine stopped at ' || n END, request_id := 'req_' || payload_id)) AS VARCHAR) END AS error_document,
  CASE WHEN fine THEN 'success' END AS status, CASE WHEN fine THEN coalesce(total_lines, 0) END AS total_lines,
  CASE WHEN fine THEN 'ch_PP-OCRv4_' || lang END AS model, split_part(texts, ',', 1) AS first_text
FROM checked LEFT JOIN found USING (payload_id)""",
    "m_answered": _ANSWERED,
    "m_answered_observed": _ANSWERED,
    "j_run_inferences": _INFERRED,
    "j_run_observed": _INFERRED,
    "s_batch_json": """WITH made AS (
  SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN [] ELSE string_split(text, chr(10)) END AS images,
    CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'auto' END AS lang,
    CASE WHEN doc_id % 2 = 0 THEN (doc_id % 13) / 10 ELSE 0.0 END AS min_confidence FROM documents),
rows AS (
  SELECT doc_id, unnest(images) AS payload, generate_subscripts(images, 1) - 1 AS idx FROM made)
SELECT CAST(doc_id AS VARCHAR) AS request_id, lang, min_confidence,
  CASE WHEN len(images) = 0 THEN 'images_empty' WHEN min_confidence > 1 THEN 'min_confidence_range' END AS violation,
  CAST(len(images) AS INTEGER) AS n_images, CAST(idx AS INTEGER) AS idx, CAST(length(payload) AS INTEGER) AS n_chars,
  md5(payload) AS payload_md5
FROM made LEFT JOIN rows USING (doc_id)""",
    "s_single_json": """WITH made AS (
  SELECT doc_id, doc_id % 10 = 0 AS broken, CASE WHEN doc_id % 7 = 0 THEN '' ELSE
    trim(text, ' ' || chr(9) || chr(10) || chr(13)) END AS image, (doc_id % 13) / 10 AS conf FROM documents)
SELECT CASE WHEN NOT broken THEN CAST(doc_id AS VARCHAR) END AS request_id, 'auto' AS lang,
  CASE WHEN broken THEN 0.0 ELSE conf END AS min_confidence, true AS include_polygon,
  CASE WHEN broken THEN 'not_json' WHEN image = '' THEN 'image_blank' WHEN conf > 1 THEN 'min_confidence_range' END AS violation,
  CASE WHEN NOT broken THEN CAST(length(image) AS INTEGER) END AS n_chars,
  CASE WHEN NOT broken THEN md5(image) END AS image_md5 FROM made""",
    "s_job_documents": _with(_EVENTS, _STATE)
    + f"""SELECT job_id, status, {_iso("created_at")} AS created_at, processed, CAST(20 AS BIGINT) AS total, error
FROM state WHERE last_seq % 4 != 0""",
    "s_job_store": _STORED,
    "s_job_compact": _STORED,
    # The same machine as one fold over each job's status events; elements and states share one type.
    "x_lifecycle": _with(_EVENTS)
    + """, steps AS (
  SELECT job_id, list({kind: kind, ts: ts, created: NULL::TIMESTAMP, ok: 0, no: 0, ended: 0} ORDER BY seq) AS events
  FROM job_events WHERE kind != 'progress' GROUP BY job_id),
folded AS (
  SELECT job_id, list_reduce(events, lambda a, e:
    CASE WHEN a.created IS NOT NULL AND e.ts - a.created > INTERVAL 24 HOUR THEN
      CASE WHEN e.kind = 'queued' THEN {kind: e.kind, ts: e.ts, created: e.ts, ok: a.ok + 1, no: a.no, ended: a.ended + 1}
      ELSE {kind: '', ts: e.ts, created: NULL::TIMESTAMP, ok: a.ok, no: a.no + 1, ended: a.ended + 1} END
    WHEN (a.kind || '>' || e.kind) IN ('>queued', 'queued>running', 'queued>cancelled', 'running>completed', 'running>failed', 'running>cancelled')
      THEN {kind: e.kind, ts: e.ts, created: coalesce(a.created, e.ts), ok: a.ok + 1, no: a.no, ended: a.ended}
    ELSE {kind: a.kind, ts: e.ts, created: a.created, ok: a.ok, no: a.no + 1, ended: a.ended} END,
    {kind: '', ts: NULL::TIMESTAMP, created: NULL::TIMESTAMP, ok: 0, no: 0, ended: 0}) AS s FROM steps),
mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS ts FROM job_events WHERE kind != 'progress')
SELECT job_id, s.ok::BIGINT AS n_accepted, s.no::BIGINT AS n_rejected, s.kind AS status,
  (s.ended + CASE WHEN s.created + INTERVAL 24 HOUR < (SELECT ts FROM mark) THEN 1 ELSE 0 END)::BIGINT AS n_expired FROM folded""",
    "x_effective_images": _with(_EVENTS, _ITEMS)
    + """, cancels AS (SELECT job_id, ts FROM job_events WHERE kind = 'cancelled'),
mark AS (SELECT least((SELECT max(start_ts) FROM job_items), (SELECT max(ts) FROM cancels)) - INTERVAL 630 SECOND AS ts)
SELECT job_id, image_id FROM job_items i WHERE start_ts <= (SELECT ts FROM mark)
  AND NOT EXISTS (SELECT 1 FROM cancels c WHERE c.job_id = i.job_id AND c.ts <= i.start_ts AND c.ts >= i.start_ts - INTERVAL 24 HOUR)""",
    "x_metrics": _with(_REQUESTS)
    + f""", windows AS (
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, endpoint, lang, status, count(*) AS n_requests,
    round(sum(duration) + 1e-9, 4) AS duration_sum, count(*) FILTER (WHERE duration <= 5) AS within_5s,
    count(*) FILTER (WHERE duration <= 30) AS within_30s
  FROM requests GROUP BY ALL)
SELECT {_iso("start")} AS window_start, endpoint, lang, status, n_requests, duration_sum, within_5s, within_30s FROM windows
WHERE start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "x_ttl_fixed": _EXPIRED,
    "x_ttl_state": _EXPIRED,
    "x_ttl_sliding": _with(_EVENTS)
    + f""", gaps AS (
  SELECT job_id, ts, lead(ts) OVER (PARTITION BY job_id ORDER BY ts) AS next_ts FROM job_events)
SELECT job_id, {_iso("ts")} AS last_event_at FROM gaps
WHERE (next_ts IS NULL OR next_ts - ts > INTERVAL 24 HOUR)
  AND ts + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "s_scan_files": _files(10) + """,
ranked AS (
  SELECT n, body, folder, row_number() OVER (PARTITION BY folder ORDER BY n) - 1 AS idx, count(*) OVER (PARTITION BY folder) AS n_images FROM placed)
SELECT 'b' || folder AS batch_id, idx, CASE WHEN n % 2 = 0 THEN printf('f%09d', n) ELSE 'image_' || idx END AS filename,
  octet_length(encode(body)) + 1 AS length, n_images, md5(body || chr(10)) AS content_md5
FROM ranked WHERE n_images <= 20""",
    "b_file_documents": _BITMAPS + """,
listed AS (
  SELECT folder, idx, n_images, CASE WHEN n % 2 = 0 THEN printf('f%09d', n) ELSE 'image_' || idx END AS filename,
    error, width || 'x' || height || 'x' || was_resized || 'x' || total_lines AS found FROM judged)
SELECT 'b' || folder AS batch_id, count(*) AS n_images,
  CASE WHEN count(*) > 20 THEN 'rejected' WHEN count(error) = 0 THEN 'success' WHEN count(error) < count(*) THEN 'partial' ELSE 'error' END AS status,
  CASE WHEN count(*) > 20 THEN 400 ELSE 200 END AS http_status, CASE WHEN count(*) > 20 THEN 'batch_too_large' END AS error,
  CASE WHEN count(*) <= 20 THEN string_agg(CASE WHEN error IS NULL THEN filename || '|success|' || found ELSE filename || '|error|' || error END, ';' ORDER BY idx) END AS results
FROM listed GROUP BY folder""",
    "x_image_files": _BITMAPS + """
SELECT n, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error, CASE WHEN error IS NULL THEN width END AS width,
  CASE WHEN error IS NULL THEN height END AS height, CASE WHEN error IS NULL THEN total_lines END AS total_lines FROM judged""",
    "x_create": f"""WITH sized AS (
  SELECT 'job_' || o_custkey AS job_id, count(*) AS n,
         md5(string_agg(to_base64(encode('img_' || o_orderkey)), ',' ORDER BY o_orderkey)) AS images_md5 FROM orders GROUP BY o_custkey),
timed AS (SELECT *, TIMESTAMP '2024-01-30 12:00:00' + to_minutes(CAST(2 * n AS BIGINT)) AS done FROM sized)
SELECT job_id, CASE WHEN n <= 20 THEN 'queued' END AS status, CASE WHEN n <= 20 THEN '/ocr/jobs/' || job_id END AS status_url,
  CASE WHEN n <= 20 THEN {_iso("done")} END AS estimated_completion, CASE WHEN n <= 20 THEN 'auto' END AS lang,
  CASE WHEN n <= 20 THEN n END AS total, CASE WHEN n <= 20 THEN n END AS n_stored, CASE WHEN n <= 20 THEN images_md5 END AS images_md5,
  CASE WHEN n <= 20 THEN 202 ELSE 400 END AS http_status, CASE WHEN n > 20 THEN 'batch_too_large' END AS error_code,
  CASE WHEN n > 20 THEN 'Batch size ' || n || ' exceeds maximum 20' END AS error_detail FROM timed""",
    "x_submit": _SUBMITTED,
    "x_submit_state": _SUBMITTED,
}
