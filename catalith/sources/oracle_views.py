"""The views of sources.catalog as common table expressions for DuckDB."""

from ..operators.picture_sql import MEASURED_SQL

#: A similarity hash by majority of word hashes, bit by bit.
_SUMS = ", ".join(f"sum(({'low' if i < 31 else 'high'} >> {i % 31}) & 1)" for i in range(62))

VIEWS = (
    rf"""
pictures AS (
  SELECT vec_id AS content_id, CAST(vec_id % 10 AS INTEGER) AS orientation, list_transform(range(1024), lambda k: least(255, greatest(0, CAST(floor(128.5::DOUBLE + 1500 * embedding[k // 32 % len(embedding) + 1]::DOUBLE * embedding[(k % 32 + 32) % len(embedding) + 1]::DOUBLE) AS INTEGER))) // CASE WHEN vec_id % 23 = 0 THEN 16 ELSE 1 END) AS pixels FROM embeddings
),
measured AS ({MEASURED_SQL}),
jpeg_parts AS (
  SELECT doc_id AS file_id, CASE WHEN doc_id % 13 = 5 THEN 1 WHEN doc_id % 17 = 5 THEN 2 WHEN doc_id % 19 = 5 THEN 3 WHEN doc_id % 23 = 5 THEN 4 ELSE 0 END AS damage, 'FFE000104A46494600010100000100010000' AS jfif, 'FFDB000401AAFFC0000B080030004001011100FFC4000502AABB' AS tables,
    'FFFE' || lpad(to_hex(CAST(octet_length(encode(concat_ws('/', lang, source))) + 2 AS BIGINT)), 4, '0') || hex(concat_ws('/', lang, source)) AS said, 'FFDA0008010100003F00' || hex(sha256(text)) || 'FF00FFD0' || hex(md5(text)) AS scan FROM documents
),
word_hashes AS (
  SELECT content_id, CAST(list_sum([CASE WHEN 2 * s[i + 1] > n THEN CAST(1 AS BIGINT) << i ELSE 0 END for i in range(62)]) AS BIGINT) AS h62 FROM (SELECT content_id, count(*) AS n, [{_SUMS}] AS s FROM (
    SELECT content_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS high, CAST('0x' || substr(md5(w), 9, 8) AS BIGINT) AS low FROM (SELECT doc_id AS content_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents WHERE substr(sha1(text), 1, 1) <> '5')) GROUP BY content_id)
),
"""
    r"""
photos AS (
  SELECT *, CASE WHEN id % 12 IN (6, 7, 9, 10, 11) THEN '/dst/library/' || name WHEN id % 12 IN (4, 5) THEN '/dst/rejects/' || name END AS dest_path, '/src/' || camera || '/' || lens || '/' || name AS source_path FROM (
    SELECT doc_id AS id, sha1(text) AS sha1_hash, n_chars AS file_size,
      ['Failed', 'Pending', 'Duplicate', 'Removed_Duplicate', 'Rejected', 'Rejected_Copied', 'Completed', 'Found_At_Destination', 'Processing', 'Copied', 'Copied', 'Copied'][doc_id % 12 + 1] AS status,
      CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 97 = 0 THEN '1799-12-31T00:00:00' ELSE strftime(DATE '1995-01-01' + CAST((doc_id * 37) % 12000 AS INTEGER), '%Y-%m-%d') || 'T12:00:00' END AS date_taken,
      CASE WHEN doc_id % 9 = 0 THEN 'file_mtime' ELSE 'exif' END AS date_source, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '.' || ['jpg', 'png', 'cr2', 'tif'][doc_id % 4 + 1] AS name, source AS camera, lang AS lens FROM documents)
),
contents AS (
  SELECT content_id, sha1_hash, h62, CASE WHEN h62 IS NULL THEN 'error' ELSE 'ok' END AS phash_state, CAST(640 * (1 + content_id % 8) AS INTEGER) AS width, CAST(480 * (1 + content_id % 8) AS INTEGER) AS height,
    mean_brightness, mean_gradient
  FROM (SELECT sha1_hash, min(id) AS content_id FROM photos GROUP BY sha1_hash) LEFT JOIN word_hashes USING (content_id) LEFT JOIN measured USING (content_id)
),
runs AS (
  SELECT o_orderkey AS id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'MOVE' WHEN '2' THEN 'COPY' WHEN '3' THEN 'CHECK' ELSE 'INDEX' END AS mode,
    CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Running' ELSE 'Cancelled' END AS status, o_orderdate AS started_at, o_custkey AS target FROM orders
),
operations AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(round(l_extendedprice * 100) AS BIGINT)) AS op, l_orderkey AS run_id, l_partkey AS photo_id,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Copied' WHEN 'AO' THEN 'Completed' WHEN 'NF' THEN 'Failed' WHEN 'NO' THEN 'Skipped' WHEN 'RF' THEN 'Duplicate' ELSE 'Pending' END AS status,
    CASE WHEN l_returnflag || l_linestatus = 'NF' THEN ['OSError: [Errno 28] No space left: ''/dst/a''', 'PermissionError: [Errno 13] Permission denied: ''/src/b''', 'Hash mismatch after copy', 'FileNotFoundError: [Errno 2] No such file: ''/src/c''', 'unexpected end'][l_partkey % 5 + 1] END AS message,
    l_shipdate AS timestamp, CAST(l_quantity AS BIGINT) AS amount, CASE WHEN l_returnflag || l_linestatus = 'AF' AND l_quantity > 25 THEN 'original kept' END AS note FROM lineitem
),
review_events AS (SELECT event_id AS id, user_id AS photo_id, event_type AS action, ts AS created_at, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
log_entries AS (
  SELECT o.op, o.run_id, o.photo_id, o.status, o.note, o.message, o.timestamp, CASE WHEN o.amount % 5 = 0 THEN replace(p.source_path, 'doc-', 'orig-') ELSE p.source_path END AS source_path, CASE WHEN o.status IN ('Copied', 'Completed') THEN p.dest_path END AS dest_path FROM operations o LEFT JOIN photos p ON p.id = o.photo_id
),
operation_events AS (
  SELECT op, 'intent' AS step, 'recorded' AS outcome, CASE WHEN amount % 2 = 0 THEN 'metadata_edit' ELSE 'keep_new_version' END AS kind FROM operations WHERE status = 'Completed' AND amount % 3 = 0
  UNION ALL SELECT op, 'metadata_saved', CASE WHEN amount % 9 = 0 THEN 'failed' ELSE 'verified' END, NULL FROM operations WHERE status = 'Completed' AND amount % 3 = 0
),
consolidations AS (SELECT doc_id // 50 AS op, doc_id AS file_id FROM documents WHERE doc_id % 50 IN (11, 36)),
wanted AS (SELECT id, '/dst/library/' || lens AS folder, 'IMG_' || substr(name, 10, 1) AS stem, '.jpg' AS ext, sha1_hash FROM photos WHERE status IN ('Pending', 'Duplicate', 'Copied') AND sha1_hash IS NOT NULL),
occupied AS (SELECT folder || '/' || stem || CASE WHEN id // 60 % 7 > 0 THEN '_' || (id // 60 % 7) ELSE '' END || ext AS path, min(sha1_hash) AS sha1_hash FROM wanted WHERE id % 4 IN (1, 3) GROUP BY 1 HAVING substr(min(sha1_hash), 2, 1) <> '7'),
asked AS (
  SELECT id, CASE id % 8 WHEN 0 THEN '.' WHEN 1 THEN camera || '//' || lens WHEN 2 THEN '/' || camera WHEN 3 THEN '../' || camera WHEN 4 THEN camera || '/./' || lens WHEN 5 THEN camera || '/' WHEN 6 THEN '' ELSE camera END AS folder,
    CASE id % 5 WHEN 0 THEN 'Undated/' || substr(date_taken, 1, 4) WHEN 1 THEN '2001/02/30' WHEN 2 THEN substr(date_taken, 1, 4) ELSE replace(substr(date_taken, 1, 10), '-', '/') END AS day_folder,
    CASE id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN 'txt' WHEN 2 THEN ' cr2' ELSE regexp_extract(name, '\.([^.]*)$', 1) END AS type_name, file_size * [1, 97, 10007, 1000003, 100000007][id % 5 + 1] AS size, id * 37 * (1 + id % 3 * 100) AS seconds FROM photos
),
hash_records AS (SELECT content_id, phash_state, CASE content_id % 5 WHEN 0 THEN substr(lower(lpad(to_hex(h62), 16, '0')), 1, 15) WHEN 1 THEN upper(lpad(to_hex(h62), 16, '0')) WHEN 2 THEN 'unreadable-hash!' ELSE lower(lpad(to_hex(h62), 16, '0')) END AS text FROM contents WHERE h62 IS NOT NULL OR content_id % 5 = 2),
turns AS (SELECT content_id, CAST(content_id % 8 + 1 AS INTEGER) AS first, [1, 6, 3, 8][content_id // 8 % 4 + 1] AS then_turned FROM contents),
updates AS (
  SELECT id, CASE WHEN id % 15 = 0 THEN 'Pending' ELSE status END AS old_status, status AS new_status, CASE id % 9 WHEN 1 THEN '1700' || substr(date_taken, 5) WHEN 2 THEN '2090' || substr(date_taken, 5) ELSE date_taken END AS old_date,
    CASE WHEN id % 27 = 10 THEN '1650' || substr(date_taken, 5) WHEN id % 9 = 4 THEN '2026' || substr(date_taken, 5) WHEN id % 9 = 5 THEN '1950' || substr(date_taken, 5) ELSE date_taken END AS new_date, CASE WHEN id % 4 = 1 THEN 480 ELSE least(width, height) END AS old_side, least(width, height) AS new_side
  FROM photos LEFT JOIN contents USING (sha1_hash)
),
requests AS (
  SELECT id, 'r' || CASE WHEN id % 40 = 10 THEN id - 10 ELSE id END AS request_id, photo_id, CASE WHEN k % 13 = 2 THEN sha1(sha1_hash) ELSE sha1_hash END AS sha1, coalesce(n, 0) + CASE WHEN k % 7 = 3 THEN 1 ELSE 0 END AS revision, reason, CASE WHEN k % 11 = 1 THEN 'correct' WHEN reason = 'small' THEN 'reviewed' WHEN reason = 'date' THEN 'correct' ELSE ['later', 'done', 'keep'][k % 3 + 1] END AS action,
    CASE WHEN k % 17 = 4 THEN repeat('x', 61) WHEN reason = 'later' THEN 'a note' ELSE '' END AS note, CASE WHEN reason = 'later' THEN CASE WHEN k % 2 = 0 THEN 'keep' ELSE 'date' END END AS bookmark, CASE WHEN reason = 'date' THEN CASE WHEN k % 19 = 2 THEN '1799' ELSE date_now END END AS date_taken
  FROM (SELECT r.*, p.sha1_hash, p.date_taken AS date_now, b.n, ['small', 'later', 'date', 'later', 'other'][r.k % 5 + 1] AS reason FROM review_events r JOIN photos p ON p.id = r.photo_id LEFT JOIN (SELECT photo_id, count(*) AS n FROM review_events WHERE id % 10 <> 0 GROUP BY 1) b ON b.photo_id = r.photo_id WHERE r.id % 10 = 0)
),
issues AS (SELECT doc_id AS photo_id, CASE WHEN toxic = 1 THEN 'unestablished_outcome' ELSE 'note' END AS category, quality = 0 AS resolved FROM labels),
origins AS (SELECT doc_id AS file_id, doc_id // 2 AS origin_file_id FROM documents WHERE doc_id > 0),
observed AS (
  SELECT CASE WHEN id % 23 = 0 THEN replace(dest_path, '/dst/', '/dst/moved/') WHEN id % 29 = 0 THEN replace(dest_path, 'doc-', 'renamed-') ELSE dest_path END AS path, CASE WHEN id % 31 = 0 THEN sha1(sha1_hash) ELSE sha1_hash END AS sha1_hash, file_size AS size
  FROM photos WHERE dest_path IS NOT NULL AND id % 19 <> 0
  UNION ALL SELECT '/dst/library/page-' || page_id || CASE page_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.txt' ELSE '' END, sha1(html), CASE WHEN page_id % 11 = 0 THEN 0 ELSE length(html) END FROM pages
),
tags AS (SELECT event_id AS id, user_id AS photo_id, event_type AS source, 'field' || (event_id % 8) AS field, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id % 7 AS VARCHAR) END AS value FROM events),
captures AS (SELECT id, photo_id, CASE WHEN k < 30 THEN 'needs_attention' ELSE 'captured' END AS state, action AS source FROM review_events),
version_answers AS (SELECT id, photo_id, CASE WHEN k < 34 THEN 'waiting' WHEN k < 67 THEN 'not_kept' ELSE 'kept' END AS answer FROM review_events WHERE action = 'click'),
confirmations AS (SELECT id AS photo_id, CASE WHEN id % 194 = 0 THEN date_taken ELSE '1798' END AS date_taken FROM photos WHERE id % 97 = 0),
thumbnails AS (SELECT content_id, size, present, CAST(size * (content_id % 50 + 1) AS BIGINT) AS bytes FROM (SELECT vec_id AS content_id, unnest([320, 1280]) AS size, vec_id % 11 <> 0 AS present FROM embeddings)),
findings AS (
  SELECT r.run_id, r.completed, f.id AS photo_id, f.path, f.kind, f.expected AS expected_sha1, f.observed AS observed_sha1, f.size, CASE WHEN f.id % 5 = 0 AND r.run_id = 9 THEN f.id END AS settled_by FROM (
    SELECT coalesce(e.path, o.path) AS path, e.id, e.sha1_hash AS expected, o.sha1_hash AS observed, o.size, CASE WHEN o.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unknown' WHEN e.sha1_hash = o.sha1_hash THEN 'ok' ELSE 'changed' END AS kind
    FROM (SELECT id, dest_path AS path, sha1_hash FROM photos WHERE dest_path IS NOT NULL) e FULL JOIN observed o ON o.path = e.path) f CROSS JOIN (VALUES (9, true), (11, false)) r(run_id, completed) WHERE f.kind <> 'ok'
),
image_tags AS (
  SELECT photo_id, x.tag AS tag, x.value AS value FROM (SELECT id AS photo_id, unnest([
    {'tag': 'ExifIFD:DateTimeOriginal', 'value': CASE WHEN id % 11 = 0 THEN NULL WHEN id % 17 = 0 THEN 'unknown' WHEN id % 29 = 3 THEN '2020:01:02 99:99:99' WHEN id % 29 = 4 THEN '' ELSE replace(substr(date_taken, 1, 10), '-', ':') || ' ' || substr(date_taken, 12, 8) END}, {'tag': 'ExifIFD:SubSecTimeOriginal', 'value': CASE WHEN id % 3 = 0 THEN CAST(id % 100 AS VARCHAR) WHEN id % 31 = 0 THEN 'x' END},
    {'tag': 'ExifIFD:OffsetTimeOriginal', 'value': CASE WHEN id % 2 = 0 THEN '+02:00' WHEN id % 37 = 0 THEN '2h' END}, {'tag': 'IFD0:Orientation', 'value': CASE WHEN id % 5 <> 0 THEN CAST(id % 10 AS VARCHAR) END}, {'tag': 'IFD0:Make', 'value': camera},
    {'tag': 'IFD0:Copy1:Make', 'value': CASE WHEN id % 7 = 0 THEN lens WHEN id % 2 = 0 THEN camera END}, {'tag': 'IFD0:XPKeywords', 'value': lens || '; ' || camera || ';x'},
    {'tag': 'XMP-xmp:Rating', 'value': ['4.50', '-1', '05.0', '7', '0.00', NULL, '4e0', ' 3 ', '+2', '5.0000000000000000001', '.5', '-1.0', '-2', ''][id % 14 + 1]}, {'tag': 'XMP-dc:Title', 'value': camera}, {'tag': 'XMP-dc:Title-de', 'value': CASE WHEN id % 4 = 0 THEN lens END},
    {'tag': 'XMP-exif:DateTimeOriginal', 'value': CASE WHEN id % 3 = 1 THEN replace(substr(date_taken, 1, 10), '-', ':') || CASE WHEN id % 59 = 1 THEN ' 08:00:61' WHEN id % 59 = 4 THEN '' ELSE ' 08:00:00Z' END END},
    {'tag': 'GPS:GPSLatitude', 'value': CASE WHEN id % 31 = 1 THEN '12 deg' WHEN id % 31 = 2 THEN '-1.5' WHEN id % 31 = 5 THEN '12.3456789012345678901234567' WHEN id % 31 = 6 THEN '090.000' WHEN id % 4 < 3 THEN (id % 95) || '.' || lpad(CAST(id * 7 % 1000 AS VARCHAR), 3, '0') END}, {'tag': 'IFD0:Foo:Make', 'value': CASE WHEN id % 53 = 7 THEN 'other' END}, {'tag': 'IFD0:Model', 'value': CASE WHEN id % 2 = 1 THEN camera || ' II' END}, {'tag': 'IFD0:Artist', 'value': CASE WHEN id % 3 = 0 THEN lens END}, {'tag': 'IFD0:Rating', 'value': CASE WHEN id % 9 = 2 THEN '3.0' WHEN id % 9 = 4 THEN '6' END}, {'tag': 'IFD0:Copyright', 'value': CASE WHEN id % 7 = 3 THEN '' END}, {'tag': 'XMP-dc:Subject', 'value': CASE WHEN id % 6 = 1 THEN 'a;b' END},
    {'tag': 'XMP-tiff:Orientation', 'value': CASE WHEN id % 6 = 2 THEN '+08' WHEN id % 41 = 3 THEN '9' END}, {'tag': 'XMP-exif:GPSLatitude', 'value': CASE WHEN id % 13 = 2 THEN '-12.250' WHEN id % 13 = 3 THEN '+7' END}, {'tag': 'XMP-exif:GPSAltitude', 'value': CASE WHEN id % 13 = 4 THEN '100/2' WHEN id % 47 = 5 THEN '1/0' END}, {'tag': 'GPS:GPSAltitudeRef', 'value': CASE WHEN id % 43 = 4 THEN '2' WHEN id % 5 = 1 THEN '0' END}, {'tag': 'XMP-dc:Rights-fr', 'value': CASE WHEN id % 10 = 3 THEN 'tous' END},
    {'tag': 'GPS:GPSLatitudeRef', 'value': CASE WHEN id % 37 = 2 THEN 'X' WHEN id % 8 < 6 THEN 'N' WHEN id % 8 = 7 THEN 'S' END},
    {'tag': 'GPS:GPSLongitude', 'value': CASE WHEN id % 4 < 3 THEN (id % 185) || '.' || lpad(CAST(id * 7 % 1000 AS VARCHAR), 3, '0') END}, {'tag': 'GPS:GPSLongitudeRef', 'value': CASE WHEN id % 4 < 3 THEN 'E' END}]) AS x FROM photos) WHERE x.value IS NOT NULL
),
ends AS (
  SELECT op, status, run_id, photo_id, CASE WHEN status = 'Failed' THEN ['match', 'mismatch', 'absent', 'unreadable'][photo_id % 4 + 1] ELSE ['absent', 'present', 'present', 'unreadable'][photo_id % 4 + 1] END AS source_state,
    CASE WHEN status = 'Failed' THEN ['match', 'absent', 'mismatch'][run_id % 3 + 1] ELSE ['match', 'absent', 'mismatch', 'match', 'absent'][run_id % 5 + 1] END AS dest_state FROM operations WHERE status IN ('Failed', 'Pending')
),
inventory AS (
  SELECT regexp_extract(source_path, '^(.*)/[^/]*$', 1) AS folder, name FROM photos UNION ALL SELECT regexp_extract(source_path, '^(.*)/[^/]*$', 1), regexp_replace(name, '\.[^.]*$', '.cr2') FROM photos WHERE id % 3 = 0 AND NOT name LIKE '%.cr2'
),
sidecars AS (
  SELECT id, regexp_extract(source_path, '^(.*)/[^/]*$', 1) AS folder, CASE WHEN id % 11 = 0 THEN 'none-' || id WHEN id % 5 = 0 THEN name ELSE regexp_extract(name, '^(.+)\.[^.]+$', 1) END AS base,
    CASE WHEN id % 14 = 7 THEN 'other.jpg' WHEN id % 7 = 0 THEN name END AS owner_name, CASE WHEN id % 17 = 0 THEN 'not_xmp' WHEN id % 13 = 0 THEN 'needs_attention' ELSE 'valid' END AS state FROM photos
),
looks AS (SELECT p.id AS photo_id, c.h62 AS recorded, xor(c.h62, (CAST(1 AS BIGINT) << CAST(p.id % 40 AS INTEGER)) - 1) AS seen FROM photos p JOIN contents c USING (sha1_hash) WHERE p.dest_path IS NOT NULL AND c.h62 IS NOT NULL),
clashes AS (SELECT DISTINCT right(name, 6) AS name, regexp_extract(source_path, '^(.*)/[^/]*$', 1) AS folder FROM photos WHERE right(name, 6) IN (SELECT right(name, 6) FROM photos GROUP BY 1 HAVING count(DISTINCT sha1_hash) > 1)),
changes AS (SELECT photo_id * 10 + photo_id % 7 AS change_id, photo_id, before_sha1 FROM (SELECT id - 1 AS photo_id, sha1_hash AS before_sha1 FROM photos WHERE (id - 1) % 7 IN (0, 1, 4) UNION ALL SELECT id - 2, sha1_hash FROM photos WHERE (id - 2) % 7 = 3) WHERE photo_id >= 0),
retained AS (SELECT id AS photo_id, sha256(sha1_hash || '#xmp') AS version, CASE WHEN id % 9 = 0 THEN 'needs_attention' ELSE 'valid' END AS state, id % 5 <> 0 AS linked FROM photos),
decisions AS (SELECT id AS decision_id, photo_id, CASE WHEN action = 'click' THEN 'association' ELSE 'primary' END AS kind, CASE k % 4 WHEN 0 THEN ['a=1', 'b=2'] WHEN 1 THEN ['b=2', 'a=1'] WHEN 2 THEN ['a=1'] ELSE ['a=2', 'b=1'] END AS owners FROM review_events WHERE action IN ('click', 'view')),
receipts AS (
  SELECT id AS event_id, photo_id, CASE WHEN k % 3 <> 0 THEN v END AS primary_revision, CASE WHEN k % 5 = 0 THEN c END AS association_revision, CASE WHEN k % 7 = 0 THEN c - 1 ELSE id END AS highwater, CASE k % 3 WHEN 0 THEN ['a=1', 'b=2'] WHEN 1 THEN ['b=2', 'a=1'] WHEN 2 THEN ['a=1'] ELSE ['a=2', 'b=1'] END AS owners FROM (
    SELECT *, max(CASE WHEN action = 'view' THEN id END) OVER w AS v, max(CASE WHEN action = 'click' THEN id END) OVER w AS c FROM review_events WINDOW w AS (PARTITION BY photo_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE action = 'purchase'
),
scans AS (
  SELECT r.id AS run_id, array_to_string(string_split(p.source_path, '/')[1 : r.id % 3 + 2], '/') AS root, r.started_at AS scanned_at, r.status, r.id % 5 = 0 AS targeted, r.id % 7 <> 0 AS every_type, r.id % 4 = 0 AS issues FROM runs r JOIN photos p ON p.id = r.target WHERE r.mode = 'INDEX'
),
gone_files AS (
  SELECT folder || '/' || inside AS path, folder, CASE WHEN id // 40 % 4 = 1 AND id % 40 = 7 THEN NULL WHEN id // 40 % 4 = 2 AND id % 40 = 9 THEN '/dst/library/else/' || name ELSE '/dst/library/new/' || camera || '-' || (id // 40 % 9) || '/' || inside END AS found_path,
    CASE WHEN id // 40 % 4 = 1 AND id % 40 = 7 THEN NULL WHEN id % 101 = 100 THEN 'rejects' ELSE 'library' END AS found_in FROM (SELECT *, '/dst/library/' || camera || '/' || (id // 40 % 9) AS folder, CASE WHEN id % 3 = 0 THEN 'sub/' ELSE '' END || name AS inside FROM photos)
),
payloads AS (SELECT event_id, CASE WHEN event_id % 12 < 9 THEN ['{"a": NaN}', '{"a": [1, {"b": null}]}', '[1]', '{"a": ', '{"a": "Infinity"}', '{"NaN": "-Infinity \" NaN"}', '{"a": -Infinity}', '', ' {}'][event_id % 12 + 1] ELSE props END AS text FROM events),
arrivals AS (
  SELECT id, CASE WHEN id % 37 <> 0 THEN sha1_hash END AS sha1_hash, CASE WHEN id % 41 = 0 THEN NULL WHEN id % 43 = 0 THEN '' WHEN id % 47 = 0 THEN source_path || chr(10) ELSE source_path END AS source_path, CASE WHEN id % 53 = 0 THEN 0 ELSE file_size END AS file_size FROM photos
),
recorded AS (SELECT source_path AS path, file_size AS size, CAST(id * 1.5 AS DOUBLE) AS mtime, status FROM photos),
candidates AS (SELECT source_path AS path, file_size + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS size, CAST(id * 1.5 AS DOUBLE) + CASE WHEN id % 7 = 0 THEN 1.0::DOUBLE WHEN id % 3 = 0 THEN 0.0000004::DOUBLE ELSE 0.0::DOUBLE END AS mtime FROM photos),
hashes AS (SELECT DISTINCT h62 AS h FROM contents WHERE h62 IS NOT NULL),
edges AS (SELECT a.h AS low, b.h AS high, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM hashes a JOIN hashes b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 6),
available AS (SELECT c.content_id, c.h62 AS h, min(p.id) AS photo_id, c.mean_brightness, c.mean_gradient FROM photos p JOIN contents c USING (sha1_hash) WHERE p.status IN ('Completed', 'Copied', 'Found_At_Destination') AND c.h62 IS NOT NULL GROUP BY ALL),
buckets AS (SELECT h, count(*) AS n FROM available GROUP BY h),
around AS (SELECT low AS h, high AS other, distance FROM edges UNION ALL SELECT high, low, distance FROM edges)
"""
)


def with_views(sql: str) -> str:
    """A query over the views: its own WITH RECURSIVE list may follow theirs."""
    return f"WITH RECURSIVE {VIEWS.strip()} {sql.strip()}"
