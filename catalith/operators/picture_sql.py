"""The hash and the measures of pictures as DuckDB list arithmetic."""

_TURNED = "list_transform(range(1024), lambda k: pixels[CASE orientation WHEN 2 THEN k // 32 * 32 + 31 - k % 32 WHEN 3 THEN 1023 - k WHEN 4 THEN (31 - k // 32) * 32 + k % 32 WHEN 5 THEN k % 32 * 32 + k // 32 WHEN 6 THEN (31 - k % 32) * 32 + k // 32 WHEN 7 THEN (31 - k % 32) * 32 + 31 - k // 32 WHEN 8 THEN k % 32 * 32 + 31 - k // 32 ELSE k END + 1])"
MEASURED_SQL = f"""
SELECT content_id, lower(list_aggregate(list_transform(range(16), lambda n: to_hex(list_sum(list_transform(range(4), lambda b: CASE WHEN low[n * 4 + b + 1] > middle THEN 8 >> b ELSE 0 END)))), 'string_agg', '')) AS phash, list_avg(p) AS mean_brightness,
  round(list_avg(list_transform(range(1024), lambda k: sqrt(pow(CASE k % 32 WHEN 0 THEN p[k + 2] - p[k + 1] WHEN 31 THEN p[k + 1] - p[k] ELSE (p[k + 2] - p[k]) / 2.0 END, 2) + pow(CASE k // 32 WHEN 0 THEN p[k + 33] - p[k + 1] WHEN 31 THEN p[k + 1] - p[k - 31] ELSE (p[k + 33] - p[k - 31]) / 2.0 END, 2)))), 6) AS mean_gradient
FROM (SELECT *, list_median(low) AS middle FROM (
  SELECT content_id, p, list_transform(range(64), lambda k: list_sum(list_transform(range(32), lambda y: half[y * 8 + k % 8 + 1] * 2 * cos(pi() * (k // 8) * (2 * y + 1) / 64)))) AS low FROM (
    SELECT content_id, p, list_transform(range(256), lambda k: list_sum(list_transform(range(32), lambda x: p[k // 8 * 32 + x + 1] * 2 * cos(pi() * (k % 8) * (2 * x + 1) / 64)))) AS half FROM (SELECT content_id, {_TURNED} AS p FROM pictures))))"""
