"""SQL twins of the registered media queries: one row per pixel, joins and window functions."""

from __future__ import annotations

from pixelloom.functions.classify import IMAGE_PATTERN, VIDEO_PATTERN
from pixelloom.plans.views import QUANT, SUFFIXES, WIDE

# gray pixels: image_id, i, y, x, g; colour pixels: image_id, i, y, x, b, g, r, v (luma)
_PX = f"""q AS (SELECT vec_id, p - 1 AS i, {QUANT.format(v='embedding[p]')} AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings)),
gray AS (SELECT vec_id AS image_id, i, i // 8 AS y, i % 8 AS x, v AS g, v FROM q),
color0 AS (SELECT vec_id // 3 AS image_id, i, i // 8 AS y, i % 8 AS x, max(v) FILTER (vec_id % 3 = 0) AS b,
  max(v) FILTER (vec_id % 3 = 1) AS g, max(v) FILTER (vec_id % 3 = 2) AS r FROM q GROUP BY ALL HAVING count(*) = 3),
color AS (SELECT *, (114*b + 587*g + 299*r + 500) // 1000 AS v FROM color0)"""
_NAME = "'/media/gray/' || (vec_id % 7) || '/' || vec_id || '.png'"
_EXT = "[" + ", ".join(f"'{s}'" for s in SUFFIXES) + "]"
_FILES = f"""files AS (SELECT '/media/' || p_brand || '/' || p_name || '_' || p_partkey || {_EXT}[p_partkey % {len(SUFFIXES)} + 1] AS path FROM part)"""
_KIND = f"CASE WHEN regexp_matches(path, '{IMAGE_PATTERN}') THEN 'image' WHEN regexp_matches(path, '{VIDEO_PATTERN}') THEN 'video' ELSE 'unsupported' END"

# frames as pixels: video_id, f, i, b, g, r, v, c (channels)
_FR = _PX + """,
fpx AS (SELECT image_id % 2 AS video_id, image_id // 2 AS f, i, g AS b, g, g AS r, g AS v, 1 AS c FROM gray
  UNION ALL SELECT 10, image_id, i, b, g, r, v, 3 FROM color
  UNION ALL SELECT 20, event_id, 0, e, e, e, e, 1 FROM (SELECT event_id, CAST(least(255, greatest(0, floor(value))) AS INT) AS e FROM events)),
fb AS (SELECT video_id, f, any_value(c) AS c, CASE WHEN any_value(c) = 1 THEN sum(v) / CAST(count(*) AS DOUBLE)
  ELSE (sum(b) + sum(g) + sum(r)) / (3e0 * count(*)) END AS bright FROM fpx WHERE f <= 1000 GROUP BY 1, 2),
lagged AS (SELECT video_id, f, i, v, lag(v) OVER (PARTITION BY video_id, i ORDER BY f) AS w FROM fpx WHERE f <= 1000),
fd AS (SELECT video_id, f, sum(abs(v - w)) / CAST(count(*) AS DOUBLE) AS d FROM lagged WHERE w IS NOT NULL GROUP BY 1, 2),
counted AS (SELECT video_id, count(DISTINCT f) AS n FROM fpx GROUP BY 1 UNION ALL SELECT 30, 0 UNION ALL SELECT 40, -1),
videos AS (SELECT CAST(video_id AS BIGINT) AS video_id, '/media/clips/v' || video_id || '.mp4' AS path, CAST(n AS INT) AS frame_count,
  CASE WHEN n = -1 THEN -1e0 WHEN video_id % 20 = 1 THEN 0e0 ELSE 25e0 END AS fps,
  CASE WHEN n = -1 THEN -1 WHEN video_id = 20 THEN 1 ELSE 8 END AS side FROM counted),
m_bright AS (SELECT video_id, avg(bright) AS x FROM fb WHERE f <= 100 GROUP BY 1),
m_motion AS (SELECT video_id, avg(d) AS x FROM fd WHERE f BETWEEN 1 AND 49 GROUP BY 1),
m_scene AS (SELECT video_id, f FROM fd WHERE d > 30 AND f BETWEEN 1 AND 1000),
m_cons AS (SELECT video_id, CASE WHEN avg(bright) <= 0 THEN 0e0 ELSE stddev_pop(bright) / avg(bright) END AS x FROM fb WHERE f <= 49 GROUP BY 1),
firsts AS (SELECT video_id, any_value(c) AS c FROM fpx WHERE f = 0 GROUP BY 1)"""


def _kmeans(source: str, key: str, steps: int = 10, k: int = 3) -> str:
    """source has key, i (0-based, dense), n (pixels of the key), b, g, r.  Unrolled Lloyd steps over distinct colours."""
    ctes = [
        f"pts AS (SELECT {key}, b, g, r, count(*) AS w FROM {source} GROUP BY ALL)",
        f"c0 AS (SELECT {key}, k, CAST(b AS DOUBLE) AS b, CAST(g AS DOUBLE) AS g, CAST(r AS DOUBLE) AS r FROM {source}, (SELECT unnest(range({k})) AS k) WHERE i = k * n // {k})",
    ]
    for s in range(steps):
        ctes.append(
            f"n{s} AS (SELECT p.{key}, p.b, p.g, p.r, p.w, arg_min(c.k, (power(p.b-c.b,2)+power(p.g-c.g,2)+power(p.r-c.r,2), c.k)) AS k FROM pts p JOIN c{s} c USING ({key}) GROUP BY ALL)"
        )
        ctes.append(
            f"c{s + 1} AS (SELECT c.{key}, c.k, coalesce(sum(n.w*n.b)/CAST(sum(n.w) AS DOUBLE), any_value(c.b)) AS b, coalesce(sum(n.w*n.g)/CAST(sum(n.w) AS DOUBLE), any_value(c.g)) AS g, "
            f"coalesce(sum(n.w*n.r)/CAST(sum(n.w) AS DOUBLE), any_value(c.r)) AS r FROM c{s} c LEFT JOIN n{s} n ON n.{key} = c.{key} AND n.k = c.k GROUP BY c.{key}, c.k)"
        )
    return ",\n".join(ctes) + f"\nSELECT CAST({key} AS BIGINT) AS {key}, CAST(k AS INT) AS k, round(b, 4) AS b, round(g, 4) AS g, round(r, 4) AS r FROM c{steps}"


def _laplacian(source: str, w: int = 8, h: int = 8) -> str:
    return f"""lap AS (SELECT p.image_id, u.v + d.v + l.v + r.v - 4 * p.v AS l FROM {source} p
  JOIN {source} u ON u.image_id = p.image_id AND u.x = p.x AND u.y = abs(p.y - 1)
  JOIN {source} d ON d.image_id = p.image_id AND d.x = p.x AND d.y = {h - 1} - abs({h - 1} - (p.y + 1))
  JOIN {source} l ON l.image_id = p.image_id AND l.y = p.y AND l.x = abs(p.x - 1)
  JOIN {source} r ON r.image_id = p.image_id AND r.y = p.y AND r.x = {w - 1} - abs({w - 1} - (p.x + 1))),
blur AS (SELECT image_id, (64e0 * sum(CAST(l * l AS BIGINT)) - CAST(sum(l) AS DOUBLE) * CAST(sum(l) AS DOUBLE)) / 4096e0 AS blur FROM lap GROUP BY 1)"""


def _canny(w: int = 8, h: int = 8) -> str:
    return _CANNY.replace("least(7, greatest(0, p.x", f"least({w - 1}, greatest(0, p.x").replace("least(7, greatest(0, p.y", f"least({h - 1}, greatest(0, p.y")


_CANNY = """o AS (SELECT unnest(range(-1, 2)) AS d),
sob AS (SELECT p.image_id, p.y, p.x, sum(n.v * a.d * (2 - abs(b.d))) AS gx, sum(n.v * b.d * (2 - abs(a.d))) AS gy
  FROM gray p, o a, o b, gray n WHERE n.image_id = p.image_id AND n.x = least(7, greatest(0, p.x + a.d)) AND n.y = least(7, greatest(0, p.y + b.d)) GROUP BY 1, 2, 3),
mag AS (SELECT *, abs(gx) + abs(gy) AS m,
  CASE WHEN abs(gy)*32768 < abs(gx)*13573 THEN 0 WHEN abs(gy)*32768 > abs(gx)*13573 + abs(gx)*65536 THEN 1 ELSE 2 END AS dir,
  CASE WHEN (gx < 0) <> (gy < 0) THEN -1 ELSE 1 END AS s FROM sob),
nb AS (SELECT a.*, coalesce(p.m, 0) AS pm, coalesce(n.m, 0) AS nm FROM mag a
  LEFT JOIN mag p ON p.image_id = a.image_id AND p.y = a.y - (a.dir > 0)::INT AND p.x = a.x - CASE a.dir WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE a.s END
  LEFT JOIN mag n ON n.image_id = a.image_id AND n.y = a.y + (a.dir > 0)::INT AND n.x = a.x + CASE a.dir WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE a.s END),
cand AS (SELECT image_id, y, x, m FROM nb WHERE m > 100 AND m > pm AND CASE WHEN dir = 2 THEN m > nm ELSE m >= nm END),
edge AS (SELECT image_id, y, x FROM cand WHERE m > 200 UNION
  SELECT c.image_id, c.y, c.x FROM edge e JOIN cand c ON c.image_id = e.image_id AND abs(c.y - e.y) <= 1 AND abs(c.x - e.x) <= 1),
edges AS (SELECT image_id, count(e.y) AS n FROM (SELECT DISTINCT image_id FROM gray) LEFT JOIN edge e USING (image_id) GROUP BY 1)"""
_STATS = """st AS (SELECT image_id, sum(v) / 64e0 AS bright, max(v) AS hi, min(v) AS lo FROM gray GROUP BY 1)"""
_ENTROPY = "ent AS (SELECT image_id, -sum((n/64e0)*log2(n/64e0)) AS e FROM (SELECT image_id, v, count(*) AS n FROM {} GROUP BY 1, 2) GROUP BY 1)"
_VID = "FROM videos v LEFT JOIN {} m USING (video_id)"


def oracle_sql() -> dict[str, str]:
    feats = f"WITH RECURSIVE {_PX}, {_STATS}, {_laplacian('gray')}, {_CANNY}, f AS (SELECT image_id, bright, blur, n FROM st JOIN blur USING (image_id) JOIN edges USING (image_id))"
    bad = "vec_id % 50 = 49"
    z = lambda c, n, d: f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1e0 ELSE stddev_pop({c}) OVER () END), {d}) AS {n}"
    color = lambda body: f"WITH {_PX} {body}"
    wide = _PX.replace("gray AS (SELECT vec_id AS image_id, i, i // 8 AS y, i % 8 AS x", f"gray AS (SELECT vec_id AS image_id, i, i // {WIDE[0]} AS y, i % {WIDE[0]} AS x")
    return {
        "file_image_features": f"""WITH RECURSIVE {wide}, {_STATS}, {_laplacian('gray', *WIDE)}, {_canny(*WIDE)}, {_ENTROPY.format('gray')}
  SELECT image_id, NULL::VARCHAR AS error, {WIDE[0]} AS width, {WIDE[1]} AS height, {WIDE[0]} / {WIDE[1]}e0 AS aspect_ratio, 3 AS channels, false AS is_grayscale, round(bright, 6) AS average_brightness,
  round(blur, 4) AS blur_score, round(CASE WHEN hi = 0 THEN 0e0 ELSE hi / (lo + 1e-6) END, 4) AS contrast_ratio, round(e, 6) AS entropy, n AS edge_count
  FROM st JOIN blur USING (image_id) JOIN edges USING (image_id) JOIN ent USING (image_id)""",
        "file_image_native": """SELECT CASE WHEN vec_id % 3 = 0 THEN 'webp' ELSE 'png' END AS format, CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 1 END AS channels, vec_id % 3 <> 0 AS is_grayscale, count(*) AS n
  FROM embeddings GROUP BY ALL""",
        "file_folder": "SELECT 'image' AS kind, CASE WHEN vec_id % 3 = 0 THEN 'webp' ELSE 'png' END AS format, count(*) AS n FROM embeddings GROUP BY ALL",
        "file_video_features": f"""WITH {_FR}, sc AS (SELECT video_id, count(*) AS n FROM m_scene GROUP BY 1)
  SELECT video_id || '.avi' AS filename, NULL::VARCHAR AS error, frame_count, fps, side AS width, side AS height, round(CASE WHEN fps > 0 THEN frame_count / fps ELSE -1e0 END, 6) AS duration_seconds,
  true AS first_frame_extracted, true AS first_frame_saved, video_id || '_first_frame.jpg' AS first_frame_path, round(b.x, 6) AS average_brightness, false AS is_grayscale,
  round(coalesce(m.x, 0e0), 6) AS motion_score, CAST(coalesce(sc.n, 0) AS INT) AS n_scenes, 3 AS n_colors, CASE WHEN fps > 0 THEN 0e0 ELSE -1e0 END AS frame_rate_stability,
  round(k.x, 6) AS color_consistency FROM videos v JOIN firsts USING (video_id) LEFT JOIN m_bright b USING (video_id) LEFT JOIN m_motion m USING (video_id) LEFT JOIN sc USING (video_id) LEFT JOIN m_cons k USING (video_id)""",
        "file_video_colors": f"""WITH {_FR}, src AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY f, i) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n, b, g, r
  FROM fpx WHERE f <= 9), {_kmeans('src', 'video_id')}""",
        "file_report": f"""WITH {_PX} SELECT image_id, 0 AS videos, CAST({WIDE[0]} AS BIGINT) AS width, CAST({WIDE[1]} AS BIGINT) AS height, round(sum(g) / 64e0, 6) AS average_brightness, NULL::VARCHAR AS error FROM gray GROUP BY 1""",
        "file_stream_features": f"""WITH {wide}, {_STATS}, {_laplacian('gray', *WIDE)}
  SELECT image_id, {WIDE[0]} AS width, {WIDE[1]} AS height, round(bright, 6) AS average_brightness, round(blur, 4) AS blur_score, NULL::VARCHAR AS error FROM st JOIN blur USING (image_id)""",
        "file_frame_folders": f"""WITH {_PX} SELECT 'v' || (image_id % 2) AS folder, CAST(image_id // 2 AS INT) AS frame_index, round(sum(g) / 64e0, 6) AS average_brightness FROM gray GROUP BY image_id""",
        "file_existence": "SELECT vec_id AS image_id, vec_id % 5 <> 0 AS exists FROM embeddings",
        "file_router": f"""WITH {_FILES} SELECT path, regexp_matches(path, '{IMAGE_PATTERN}') AS is_image, regexp_matches(path, '{VIDEO_PATTERN}') AS is_video, {_KIND} AS kind,
  regexp_replace(regexp_extract(path, '([^/]*)\\z', 1), '(?s)(.)\\.[^.]*\\z', '\\1') || '_first_frame.jpg' AS still FROM files""",
        "file_kind_counts": f"WITH {_FILES} SELECT {_KIND} AS kind, count(*) AS n FROM files GROUP BY 1",
        "image_shape": f"""SELECT vec_id AS image_id, CASE WHEN {bad} THEN -1 ELSE 8 END AS width, CASE WHEN {bad} THEN -1 ELSE 8 END AS height,
  CASE WHEN {bad} THEN 0e0 ELSE 1e0 END AS aspect_ratio, CASE WHEN {bad} THEN -1 ELSE 1 END AS channels, NOT ({bad}) AS is_grayscale FROM embeddings""",
        "image_brightness_gray": color("SELECT image_id, round(CASE WHEN image_id % 50 = 49 THEN -1e0 ELSE sum(g) / 64e0 END, 6) AS average_brightness FROM gray GROUP BY 1"),
        "image_brightness_bgr": color("SELECT image_id, round((sum(b) + sum(g) + sum(r)) / 192e0, 6) AS average_brightness FROM color GROUP BY 1"),
        "image_contrast_ratio": color("SELECT image_id, round(CASE WHEN max(v) = 0 THEN 0e0 ELSE max(v) / (min(v) + 1e-6) END, 6) AS contrast_ratio FROM color GROUP BY 1"),
        "image_saturation": color("""SELECT image_id, round(sum(CASE WHEN hi = 0 THEN 0 ELSE (510 * (hi - lo) + hi) // (2 * hi) END) / 64e0, 6) AS saturation_level
  FROM (SELECT image_id, greatest(b, g, r) AS hi, least(b, g, r) AS lo FROM color) GROUP BY 1"""),
        "image_histogram": color(""", long AS (SELECT image_id, 0 AS channel, b AS v FROM color UNION ALL SELECT image_id, 1, g FROM color UNION ALL SELECT image_id, 2, r FROM color),
  cells AS (SELECT image_id, channel, CAST(bin AS INT) AS bin FROM (SELECT DISTINCT image_id FROM color), (SELECT unnest([0, 1, 2]) AS channel), (SELECT unnest(range(256)) AS bin))
  SELECT image_id, channel, bin, count(v) AS n FROM cells LEFT JOIN long ON long.image_id = cells.image_id AND long.channel = cells.channel AND long.v = cells.bin GROUP BY 1, 2, 3""".replace("SELECT image_id, channel, bin, count", "SELECT cells.image_id, cells.channel, cells.bin, count")),
        "image_entropy": color(f", {_ENTROPY.format('color')} SELECT image_id, round(e, 6) AS entropy FROM ent"),
        "image_blur_score": color(f", {_laplacian('color')} SELECT image_id, round(blur, 4) AS blur_score FROM blur"),
        "image_blur_gray": color(f", {_laplacian('gray')} SELECT image_id, round(blur, 4) AS blur_score FROM blur"),
        "image_edge_count": f"WITH RECURSIVE {_PX}, {_CANNY} SELECT image_id, n AS edge_count FROM edges",
        "image_dominant_colors": f"WITH {_PX}, src AS (SELECT image_id, i, 64 AS n, b, g, r FROM color), {_kmeans('src', 'image_id')}",
        "image_dominant_colors_k5": f"WITH {_PX}, src AS (SELECT image_id, i, 64 AS n, b, g, r FROM color), {_kmeans('src', 'image_id', k=5)}",
        "image_features": f"""WITH {_PX}, {_STATS}, {_laplacian('gray')}, {_ENTROPY.format('gray')}
  SELECT vec_id AS image_id, {_NAME} AS filename, CASE WHEN {bad} THEN 'Failed to load image' END AS error, CASE WHEN NOT ({bad}) THEN 8 END AS width,
  CASE WHEN NOT ({bad}) THEN 8 END AS height, CASE WHEN NOT ({bad}) THEN 1e0 END AS aspect_ratio, CASE WHEN NOT ({bad}) THEN true END AS is_grayscale,
  CASE WHEN NOT ({bad}) THEN round(bright, 6) END AS average_brightness, CASE WHEN NOT ({bad}) THEN 1 END AS channels, CASE WHEN NOT ({bad}) THEN round(blur, 4) END AS blur_score,
  CASE WHEN NOT ({bad}) THEN round(CASE WHEN hi = 0 THEN 0e0 ELSE hi / (lo + 1e-6) END, 4) END AS contrast_ratio, CASE WHEN NOT ({bad}) THEN round(e, 6) END AS entropy
  FROM embeddings JOIN st ON st.image_id = vec_id JOIN blur ON blur.image_id = vec_id JOIN ent ON ent.image_id = vec_id""",
        "video_metadata": f"""WITH {_FR} SELECT video_id, frame_count, fps, side AS width, side AS height,
  round(CASE WHEN fps > 0 AND frame_count >= 0 THEN frame_count / fps ELSE -1e0 END, 6) AS duration_seconds, CASE WHEN fps > 0 THEN 0e0 ELSE -1e0 END AS frame_rate_stability FROM videos""",
        "video_brightness": f"WITH {_FR} SELECT video_id, round(coalesce(x, -1e0), 6) AS average_brightness {_VID.format('m_bright')}",
        "video_motion_score": f"WITH {_FR} SELECT video_id, round(coalesce(x, 0e0), 6) AS motion_score {_VID.format('m_motion')}",
        "video_scene_changes": f"WITH {_FR} SELECT video_id, CAST(f AS INT) AS frame_index {_VID.format('m_scene')}",
        "video_color_consistency": f"WITH {_FR} SELECT video_id, round(coalesce(x, -1e0), 6) AS color_consistency {_VID.format('m_cons')}",
        "video_dominant_colors": f"""WITH {_FR}, src AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY f, i) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n, b, g, r
  FROM fpx WHERE f <= 9), {_kmeans('src', 'video_id')}""",
        "video_first_frame": f"""WITH {_FR} SELECT video_id, c IS NOT NULL AS first_frame_extracted, CASE WHEN c IS NOT NULL THEN side END AS width, CASE WHEN c IS NOT NULL THEN side END AS height,
  c AS channels, coalesce(c = 1, true) AS is_grayscale, CASE WHEN c IS NOT NULL THEN 'v' || video_id || '_first_frame.jpg' END AS first_frame_path {_VID.format('firsts')}""",
        "video_features": f"""WITH {_FR}, sc AS (SELECT video_id, count(*) AS n FROM m_scene GROUP BY 1), r AS (SELECT v.*, c, b.x AS br, m.x AS mo, sc.n AS sn, k.x AS co FROM videos v
  LEFT JOIN firsts USING (video_id) LEFT JOIN m_bright b USING (video_id) LEFT JOIN m_motion m USING (video_id) LEFT JOIN sc USING (video_id) LEFT JOIN m_cons k USING (video_id))
  SELECT video_id, path AS filename, NULL::VARCHAR AS error, frame_count, fps, side AS width, side AS height, round(CASE WHEN fps > 0 THEN frame_count / fps ELSE -1e0 END, 6) AS duration_seconds,
  c IS NOT NULL AS first_frame_extracted, round(coalesce(br, -1e0), 6) AS average_brightness, coalesce(c = 1, true) AS is_grayscale, round(coalesce(mo, 0e0), 6) AS motion_score,
  CAST(coalesce(sn, 0) AS INT) AS n_scenes, CASE WHEN c IS NULL THEN 0 ELSE 3 END AS n_colors, CASE WHEN fps > 0 THEN 0e0 ELSE -1e0 END AS frame_rate_stability,
  round(coalesce(co, -1e0), 6) AS color_consistency FROM r WHERE frame_count <> -1
  UNION ALL SELECT video_id, path, 'Failed to load video', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE frame_count = -1""",
        "qc_report": f"""{feats} SELECT image_id, CASE WHEN r = '' THEN 'PASS' ELSE 'FAIL: ' || r END AS qc FROM (SELECT image_id, concat_ws(', ', CASE WHEN blur < 2000 THEN 'blurry' END,
  CASE WHEN bright > 135 THEN 'overexposed' WHEN bright < 120 THEN 'underexposed' END) AS r FROM f)""",
        "motion_activity": f"WITH {_FR} SELECT video_id, CASE WHEN coalesce(x, 0e0) > 0.7 THEN 'HIGH' ELSE 'LOW' END AS activity {_VID.format('m_motion')}",
        "ml_features_scaled": f"{feats} SELECT image_id, CAST(image_id % 7 AS VARCHAR) AS label, {z('bright', 'average_brightness_scaled', 4)}, {z('n', 'edge_count_scaled', 4)}, {z('blur', 'blur_score_scaled', 4)} FROM f",
        "batch_summary": f"{feats} SELECT image_id || '.png' AS filename, round(bright, 6) AS average_brightness, round(blur, 4) AS blur_score FROM f",
    }
