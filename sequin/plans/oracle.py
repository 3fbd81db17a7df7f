"""DuckDB twins of every registered query (the correctness oracle).

Written independently of the Spark plans: the fixture and the mining steps are
plain SQL over the `events` view, windows and joins; the ordered chain is a
recursive CTE (step k = smallest position >= step k-1), not a fold.
Arrays are compared as ','-joined text, counters as BIGINT.
"""

from __future__ import annotations

# Fixed values of the fixture, as in sequin.sources.fixture: band width 50, bands 2
# and 3 normal, planted rule click-in-band-2 and view-in-band-2.
PREFIX = r"""
WITH RECURSIVE
ev AS (
  SELECT 'u_' || CAST(user_id AS VARCHAR) AS T_name,
         event_type AS S_dimension,
         CAST(floor(value / 50) AS INTEGER) AS band,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos
  FROM events
),
shapelet AS (
  SELECT DISTINCT 'shp-' || S_dimension || '-' || CAST(band AS VARCHAR) AS S_name, S_dimension,
         CASE WHEN band IN (2, 3) THEN 'normal' ELSE 'abnormal' END AS S_class, band
  FROM ev WHERE band IS NOT NULL
),
dataset AS (
  SELECT 'u_' || CAST(user_id AS VARCHAR) AS T_name,
         CASE WHEN bool_or(event_type = 'click' AND floor(value / 50) = 2)
               AND bool_or(event_type = 'view' AND floor(value / 50) = 2)
              THEN 'normal' ELSE 'abnormal' END AS class_d
  FROM events GROUP BY user_id
),
pos_grp AS (
  SELECT T_name, S_dimension, band, list(pos ORDER BY pos) AS ix
  FROM ev GROUP BY T_name, S_dimension, band
),
occ AS (
  SELECT s.S_name, 'events' AS S_origin, s.S_dimension, s.S_class, d.T_name,
         '[' || coalesce(array_to_string(p.ix, ', '), '') || ']' AS T_indice,
         coalesce(p.ix, CAST([] AS BIGINT[])) AS ix,
         CAST(0.0 AS DOUBLE) AS gain, s.band
  FROM dataset d CROSS JOIN shapelet s
  LEFT JOIN pos_grp p ON p.T_name = d.T_name AND p.S_dimension = s.S_dimension AND p.band = s.band
),
occ_nn AS (SELECT * FROM occ WHERE len(ix) > 0),
pick AS (
  SELECT S_class, T_name, S_dimension, S_name, ord, T_indice FROM (
    SELECT S_class, T_name, S_dimension, S_name, ix[1] AS ord, T_indice,
           row_number() OVER (PARTITION BY S_class, T_name, S_dimension ORDER BY ix[1], S_name, T_indice) AS rk
    FROM occ_nn) q
  WHERE rk = 1
),
pick_rn AS (
  SELECT *,
         CAST(row_number() OVER (PARTITION BY S_class, T_name ORDER BY ord, S_name, S_dimension, T_indice) - 1 AS INTEGER) AS bit,
         count(*) OVER (PARTITION BY S_class, T_name) AS d
  FROM pick
),
mask AS (
  SELECT S_class, T_name, CAST(unnest(generate_series(1, (CAST(1 AS BIGINT) << d) - 1)) AS BIGINT) AS mask
  FROM (SELECT DISTINCT S_class, T_name, d FROM pick_rn) q
),
seq_step AS (
  SELECT m.S_class, m.T_name, m.mask, p.S_name, p.S_dimension, p.ord, p.T_indice, p.bit
  FROM mask m JOIN pick_rn p
    ON p.S_class = m.S_class AND p.T_name = m.T_name AND ((m.mask >> p.bit) & 1) = 1
),
seq AS (
  SELECT S_class, T_name, mask,
         CAST(count(*) AS INTEGER) AS n_steps,
         string_agg(S_name, '>' ORDER BY bit) AS names,
         string_agg(CAST(ord AS VARCHAR), ',' ORDER BY bit) AS ords,
         string_agg(S_name, '+' ORDER BY S_name) AS set_key,
         T_name || '|' || string_agg(S_name, '>' ORDER BY bit) AS sid
  FROM seq_step GROUP BY S_class, T_name, mask
),
seq_item AS (
  SELECT s.S_class, s.T_name, s.sid, s.names, s.set_key, s.ords, s.n_steps,
         CAST(row_number() OVER (PARTITION BY st.S_class, st.T_name, st.mask ORDER BY st.bit) - 1 AS INTEGER) AS step,
         st.S_name, st.S_dimension, st.ord, st.T_indice
  FROM seq_step st JOIN seq s ON s.S_class = st.S_class AND s.T_name = st.T_name AND s.mask = st.mask
),
tmap AS (
  SELECT o.S_class, o.S_dimension, o.S_name, d.T_name, d.class_d,
         count(*) AS n_rows,
         max(CASE WHEN len(o.ix) = 0 THEN 1 ELSE 0 END) AS vetoed,
         max(CASE WHEN len(o.ix) > 0 THEN 1 ELSE 0 END) AS present,
         list_sort(list_distinct(flatten(list(o.ix)))) AS pos
  FROM occ o JOIN dataset d ON o.T_name = d.T_name
  GROUP BY o.S_class, o.S_dimension, o.S_name, d.T_name, d.class_d
),
tmapx AS (
  SELECT *, list_min(list_transform(pos, lambda x: CAST(x AS VARCHAR))) AS pmin_text FROM tmap
),
set_item AS (SELECT DISTINCT S_class, set_key, n_steps AS set_size, S_name FROM seq_item),
hit AS (
  SELECT *, (any_veto = 0 AND n_present >= 1) AS found, (any_veto = 0 AND n_present = set_size) AS complete
  FROM (
    SELECT si.S_class, si.set_key, si.set_size, t.T_name, t.class_d,
           CAST(sum(t.present) AS INTEGER) AS n_present, max(t.vetoed) AS any_veto
    FROM set_item si JOIN tmap t ON t.S_class = si.S_class AND t.S_name = si.S_name
    GROUP BY si.S_class, si.set_key, si.set_size, t.T_name, t.class_d
  ) q
),
cls AS (SELECT class_d AS S_class, count(*) AS n_class FROM dataset GROUP BY class_d),
tot AS (SELECT count(*) AS n FROM dataset),
set_verdict AS (
  SELECT s.S_class, s.set_key,
         CAST(coalesce(h.tp, 0) AS BIGINT) AS tp,
         CAST(coalesce(k.n_class, 0) - coalesce(h.tp, 0) AS BIGINT) AS fn,
         CAST(coalesce(h.n_found, 0) - coalesce(h.tp, 0) AS BIGINT) AS fp,
         CAST((SELECT n FROM tot) - coalesce(k.n_class, 0) - (coalesce(h.n_found, 0) - coalesce(h.tp, 0)) AS BIGINT) AS tn
  FROM (SELECT DISTINCT S_class, set_key FROM seq) s
  LEFT JOIN (SELECT S_class, set_key, count_if(found AND class_d = S_class) AS tp, count_if(found) AS n_found
             FROM hit GROUP BY S_class, set_key) h
    ON h.S_class = s.S_class AND h.set_key = s.set_key
  LEFT JOIN cls k ON k.S_class = s.S_class
),
var_item AS (SELECT DISTINCT S_class, set_key, names, ords, n_steps, S_name, ord FROM seq_item),
win AS (
  SELECT v.S_class, v.names, v.ords, v.n_steps, h.T_name, h.class_d, v.S_name, v.ord, t.pos, t.pmin_text
  FROM hit h
  JOIN var_item v ON v.S_class = h.S_class AND v.set_key = h.set_key
  JOIN tmapx t ON t.S_class = v.S_class AND t.S_name = v.S_name AND t.T_name = h.T_name
  WHERE h.found AND t.present = 1
),
first_entry AS (
  SELECT S_class, names, ords, T_name, class_d,
         min(CAST(ord AS VARCHAR) || '_' || pmin_text) AS first_entry
  FROM win GROUP BY S_class, names, ords, T_name, class_d
),
ptas AS (
  SELECT S_class, names, ords, max(CAST(split_part(first_entry, '_', 2) AS BIGINT)) AS tas_p
  FROM first_entry WHERE class_d = S_class GROUP BY S_class, names, ords
),
vp AS (
  SELECT s.S_class, s.sid, s.n_steps, v.tp, v.fn, v.fp, v.tn,
         CAST(v.tp + v.tn AS DOUBLE) / (SELECT n FROM tot) AS accuracy,
         coalesce(CAST(p.tas_p AS VARCHAR), '') AS tas
  FROM seq s
  JOIN set_verdict v ON v.S_class = s.S_class AND v.set_key = s.set_key
  LEFT JOIN ptas p ON p.S_class = s.S_class AND p.names = s.names AND p.ords = s.ords
),
oseq AS (SELECT DISTINCT S_class, names, n_steps FROM seq),
oitem AS (SELECT DISTINCT S_class, names, n_steps, step, S_name FROM seq_item),
chain(S_class, names, n_steps, T_name, class_d, step, cur, tas) AS (
  SELECT o.S_class, o.names, o.n_steps, t.T_name, t.class_d, 0, list_min(t.pos), [list_min(t.pos)]
  FROM oitem o JOIN tmap t ON t.S_class = o.S_class AND t.S_name = o.S_name
  WHERE o.step = 0 AND t.present = 1 AND t.vetoed = 0
  UNION ALL
  SELECT c.S_class, c.names, c.n_steps, c.T_name, c.class_d, c.step + 1,
         list_min(list_filter(t.pos, lambda x: x >= c.cur)),
         list_append(c.tas, list_min(list_filter(t.pos, lambda x: x >= c.cur)))
  FROM chain c
  JOIN oitem o ON o.S_class = c.S_class AND o.names = c.names AND o.step = c.step + 1
  JOIN tmap t ON t.S_class = o.S_class AND t.S_name = o.S_name AND t.T_name = c.T_name
  WHERE t.present = 1 AND t.vetoed = 0 AND list_min(list_filter(t.pos, lambda x: x >= c.cur)) IS NOT NULL
),
omatch AS (SELECT S_class, names, T_name, class_d, tas FROM chain WHERE step = n_steps - 1),
otas AS (
  SELECT S_class, names, string_agg(CAST(mx AS VARCHAR), ',' ORDER BY i) AS tas, max(n_tp) AS n_tp
  FROM (
    SELECT S_class, names, i, max(tas[i]) AS mx, count(*) AS n_tp
    FROM (SELECT S_class, names, tas, unnest(generate_series(1, len(tas))) AS i
          FROM omatch WHERE class_d = S_class) q
    GROUP BY S_class, names, i
  ) q2
  GROUP BY S_class, names
),
vo AS (
  SELECT o.S_class, o.names, o.n_steps,
         CAST(coalesce(m.tp, 0) AS BIGINT) AS tp,
         CAST(coalesce(k.n_class, 0) - coalesce(m.tp, 0) AS BIGINT) AS fn,
         CAST(coalesce(m.n_found, 0) - coalesce(m.tp, 0) AS BIGINT) AS fp,
         CAST((SELECT n FROM tot) - coalesce(k.n_class, 0) - (coalesce(m.n_found, 0) - coalesce(m.tp, 0)) AS BIGINT) AS tn,
         CAST(coalesce(m.tp, 0) + (SELECT n FROM tot) - coalesce(k.n_class, 0) - (coalesce(m.n_found, 0) - coalesce(m.tp, 0)) AS DOUBLE)
           / (SELECT n FROM tot) AS accuracy,
         coalesce(t.tas, '') AS tas
  FROM oseq o
  LEFT JOIN (SELECT S_class, names, count_if(class_d = S_class) AS tp, count(*) AS n_found
             FROM omatch GROUP BY S_class, names) m ON m.S_class = o.S_class AND m.names = o.names
  LEFT JOIN cls k ON k.S_class = o.S_class
  LEFT JOIN otas t ON t.S_class = o.S_class AND t.names = o.names
)
"""

# Series of a class whose cells agree, named by the smallest of them.
_PROFILES = """
, prof AS (
  SELECT S_class, min(T_name) AS profile, count(*) AS n_series
  FROM (SELECT S_class, T_name, string_agg(S_name || ':' || S_dimension || ':' || present || vetoed, ';' ORDER BY S_name, S_dimension) AS cells
        FROM tmap GROUP BY S_class, T_name) q
  GROUP BY S_class, cells
)
"""

BODIES: dict[str, str] = {
    "src_dataset": "SELECT T_name, class_d FROM dataset",
    "src_occurrences": """
        SELECT S_name, S_origin, S_dimension, S_class, T_name, T_indice, gain,
               CAST(2 AS BIGINT) AS n_sub, CAST(band * 50 AS DOUBLE) AS sub_lo,
               CAST(1 AS BIGINT) AS n_dist, CAST(0.0 AS DOUBLE) AS dist_self
        FROM occ""",
    "src_occurrence_rejects": """
        SELECT S_name, CASE WHEN k <> 0 THEN T_name END AS T_name, CASE WHEN k NOT IN (0, 1) THEN gain END AS gain,
               CASE WHEN k NOT IN (0, 2) THEN CAST(len(ix) AS BIGINT) END AS n_ix,
               CASE WHEN k NOT IN (0, 3) THEN CAST(2 AS BIGINT) END AS n_sub,
               CASE WHEN k NOT IN (0, 4) THEN CAST(1 AS BIGINT) END AS n_dist,
               CASE k WHEN 0 THEN 'fewer than 9 fields in line: ' || S_name || ';' || S_origin || ';' || S_dimension
                      WHEN 1 THEN 'unreadable gain: high' WHEN 2 THEN 'unreadable position list: [0, x]'
                      WHEN 3 THEN 'unreadable value list: [1.0, y]' WHEN 4 THEN 'unreadable distances: {oops}' END AS reject
        FROM (SELECT *, (CAST(split_part(T_name, '_', 2) AS BIGINT) + length(S_name)) % 7 AS k FROM occ) q""",
    "sink_wrapped": "SELECT S_name, S_origin, S_dimension, S_class, T_name, T_indice, gain FROM occ",
    "parse_indices": """
        SELECT S_name, T_name, T_indice, CAST(len(ix) AS BIGINT) AS n_ix,
               ix[1] AS first_ix, ix[len(ix)] AS last_ix,
               CASE WHEN len(ix) > 0 THEN 1 ELSE 0 END AS found
        FROM occ""",
    "project_occurrence": "SELECT S_dimension, S_name, S_class, T_name, T_indice FROM occ",
    "occurring_only": "SELECT S_dimension, S_name, S_class, T_name, T_indice FROM occ WHERE T_indice <> '[]'",
    "join_class_left": """
        SELECT o.S_dimension, o.S_name, o.S_class, o.T_indice, d.T_name, d.class_d
        FROM occ o LEFT JOIN dataset d ON d.T_name = o.T_name""",
    "encode_series": """
        SELECT S_class, T_name, CAST(count(*) AS BIGINT) AS n_shapelets,
               string_agg(S_dimension || ':' || S_name || ':' || CAST(first AS VARCHAR) || ':'
                          || CAST(n_rows AS VARCHAR) || ':' || CAST(n_pos AS VARCHAR), ';'
                          ORDER BY S_dimension, S_name) AS shapelets
        FROM (SELECT S_class, T_name, S_dimension, S_name, min(ix[1]) AS first,
                     count(*) AS n_rows, sum(len(ix)) AS n_pos
              FROM occ_nn GROUP BY S_class, T_name, S_dimension, S_name) q
        GROUP BY S_class, T_name""",
    "shapelet_series_map": """
        SELECT t.S_class, t.S_dimension, t.S_name, t.T_name, t.class_d, CAST(t.n_rows AS BIGINT) AS n_rows,
               t.vetoed, t.present, CAST(sum(len(o.ix)) AS BIGINT) AS n_pos,
               list_min(t.pos) AS pmin, list_max(t.pos) AS pmax, t.pmin_text
        FROM tmapx t JOIN occ o
          ON o.S_class = t.S_class AND o.S_name = t.S_name AND o.S_dimension = t.S_dimension AND o.T_name = t.T_name
        GROUP BY ALL""",
    "series_tuples": """
        SELECT S_class, T_name, S_dimension, S_name, T_indice, gain, CAST(count(*) AS BIGINT) AS n_rows
        FROM occ_nn GROUP BY ALL""",
    "shapelet_tuples": """
        SELECT o.S_dimension, o.S_name, o.S_class, d.T_name, o.T_indice, CAST(count(*) AS BIGINT) AS n_rows
        FROM occ o LEFT JOIN dataset d ON d.T_name = o.T_name GROUP BY ALL""",
    "pick_per_dimension": "SELECT S_class, T_name, S_dimension, S_name, ord, T_indice FROM pick",
    "enumerate_sequences": "SELECT S_class, T_name, mask, sid, n_steps, names, ords, set_key FROM seq",
    "order_sequence": """
        SELECT S_class, sid, names,
               string_agg(S_name, '>' ORDER BY split_part(T_indice, ',', 1), S_name) AS names_literal
        FROM seq_item GROUP BY S_class, sid, names""",
    "distinct_sequences": """
        SELECT S_class, names, set_key, n_steps, CAST(count(*) AS BIGINT) AS n_sources
        FROM seq GROUP BY S_class, names, set_key, n_steps""",
    "class_sequences": """
        SELECT S_class, CAST(count(*) AS BIGINT) AS n_sequences, CAST(count(DISTINCT T_name) AS BIGINT) AS n_sources,
               max(n_steps) AS max_steps, CAST(sum(n_steps) AS BIGINT) AS total_steps
        FROM seq GROUP BY S_class""",
    "class_sequence_rows": """
        SELECT S_class, names, ords, n_steps, CAST(count(*) AS BIGINT) AS n_sources
        FROM seq GROUP BY S_class, names, ords, n_steps""",
    "sequence_count_by_class": """
        SELECT S_class, CAST(count(*) AS BIGINT) AS n_sequences,
               CAST(count(DISTINCT names) AS BIGINT) AS n_ordered,
               CAST(count(DISTINCT set_key) AS BIGINT) AS n_sets
        FROM seq GROUP BY S_class""",
    "sequence_items": """
        SELECT S_class, sid, names, set_key, n_steps, step, S_name, S_dimension, ord FROM seq_item""",
    "shapelet_name_order": """
        SELECT S_class, T_name, S_dimension, S_name AS shapelet_name, ix[1] AS shapelet_order FROM occ_nn""",
    "join_sequence_occurrence": """
        SELECT i.S_class, i.sid, i.step, i.S_name AS shapelet_name,
               CAST(coalesce(m.n_series, 0) AS BIGINT) AS n_series,
               CAST(coalesce(m.n_present, 0) AS BIGINT) AS n_present,
               CAST(coalesce(m.n_vetoed, 0) AS BIGINT) AS n_vetoed
        FROM seq_item i LEFT JOIN (
            SELECT S_class, S_name, count(*) AS n_series, sum(present) AS n_present, sum(vetoed) AS n_vetoed
            FROM tmap GROUP BY S_class, S_name) m
          ON m.S_class = i.S_class AND m.S_name = i.S_name""",
    "join_sequence_occurrence_cells": _PROFILES
    + """
        SELECT i.S_class, i.S_name AS shapelet_name, i.ord AS shapelet_order, p.profile, t.present, t.vetoed,
               CAST(i.n_items AS BIGINT) AS n_items, CAST(coalesce(p.n_series, 0) AS BIGINT) AS n_series,
               CAST(i.n_items * greatest(coalesce(p.n_series, 0), 1) AS BIGINT) AS n_flat
        FROM (SELECT S_class, S_name, ord, count(*) AS n_items FROM seq_item GROUP BY ALL) i
        LEFT JOIN (tmap t JOIN prof p ON p.S_class = t.S_class AND p.profile = t.T_name)
          ON t.S_class = i.S_class AND t.S_name = i.S_name""",
    "join_sequence_occurrence_rows": """
        SELECT i.S_class, i.S_name AS shapelet_name, i.ord AS shapelet_order, o.T_name, o.T_indice, CAST(i.n_items AS BIGINT) AS n_items
        FROM (SELECT S_class, S_name, ord, count(*) AS n_items FROM seq_item GROUP BY ALL) i
        LEFT JOIN (SELECT o.* FROM occ o JOIN dataset d ON d.T_name = o.T_name) o ON o.S_class = i.S_class AND o.S_name = i.S_name""",
    "presence_matrix": """
        SELECT S_class, set_key, set_size, T_name, class_d, n_present, any_veto,
               CAST(found AS INTEGER) AS found, CAST(complete AS INTEGER) AS complete
        FROM hit""",
    "pivot_presence": """
        SELECT S_class, S_name,
               CAST(count_if(present = 1 AND class_d = 'abnormal') AS BIGINT) AS abnormal,
               CAST(count_if(present = 1 AND class_d = 'normal') AS BIGINT) AS normal
        FROM tmap GROUP BY S_class, S_name""",
    "pivot_positions": """
        SELECT S_class, S_dimension, S_name,
               coalesce(string_agg(c, '|' ORDER BY c) FILTER (T_name = 'u_1'), '') AS u_1,
               coalesce(string_agg(c, '|' ORDER BY c) FILTER (T_name = 'u_2'), '') AS u_2,
               coalesce(string_agg(c, '|' ORDER BY c) FILTER (T_name = 'u_3'), '') AS u_3,
               coalesce(string_agg(c, '|' ORDER BY c) FILTER (T_name = 'u_4'), '') AS u_4,
               coalesce(string_agg(c, '|' ORDER BY c) FILTER (T_name = 'u_5'), '') AS u_5,
               coalesce(string_agg(c, '|' ORDER BY c) FILTER (T_name = 'u_6'), '') AS u_6,
               coalesce(string_agg(c, '|' ORDER BY c) FILTER (T_name = 'u_7'), '') AS u_7,
               coalesce(string_agg(c, '|' ORDER BY c) FILTER (T_name = 'u_8'), '') AS u_8
        FROM (SELECT *, CASE WHEN len(ix) = 0 THEN 'x' ELSE array_to_string(ix, ', ') END AS c FROM occ) q
        GROUP BY S_class, S_dimension, S_name""",
    "sequence_profile": """
        SELECT S_class, names, ords, T_name, CAST(max(n_steps) AS BIGINT) AS n_shapelets, string_agg(e, ',' ORDER BY e) AS window
        FROM (SELECT S_class, names, ords, n_steps, T_name,
                     CAST(ord AS VARCHAR) || '_' || CAST(unnest(pos) AS VARCHAR) AS e FROM win) q
        GROUP BY S_class, names, ords, T_name""",
    "sequence_profile_windows": _PROFILES
    + """
        SELECT q.S_class, q.set_key, q.profile, q.n_present, q.shape, q.marker,
               CAST(n.n_sequences AS BIGINT) AS n_sequences, CAST(q.n_series AS BIGINT) AS n_series
        FROM (
          SELECT si.S_class, si.set_key, p.profile, p.n_series, CAST(sum(coalesce(t.present, 0)) AS INTEGER) AS n_present,
                 string_agg(CASE WHEN t.vetoed = 1 THEN 'x' WHEN t.present = 1 THEN 'p' ELSE '-' END, '' ORDER BY si.S_name) AS shape,
                 CASE WHEN max(t.vetoed) = 1 THEN 'x' ELSE '' END AS marker, count(t.T_name) AS n_cells
          FROM set_item si JOIN prof p ON p.S_class = si.S_class
          LEFT JOIN tmap t ON t.S_class = si.S_class AND t.S_name = si.S_name AND t.T_name = p.profile
          GROUP BY si.S_class, si.set_key, p.profile, p.n_series) q
        JOIN (SELECT S_class, set_key, count(*) AS n_sequences FROM seq GROUP BY ALL) n ON n.S_class = q.S_class AND n.set_key = q.set_key
        WHERE q.n_cells > 0""",
    "sequence_profile_vetoed": """
        SELECT w.S_class, w.set_key, w.T_name, string_agg(w.e, ',' ORDER BY w.e) AS window
        FROM (
          SELECT si.S_class, si.set_key, o.T_name,
                 unnest(CASE WHEN len(o.ix) = 0 THEN ['x'] ELSE list_transform(o.ix, lambda p: CAST(si.place AS VARCHAR) || '_' || CAST(p AS VARCHAR)) END) AS e
          FROM (SELECT *, row_number() OVER (PARTITION BY S_class, set_key ORDER BY S_name) - 1 AS place FROM set_item) si
          JOIN occ o ON o.S_class = si.S_class AND o.S_name = si.S_name) w
        JOIN hit h ON h.S_class = w.S_class AND h.set_key = w.set_key AND h.T_name = w.T_name
        WHERE h.any_veto = 1
        GROUP BY w.S_class, w.set_key, w.T_name""",
    "sequence_hits": "SELECT S_class, set_key, T_name, class_d FROM hit WHERE found",
    "rerank_window": """
        SELECT S_class, names, ords, T_name,
               string_agg(CAST(rk AS VARCHAR) || '_' || CAST(p AS VARCHAR), ',' ORDER BY o || '_' || CAST(p AS VARCHAR), rk) AS window
        FROM (
          SELECT S_class, names, ords, T_name, CAST(ord AS VARCHAR) AS o, unnest(pos) AS p,
                 row_number() OVER (PARTITION BY S_class, names, ords, T_name ORDER BY CAST(ord AS VARCHAR), S_name) - 1 AS rk
          FROM win
        ) q
        GROUP BY S_class, names, ords, T_name""",
    "tas_first_index": """
        SELECT S_class, names, ords, T_name, CAST(split_part(first_entry, '_', 2) AS BIGINT) AS tas_first
        FROM first_entry""",
    "tas_combine": "SELECT S_class, names, CAST(n_tp AS BIGINT) AS n_tp, tas FROM otas",
    "ordered_match": """
        SELECT S_class, names, T_name, class_d, array_to_string(tas, ',') AS tas FROM omatch""",
    "array_functions": """
        SELECT S_name, T_name, CAST(len(ix) AS BIGINT) AS n_ix, list_min(ix) AS min_ix, list_max(ix) AS max_ix,
               CASE WHEN list_contains(ix, 0) THEN 1 ELSE 0 END AS has_zero,
               CASE WHEN len(list_filter(ix, lambda x: x % 2 <> 0)) = 0 THEN 1 ELSE 0 END AS all_even,
               CASE WHEN len(list_filter(ix, lambda x: x > 50)) > 0 THEN 1 ELSE 0 END AS any_over_50,
               CAST(len(list_filter(ix, lambda x: x < 10)) AS BIGINT) AS n_under_10,
               list_max(list_transform(range(1, len(ix)), lambda i: ix[i + 1] - ix[i])) AS max_gap,
               split_part(T_indice, ',', 1) AS first_tok,
               CAST(coalesce(list_sum(ix), 0) AS BIGINT) AS sum_ix
        FROM occ""",
    "confusion_counts": "SELECT S_class, sid, tp, fn, fp, tn FROM vp",
    "confusion_bitmaps": "SELECT S_class, sid, tp, fn, fp, tn FROM vp",
    "sequence_accuracy": "SELECT S_class, sid, accuracy FROM vp",
    "accurate_sequences": "SELECT S_class, sid, accuracy, tas FROM vp WHERE accuracy >= 0.8",
    "accurate_ordered": "SELECT S_class, names, n_steps, tp, fn, fp, tn, accuracy, tas FROM vo WHERE accuracy >= 0.8",
    "preview_verdict": """
        SELECT S_class, sid, accuracy, tas FROM vp ORDER BY accuracy DESC, S_class, sid LIMIT 20""",
    "verdict_full": """
        SELECT sid AS sequence_id, S_class, n_steps AS n_shapelets, accuracy AS Accuracy, tas AS TAS FROM vp""",
    "verdict_profile": """
        SELECT v.sid AS sequence_id, v.S_class, CAST(w.n AS BIGINT) AS n_shapelets, w.T_name, w.udaf_t,
               v.accuracy AS Accuracy, v.tas AS TAS
        FROM vp v JOIN seq s ON s.S_class = v.S_class AND s.sid = v.sid
        JOIN (SELECT S_class, names, ords, T_name, max(n_steps) AS n, string_agg(e, ',' ORDER BY e) AS udaf_t
              FROM (SELECT S_class, names, ords, n_steps, T_name,
                           CAST(ord AS VARCHAR) || '_' || CAST(unnest(pos) AS VARCHAR) AS e FROM win) q
              GROUP BY S_class, names, ords, T_name) w
          ON w.S_class = s.S_class AND w.names = s.names AND w.ords = s.ords""",
    "verdict_presence": "SELECT S_class, sid, n_steps, tp, fn, fp, tn, accuracy, tas FROM vp",
    "verdict_ordered": "SELECT S_class, names, n_steps, tp, fn, fp, tn, accuracy, tas FROM vo",
    "shapelet_support": """
        SELECT t.S_class, t.S_name, CAST(coalesce(k.n_class, 0) AS BIGINT) AS n_class,
               CAST(count_if(t.present = 1 AND t.vetoed = 0 AND t.class_d = t.S_class) AS BIGINT) AS n_hit_same,
               CAST(count_if(t.present = 1 AND t.vetoed = 0)
                    - count_if(t.present = 1 AND t.vetoed = 0 AND t.class_d = t.S_class) AS BIGINT) AS n_hit_other,
               CASE WHEN coalesce(k.n_class, 0) = 0 THEN NULL
                    ELSE CAST(count_if(t.present = 1 AND t.vetoed = 0 AND t.class_d = t.S_class) AS DOUBLE) / k.n_class
               END AS support
        FROM tmap t LEFT JOIN cls k ON k.S_class = t.S_class
        GROUP BY t.S_class, t.S_name, k.n_class""",
    "sink_verdict": "SELECT S_class, sid, n_steps, tp, fn, fp, tn, accuracy, tas FROM vp",
}


def oracle_sql() -> dict[str, str]:
    return {name: PREFIX + body for name, body in BODIES.items()}
