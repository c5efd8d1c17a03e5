"""DuckDB SQL for every registered query, written straight from the definitions.

``@six`` stands for the rounding to six decimals. Unlike the Spark jobs, the SQL builds the whole sample x taxon grid, tests every point
against every polygon edge and computes the three metrics one by one.
"""

from fixture.bindings import GENUS, OLD_DATUM, POLYGONS, SPECIES, STRIPS, WIDE_RINGS
from fixture.registry import LOCATION, METRIC, OFF_TIE, REGION, REGIONS, SAMPLES, STRIP
from shoalkit.functions.datum import DATUMS, ELLIPSOIDS

TAXON = "family, genus, species"
SAME_TAXON = " AND ".join(f"{{a}}.{c} IS NOT DISTINCT FROM {{b}}.{c}" for c in ("family", "genus", "species"))


def _same_taxon(a, b):
    return SAME_TAXON.format(a=a, b=b)


def _edges(polygons=POLYGONS):
    rows = []
    for name, ring in polygons.items():
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            rows.append(f"('{name}', {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS e(bioregion, x1, y1, x2, y2)"


def _vector(lon, lat, end):
    """Unit vector of a point as three SQL columns ``ux.., uy.., uz..``."""
    return (f"cos(radians({lat})) * cos(radians({lon})) AS ux{end}, cos(radians({lat})) * sin(radians({lon})) AS uy{end}, "
            f"sin(radians({lat})) AS uz{end}")


def _in_arcs(edges, points="SELECT sample_url, longitude_dd AS x, latitude_dd AS y FROM dep"):
    """Every point against every arc: north of it lies an odd number of arcs, by the sign of the triple product."""
    return f""", edges AS ({edges}),
        arcs AS (SELECT *, {_vector('x1', 'y1', 1)}, {_vector('x2', 'y2', 2)} FROM edges),
        planes AS (SELECT bioregion, x1, x2, uy1 * uz2 - uz1 * uy2 AS nx, uz1 * ux2 - ux1 * uz2 AS ny,
                   ux1 * uy2 - uy1 * ux2 AS nz FROM arcs),
        points AS (SELECT *, {_vector('x', 'y', 0)} FROM ({points}))
        SELECT sample_url, round(x@six) AS longitude_dd, round(y@six) AS latitude_dd, bioregion FROM (
          SELECT sample_url, x, y, bioregion,
                 sum(CASE WHEN (x1 > x) <> (x2 > x) AND (nx * ux0 + ny * uy0 + nz * uz0) * sign(x2 - x1) < 0
                     THEN 1 ELSE 0 END) % 2 = 1 AS inside
          FROM points, planes GROUP BY ALL) WHERE inside"""


def _shifted(source, keep, lon, lat):
    """The rows of ``source`` with two columns brought from the old datum to WGS84, step by step."""
    name, (tx, ty, tz, rx, ry, rz, ppm) = DATUMS[OLD_DATUM]
    (a, f), (b, g) = ELLIPSOIDS[name], ELLIPSOIDS["WGS84"]
    e, d = f"((2 - 1 / {f}) / {f})", f"((2 - 1 / {g}) / {g})"
    turn = lambda seconds: f"radians({seconds} / 3600)"
    normal = f"({a} / sqrt(1 - {e} * sin(radians({lat})) ^ 2))"
    return f"""WITH metres AS (SELECT {keep}, {normal} * cos(radians({lat})) * cos(radians({lon})) AS gx,
            {normal} * cos(radians({lat})) * sin(radians({lon})) AS gy, {normal} * (1 - {e}) * sin(radians({lat})) AS gz FROM {source}),
        moved AS (SELECT {keep}, {tx} + (1 + {ppm} * 1e-6) * (gx - {turn(rz)} * gy + {turn(ry)} * gz) AS gx,
            {ty} + (1 + {ppm} * 1e-6) * ({turn(rz)} * gx + gy - {turn(rx)} * gz) AS gy,
            {tz} + (1 + {ppm} * 1e-6) * (-{turn(ry)} * gx + {turn(rx)} * gy + gz) AS gz FROM metres),
        step0 AS (SELECT {keep}, gx, gy, gz, sqrt(gx * gx + gy * gy) AS r, atan2(gz, sqrt(gx * gx + gy * gy) * (1 - {d})) AS phi FROM moved)
        """ + "".join(f""", step{k + 1} AS (SELECT {keep}, gx, gy, gz, r,
            atan2(gz + {d} * {b} / sqrt(1 - {d} * sin(phi) ^ 2) * sin(phi), r) AS phi FROM step{k})""" for k in range(6)) + (
        f" SELECT {keep}, degrees(atan2(gy, gx)) AS {lon}, degrees(phi) AS {lat} FROM step6")


BASE_OF_REGION = rf"""
WITH dep AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS sample_url, CAST(o_custkey AS VARCHAR) AS campaignid,
         CAST(o_orderkey % 100 AS VARCHAR) AS sample, o_orderdate AS date_time,
         150 + (o_orderkey % 1000) / 100 AS longitude_dd, -38 + (o_orderkey % 777) / 100 AS latitude_dd,
         CASE o_orderstatus WHEN 'F' THEN 'Fished' WHEN 'O' THEN 'No-Take' END AS status,
         o_orderpriority <> '5-LOW' AS successful_count,
         o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') AS successful_length,
         o_totalprice / 10000 AS depth_m, @region AS bioregion, n_name AS location,
         CASE WHEN o_orderkey % 3 = 0 THEN 'UVC' ELSE 'stereo-BRUVs' END AS method,
         strftime(o_orderdate, '%Y') AS year, CAST(o_orderdate AS DATE) AS date
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE @region IS NOT NULL
), lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS sample_url, p_type AS family,
         split_part(p_name, ' ', 2) AS genus, split_part(p_name, ' ', 1) AS species,
         CAST(l_quantity AS BIGINT) AS count, l_extendedprice / 100 AS length_mm, l_returnflag, l_linestatus
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT sample_url FROM dep)
), life0 AS (
  SELECT p_type AS family, split_part(p_name, ' ', 2) AS genus, split_part(p_name, ' ', 1) AS species,
         min(p_partkey) AS k, min(p_brand) AS brand FROM part GROUP BY ALL
), life AS (
  SELECT {TAXON},
         CASE family WHEN 'PROMO' THEN 'Mammalia' WHEN 'SMALL' THEN 'Elasmobranchii' ELSE 'Actinopterygii' END AS class,
         CASE WHEN k % 11 <> 0 THEN 10.0::DOUBLE + k % 20 END AS rls_thermal_niche,
         CASE WHEN k % 13 <> 0 THEN brand END AS australian_common_name
  FROM life0
), fishes AS (
  SELECT * FROM life WHERE class IN ('Actinopterygii', 'Elasmobranchii')
), recoded AS (
  SELECT sample_url, family, genus,
         CASE WHEN genus = '{GENUS}' THEN '{SPECIES}' ELSE species END AS species, count FROM lines
), counts AS (
  SELECT * FROM recoded c WHERE EXISTS (SELECT 1 FROM fishes f WHERE {_same_taxon('f', 'c')})
), lengths AS (
  SELECT sample_url, {TAXON}, length_mm, count FROM lines c
  WHERE EXISTS (SELECT 1 FROM fishes f WHERE {_same_taxon('f', 'c')})
), ok AS (SELECT * FROM dep WHERE successful_count
), days AS (SELECT DISTINCT campaignid, date FROM dep WHERE date IS NOT NULL
), flagged AS (
  SELECT *, CASE WHEN coalesce(date_diff('day', lag(date) OVER w, date) > 14, true) THEN 1 ELSE 0 END AS fresh
  FROM days WINDOW w AS (PARTITION BY campaignid ORDER BY date)
), numbered AS (
  SELECT campaignid, date, CAST(sum(fresh) OVER (PARTITION BY campaignid ORDER BY date) AS BIGINT) AS event_number
  FROM flagged
), calendar AS (
  SELECT *, campaignid || '_' || strftime(start_date, '%Y%m%d') AS new_campaignid,
         strftime(start_date, '%Y-%m') AS start_month
  FROM (SELECT *, min(date) OVER (PARTITION BY campaignid, event_number) AS start_date FROM numbered)
), abundance_rows AS (
  SELECT ok.campaignid, ok.sample, coalesce(v.sample_url, ok.sample_url) AS sample_url, 'total_abundance' AS metric,
         CAST(coalesce(v.value, 0) AS DOUBLE) AS value
  FROM (SELECT sample_url, sum(count) AS value FROM counts GROUP BY 1) v FULL JOIN ok ON v.sample_url = ok.sample_url
), richness_rows AS (
  SELECT ok.campaignid, ok.sample, coalesce(v.sample_url, ok.sample_url) AS sample_url, 'species_richness' AS metric,
         CAST(coalesce(v.value, 0) AS DOUBLE) AS value
  FROM (SELECT sample_url, count(*) AS value FROM (SELECT DISTINCT sample_url, {TAXON} FROM counts) GROUP BY 1) v
  FULL JOIN ok ON v.sample_url = ok.sample_url
), cti_values AS (
  SELECT c.sample_url, sum(count * rls_thermal_niche) / nullif(sum(count), 0) AS value,
         sum(ln(count + 1) * rls_thermal_niche) / nullif(sum(ln(count + 1)), 0) AS log_value
  FROM counts c JOIN life f ON {_same_taxon('f', 'c')} WHERE rls_thermal_niche IS NOT NULL GROUP BY 1
), cti_rows AS (
  SELECT d.campaignid, d.sample, v.sample_url, 'cti' AS metric, v.value
  FROM cti_values v LEFT JOIN dep d ON v.sample_url = d.sample_url WHERE v.value IS NOT NULL
), metrics AS (
  SELECT m.campaignid, m.sample, m.sample_url, m.metric, m.value, d.bioregion, d.status,
         o.date_time, o.date, e.event_number, e.start_date, e.new_campaignid, e.start_month
  FROM (SELECT * FROM abundance_rows UNION ALL SELECT * FROM richness_rows UNION ALL SELECT * FROM cti_rows) m
  LEFT JOIN dep d ON m.sample_url = d.sample_url
  LEFT JOIN ok o ON m.sample_url = o.sample_url
  LEFT JOIN calendar e ON m.campaignid = e.campaignid AND o.date = e.date
), grid AS (
  SELECT s.sample_url, t.family, t.genus, t.species, coalesce(c.count, 0) AS count, d.bioregion, d.status,
         CASE WHEN d.successful_count THEN d.year END AS year
  FROM (SELECT sample_url FROM ok UNION SELECT sample_url FROM counts) s
  CROSS JOIN (SELECT DISTINCT {TAXON} FROM counts WHERE family IS NOT NULL) t
  LEFT JOIN counts c ON s.sample_url = c.sample_url AND {_same_taxon('t', 'c')}
  LEFT JOIN dep d ON s.sample_url = d.sample_url
), top_overall AS (
  SELECT {TAXON}, avg(count) AS average_abundance, stddev_samp(count) / sqrt(count(*)) AS se
  FROM grid GROUP BY ALL ORDER BY 4 DESC, 1, 2, 3 LIMIT 50
), top_region AS (
  SELECT bioregion, {TAXON}, average_abundance, se FROM (
    SELECT *, row_number() OVER (PARTITION BY bioregion ORDER BY average_abundance DESC, {TAXON}) AS rank FROM (
      SELECT bioregion, {TAXON}, avg(count) AS average_abundance, stddev_samp(count) / sqrt(count(*)) AS se
      FROM grid GROUP BY ALL)) WHERE rank <= 50
), top_overall_status AS (
  SELECT status, {TAXON}, avg(count) AS average_abundance, stddev_samp(count) / sqrt(count(*)) AS se
  FROM grid g WHERE EXISTS (SELECT 1 FROM top_overall t WHERE {_same_taxon('t', 'g')}) GROUP BY ALL
), top_region_status AS (
  SELECT bioregion, status, {TAXON}, avg(count) AS average_abundance, stddev_samp(count) / sqrt(count(*)) AS se
  FROM grid g
  WHERE EXISTS (SELECT 1 FROM top_region t WHERE t.bioregion IS NOT DISTINCT FROM g.bioregion AND {_same_taxon('t', 'g')})
  GROUP BY ALL
), top_region_year AS (
  SELECT bioregion, status, year, {TAXON}, avg(count) AS average_abundance,
         stddev_samp(count) / sqrt(count(*)) AS se
  FROM grid g
  WHERE EXISTS (SELECT 1 FROM top_region t WHERE t.bioregion IS NOT DISTINCT FROM g.bioregion AND {_same_taxon('t', 'g')})
  GROUP BY ALL
), top_all AS (
  SELECT NULL AS bioregion, NULL AS status, *, 'overall' AS "group", false AS by_status FROM top_overall
  UNION ALL SELECT bioregion, NULL, {TAXON}, average_abundance, se, 'bioregion', false FROM top_region
  UNION ALL SELECT NULL, status, {TAXON}, average_abundance, se, 'overall', true FROM top_overall_status
  UNION ALL SELECT bioregion, status, {TAXON}, average_abundance, se, 'bioregion', true FROM top_region_status
), names AS (
  SELECT {TAXON}, australian_common_name, coalesce(genus, 'NA') || ' ' || coalesce(species, 'NA') || ' ('
         || coalesce(australian_common_name, 'NA') || ')' AS display_name FROM life
), labels_by_taxon AS (
  SELECT *, regexp_extract(display_name, '^(.*?)\s*\((.*?)\)$', 1) AS sci,
         regexp_extract(display_name, '^(.*?)\s*\((.*?)\)$', 2) AS common,
         '*' || regexp_extract(display_name, '^(.*?)\s*\((.*?)\)$', 1) || '*<br>('
         || regexp_extract(display_name, '^(.*?)\s*\((.*?)\)$', 2) || ')' AS label
  FROM names
), top_species AS (
  SELECT t.*, australian_common_name, display_name, sci, common, label
  FROM top_all t JOIN labels_by_taxon n ON {_same_taxon('t', 'n')}
), top_species_year AS (
  SELECT t.*, 'bioregion' AS "group", true AS by_status, australian_common_name, display_name, sci, common, label
  FROM top_region_year t JOIN labels_by_taxon n ON {_same_taxon('t', 'n')}
), overview AS (
  SELECT s.*, f.num_fish, l.num_lengths, l.biggest_fish FROM
  (SELECT count(*) AS num_bruvs, min(year) AS min_year, max(year) AS max_year, min(depth_m) AS min_depth,
          max(depth_m) AS max_depth, avg(depth_m) AS average_depth FROM ok) s,
  (SELECT CAST(sum(count) AS BIGINT) AS num_fish FROM counts) f,
  (SELECT CAST(sum(count) AS BIGINT) AS num_lengths, max(length_mm) AS biggest_fish FROM lengths) l
), region_figures AS (
  SELECT s.*, CAST(coalesce(f.num_fish, 0) AS BIGINT) AS num_fish, l.num_lengths, l.biggest_fish FROM
  (SELECT bioregion, count(*) AS num_bruvs, min(year) AS min_year, max(year) AS max_year, min(depth_m) AS min_depth,
          max(depth_m) AS max_depth, avg(depth_m) AS average_depth FROM ok GROUP BY 1) s
  LEFT JOIN (SELECT bioregion, sum(count) AS num_fish FROM counts JOIN dep USING (sample_url) GROUP BY 1) f
    USING (bioregion)
  LEFT JOIN (SELECT bioregion, CAST(sum(count) AS BIGINT) AS num_lengths, max(length_mm) AS biggest_fish
             FROM lengths JOIN dep USING (sample_url) GROUP BY 1) l USING (bioregion)
), park AS (SELECT * FROM dep WHERE location = '{LOCATION}'
), seen AS (
  SELECT c.sample_url, p.location, p.method, n.display_name, CAST(sum(c.count) AS BIGINT) AS count
  FROM counts c JOIN names n ON {_same_taxon('n', 'c')} JOIN park p ON c.sample_url = p.sample_url GROUP BY ALL
), park_species AS (
  SELECT location, method, display_name, CAST(sum(count) AS BIGINT) AS total_number FROM seen GROUP BY ALL
), ranking AS (
  SELECT display_name, CAST(sum(total_number) AS BIGINT) AS total_number FROM park_species GROUP BY 1
), picked AS (SELECT display_name FROM ranking ORDER BY total_number DESC, display_name LIMIT 3
), park_metrics AS (
  SELECT m.sample_url, m.metric, m.value, p.location, p.method, p.longitude_dd, p.latitude_dd
  FROM metrics m JOIN park p ON m.sample_url = p.sample_url
), park_lengths AS (
  SELECT n.display_name, l.length_mm, CASE WHEN l_returnflag = 'R' THEN 'UVC' ELSE 'stereo-BRUVs' END AS method,
         CASE WHEN l_linestatus = 'F' THEN 'Commonwealth' ELSE 'State' END AS jurisdiction, p.location, p.status
  FROM lines l JOIN fishes f ON {_same_taxon('f', 'l')} JOIN names n ON {_same_taxon('n', 'l')}
  JOIN park p ON l.sample_url = p.sample_url
)
"""

BASE = BASE_OF_REGION.replace("@region", "r_name")
# The same over two strips of longitude; the deployments beyond them are dropped.
_LONGITUDE = "(150 + (o_orderkey % 1000) / 100)"
STRIP_BASE = BASE_OF_REGION.replace("@region", f"""(CASE WHEN {_LONGITUDE} < {STRIPS['West'][1]} THEN 'West'
  WHEN {_LONGITUDE} < {STRIPS['East'][1]} THEN 'East' END)""")

PARK_LENGTHS = "SELECT * FROM park_lengths WHERE display_name IN (SELECT display_name FROM picked)"


OF_TOP_REGION = f"""WHERE EXISTS (SELECT 1 FROM top_region t
    WHERE t.bioregion IS NOT DISTINCT FROM grid.bioregion AND {_same_taxon('t', 'grid')})"""


def _abundance(keys, where=""):
    keys = f"{keys}, " if keys else ""
    return f"""SELECT {keys}{TAXON}, round(avg(count)@six) AS average_abundance,
        round(stddev_samp(count) / sqrt(count(*))@six) AS se, count(*) AS n FROM grid {where} GROUP BY ALL"""


def _histogram(source, value, width, by):
    """Centre-on-multiples bins, closed on the right, the lowest edge of the data excepted."""
    return f"""SELECT {by}, CASE WHEN x = lowest AND abs((i + 0.5) * {width} - x) <= {width} * 1e-8
            THEN i + 1 ELSE i END * {width}::DOUBLE AS bin, count(*) AS n
        FROM (SELECT *, {value} AS x, CAST(ceil(({value} - {width} / 2.0) / {width} - 1e-8) AS BIGINT) AS i,
                     min({value}) OVER () AS lowest FROM ({source}) WHERE {value} IS NOT NULL) GROUP BY ALL"""


def _mean_se(column, alias, region=REGION):
    return f"""SELECT *, round(m - s@six) AS lower, round(m + s@six) AS upper FROM (
        SELECT {column} AS {alias}, count(value) AS n, avg(value) AS m,
               CASE WHEN count(value) > 1 THEN stddev_samp(value) / sqrt(count(value)) ELSE 0 END AS s
        FROM metrics WHERE bioregion = '{region}' AND metric = '{METRIC}' GROUP BY ALL)"""


def _kpis(source, keep=""):
    def number(column):
        return f"regexp_replace(printf('%.6f', {column}), '\\.?0+$', '')"

    return f"""SELECT {keep} format('{{:,}}', num_bruvs) AS num_bruvs, format('{{:,}}', num_fish) AS num_fish,
        format('{{:,}}', num_lengths) AS num_lengths, min_year || ' - ' || max_year AS years_included,
        {number('min_depth')} || ' - ' || {number('max_depth')} || ' m' AS depths_surveyed,
        CAST(CAST(round_even(average_depth, 0) AS BIGINT) AS VARCHAR) || ' m' AS average_depth FROM {source}"""


def _figures(source, keep=""):
    return f"""SELECT {keep} num_bruvs, min_year, max_year, round(min_depth@six) AS min_depth,
        round(max_depth@six) AS max_depth, round(average_depth@six) AS average_depth, num_fish, num_lengths,
        round(biggest_fish@six) AS biggest_fish FROM {source}"""


DEPLOYMENT_COLUMNS = """sample_url, campaignid, sample, CAST(date_time AS VARCHAR) AS date_time,
    round(longitude_dd@six) AS longitude_dd, round(latitude_dd@six) AS latitude_dd, status, successful_count,
    successful_length, round(depth_m@six) AS depth_m, bioregion, year, CAST(date AS VARCHAR) AS date"""

ROUNDED = "round(average_abundance@six) AS average_abundance, round(se@six) AS se"
ENDS = f"""{ROUNDED}, round(average_abundance - se@six) AS lower, round(average_abundance + se@six) AS upper"""
TOP_COLUMNS = f"""bioregion, status, {TAXON}, {ROUNDED}, "group", by_status, australian_common_name,
    display_name, sci, common, label"""
BOUNDS = """round(min(longitude_dd)@six) AS min_lon, round(min(latitude_dd)@six) AS min_lat,
    round(max(longitude_dd)@six) AS max_lon, round(max(latitude_dd)@six) AS max_lat"""


def _tagged(source, keys, group, by_status):
    return f"SELECT {keys} {TAXON}, {ROUNDED}, '{group}' AS \"group\", {by_status} AS by_status FROM {source}"


def _timeseries(region):
    month = "TRY_CAST(start_month || '-01' AS DATE) AS start_month, status"
    return f"""SELECT CAST(start_month AS VARCHAR) AS start_month, status, n, round(m@six) AS mean,
        round(s@six) AS se, lower, upper FROM ({_mean_se(month, "status", region)})"""


def _metric_map(region):
    return f"""SELECT sample_url, round(longitude_dd@six) AS longitude_dd, round(latitude_dd@six) AS latitude_dd,
        round(value@six) AS value, status, round(round_even(value, 2)@six) AS shown_value,
        round(CASE WHEN low = high THEN 8 ELSE 4 + 10 * (value - low) / (high - low) END@six) AS radius
        FROM (SELECT m.sample_url, d.longitude_dd, d.latitude_dd, m.value, m.status,
                     min(m.value) OVER () AS low, max(m.value) OVER () AS high
              FROM metrics m JOIN dep d ON m.sample_url = d.sample_url
              WHERE m.bioregion = '{region}' AND m.metric = '{METRIC}' AND m.value IS NOT NULL)"""


def _top_view(by_status, region=REGION):
    return f""", base AS (SELECT * FROM top_species WHERE "group" = 'bioregion' AND bioregion = '{region}'),
    best AS (SELECT DISTINCT display_name FROM (SELECT * FROM base WHERE NOT by_status
             ORDER BY average_abundance DESC, {TAXON} LIMIT 10)),
    ordered AS (SELECT label, row_number() OVER (ORDER BY p) AS order_index FROM (
        SELECT label, min(p) AS p FROM (SELECT label, row_number() OVER (ORDER BY average_abundance, {TAXON}) AS p
        FROM base WHERE NOT by_status AND display_name IN (FROM best)) GROUP BY 1))
    SELECT {TAXON}, status, display_name, b.label, {ENDS}, order_index
    FROM base b LEFT JOIN ordered o ON b.label = o.label
    WHERE by_status = {by_status} AND display_name IN (FROM best)"""


def _year_view(year):
    return f""", base AS (SELECT * FROM top_species_year WHERE bioregion = '{REGION}' AND year = {year}),
    best AS (SELECT display_name FROM base GROUP BY 1
             ORDER BY round(sum(average_abundance), 12) DESC, display_name LIMIT 10),
    ordered AS (SELECT label, row_number() OVER (ORDER BY round(sum(average_abundance), 12), label) AS order_index
                FROM base WHERE display_name IN (FROM best) GROUP BY 1)
    SELECT year, status, {TAXON}, display_name, b.label, {ENDS}, order_index
    FROM base b LEFT JOIN ordered o ON b.label = o.label WHERE display_name IN (FROM best)"""


def _bubbles(source, value, columns):
    return f"""SELECT {columns}, {value} = 0 AS is_zero,
        round(CASE WHEN {value} = 0 THEN 5 ELSE 10 + {value} / largest * 50 END@six) AS radius
        FROM (SELECT *, max({value}) OVER () AS largest FROM ({source})) WHERE {value} >= 0"""


METRIC_BUBBLE_COLUMNS = """sample_url, metric, round(value@six) AS value, location, method,
    round(longitude_dd@six) AS longitude_dd, round(latitude_dd@six) AS latitude_dd"""


def _species_map(method):
    sites = f"SELECT sample_url, location, latitude_dd, longitude_dd FROM park WHERE method = '{method}'"
    rows = f"""SELECT coalesce(b.sample_url, s.sample_url) AS sample_url, coalesce(b.location, s.location) AS location,
        b.display_name, coalesce(b.count, 0) AS count, b.method, s.latitude_dd, s.longitude_dd
        FROM (SELECT * FROM seen WHERE method = '{method}' AND display_name IN (FROM picked)) b
        FULL JOIN ({sites}) s ON b.sample_url = s.sample_url AND b.location = s.location"""
    return _bubbles(rows, "count", """sample_url, location, display_name, count, method,
        round(latitude_dd@six) AS latitude_dd, round(longitude_dd@six) AS longitude_dd""")


def _bundle_sizes():
    video, diver = "method = 'stereo-BRUVs'", "method = 'UVC'"
    parts = {
        "deployment_locations": f"park WHERE {video}", "deployment_locations_diver": f"park WHERE {diver}",
        "metric_bubble_data": f"park_metrics WHERE {video}", "metric_bubble_data_diver": f"park_metrics WHERE {diver}",
        "bubble_data": f"seen WHERE {video}", "bubble_data_diver": f"seen WHERE {diver}",
        "length_with_jurisdiction": "park_lengths", "top_species_location": "park_species",
        "years_park": "(SELECT DISTINCT year, method FROM park)", "depth_combined": "park",
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n FROM {text}" for name, text in parts.items())


def _refresh_tables():
    """Row counts of the refresh: deployments in two strips of longitude, the rest dropped."""
    west, east = STRIPS["West"][1], STRIPS["East"][1]
    groups = "(SELECT count(*) FROM (SELECT DISTINCT {} FROM sampled)) * taxa"
    parts = {
        "deployments": "count(*) FROM placed", "bioregions": "2", "overview_stats": "1", "run_log": "1",
        "bioregion_stats": "count(DISTINCT place) FROM placed WHERE successful_count",
        "metrics": "count(*) FROM metrics WHERE sample_url IN (SELECT sample_url FROM placed)",
        "campaign_lookup": "count(*) FROM (SELECT DISTINCT campaignid, date FROM placed)",
        "campaigns_csv": "count(DISTINCT campaignid) FROM placed",
        "sample_taxa": f"""count(*) FROM (SELECT DISTINCT sample_url, {TAXON} FROM counts
            WHERE sample_url IN (SELECT sample_url FROM placed))""",
        "top_species": f"""taxa + {groups.format('place')} + {groups.format('status')}
            + {groups.format('place, status')} FROM listed""",
        "top_species_year": f"{groups.format('place, status, y')} FROM listed",
    }
    return f""", placed AS (
        SELECT *, CASE WHEN longitude_dd < {west} THEN 'West' ELSE 'East' END AS place FROM dep
        WHERE longitude_dd < {east}),
    sampled AS (SELECT *, CASE WHEN successful_count THEN year END AS y FROM placed
        WHERE successful_count OR sample_url IN (SELECT sample_url FROM counts)),
    listed AS (SELECT least(50, count(*)) AS taxa FROM (SELECT DISTINCT {TAXON} FROM counts
        WHERE sample_url IN (SELECT sample_url FROM placed)))
    """ + " UNION ALL ".join(f"SELECT '{name}' AS table_name, CAST(({'SELECT ' + text}) AS BIGINT) AS n" for name, text in parts.items())


HTML = r"""'<i>' || regexp_extract(display_name, '^(.*?)\s*\((.*?)\)$', 1) || '</i><span> ('
    || regexp_extract(display_name, '^(.*?)\s*\((.*?)\)$', 2) || ')</span>'"""

METRIC_COLUMNS = "campaignid, sample, sample_url, metric, round(value@six) AS value"

ORACLE = {
    "deployments_prepared": f"SELECT {DEPLOYMENT_COLUMNS} FROM dep",
    "count_samples": "SELECT sample_url, campaignid, sample FROM ok",
    "length_samples": "SELECT sample_url, campaignid, sample FROM dep WHERE successful_length",
    "taxon_recode": f"SELECT sample_url, {TAXON}, count FROM recoded",
    "fish_filter": f"SELECT sample_url, {TAXON}, count FROM counts",
    "fish_lengths": f"SELECT sample_url, {TAXON}, round(length_mm@six) AS length_mm, count FROM lengths",
    "region_counts": f"""SELECT sample_url, {TAXON}, count FROM lines WHERE sample_url IN
        (SELECT sample_url FROM dep WHERE bioregion IN ({', '.join(repr(r) for r in REGIONS)}))""",
    "metric_total_abundance": f"SELECT {METRIC_COLUMNS} FROM abundance_rows",
    "metric_species_richness": f"SELECT {METRIC_COLUMNS} FROM richness_rows",
    "metric_cti": f"SELECT {METRIC_COLUMNS} FROM cti_rows",
    "metric_cti_log": """SELECT d.campaignid, d.sample, v.sample_url, 'cti' AS metric, round(v.log_value@six) AS value
        FROM cti_values v LEFT JOIN dep d ON v.sample_url = d.sample_url WHERE v.log_value IS NOT NULL""",
    "metrics_long": f"""SELECT {METRIC_COLUMNS}, bioregion, status, CAST(date_time AS VARCHAR) AS date_time,
        CAST(date AS VARCHAR) AS date, event_number, CAST(start_date AS VARCHAR) AS start_date, new_campaignid,
        start_month FROM metrics""",
    "samples_missing_cti": f"""SELECT a.sample_url, a.campaignid, a.sample, a.metric, a.value, {TAXON}, c.count
        FROM (SELECT sample_url FROM dep d WHERE NOT EXISTS
              (SELECT 1 FROM cti_rows m WHERE m.sample_url = d.sample_url)) s
        JOIN abundance_rows a ON s.sample_url = a.sample_url AND a.value > 0
        LEFT JOIN counts c ON s.sample_url = c.sample_url""",
    "taxa_missing_cti": f"""SELECT DISTINCT {TAXON} FROM counts c WHERE EXISTS
        (SELECT 1 FROM abundance_rows a WHERE a.sample_url = c.sample_url AND a.value > 0)
        AND NOT EXISTS (SELECT 1 FROM cti_rows m WHERE m.sample_url = c.sample_url)""",
    "sampling_events": """SELECT campaignid, CAST(date AS VARCHAR) AS date, event_number,
        CAST(start_date AS VARCHAR) AS start_date, new_campaignid, start_month FROM calendar""",
    "sampling_events_session": """SELECT campaignid, event_number, CAST(start_date AS VARCHAR) AS start_date,
        CAST(max(date) AS VARCHAR) AS last_date, count(*) AS n_dates, new_campaignid, start_month
        FROM calendar GROUP BY ALL""",
    "events_per_region": """SELECT bioregion, count(DISTINCT new_campaignid) AS n
        FROM dep JOIN calendar USING (campaignid, date) GROUP BY 1""",
    "years_per_region": "SELECT bioregion, count(DISTINCT year) AS n FROM dep GROUP BY 1",
    "campaign_list": """SELECT row_number() OVER (ORDER BY campaignid) AS "row", campaignid
        FROM (SELECT DISTINCT campaignid FROM dep)""",
    "grid_size": f"""SELECT n_samples, n_taxa, n_samples * n_taxa AS n_rows FROM
        (SELECT count(*) AS n_samples FROM ok), (SELECT count(*) AS n_taxa FROM (SELECT DISTINCT {TAXON} FROM counts))""",
    "complete_counts": f"SELECT bioregion, status, {TAXON}, count, count(*) AS n_rows FROM grid GROUP BY ALL",
    "grid_rows": f"""SELECT sample_url, bioregion, status, {TAXON}, CAST(count AS BIGINT) AS count FROM grid
        WHERE bioregion = '{REGION}' AND (status = 'Fished' OR status IS NULL) AND family = 'SMALL'""",
    "abundance_overall": _abundance(""),
    "abundance_region": _abundance("bioregion"),
    "abundance_status": _abundance("status"),
    "abundance_region_status": _abundance("bioregion, status", OF_TOP_REGION),
    "abundance_region_status_year": _abundance("bioregion, status, year", OF_TOP_REGION),
    "top_species_overall": _tagged("top_overall", "", "overall", "false"),
    "top_species_region": _tagged("top_region", "bioregion,", "bioregion", "false"),
    "top_species_overall_status": _tagged("top_overall_status", "status,", "overall", "true"),
    "top_species_region_status": _tagged("top_region_status", "bioregion, status,", "bioregion", "true"),
    "top_species_year": f"SELECT {TOP_COLUMNS}, year FROM top_species_year",
    "top_species": f"SELECT {TOP_COLUMNS} FROM top_species",
    "top_species_check": """SELECT bioregion, by_status, count(*) AS n FROM top_species
        WHERE "group" = 'bioregion' GROUP BY ALL""",
    "species_labels": f"""SELECT {TAXON}, australian_common_name, display_name, sci, common, label
        FROM labels_by_taxon n WHERE EXISTS (SELECT 1 FROM counts c WHERE {_same_taxon('c', 'n')})""",
    "overview_stats": _figures("overview"),
    "region_stats": _figures("region_figures", "bioregion,"),
    "map_centre": """SELECT round(avg(longitude_dd)@six) AS lon,
        round((min(latitude_dd) + max(latitude_dd)) / 2@six) AS lat FROM dep""",
    "region_assign": f""", edges AS ({_edges()}),
        points AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
        SELECT vec_id, round(x@six) AS longitude_dd, round(y@six) AS latitude_dd, bioregion FROM (
          SELECT vec_id, x, y, bioregion,
                 sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (x2 - x1) * (y - y1) / nullif(y2 - y1, 0)
                     THEN 1 ELSE 0 END) % 2 = 1
                 OR bool_or((x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) AND x BETWEEN least(x1, x2) AND greatest(x1, x2)
                            AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS inside
          FROM points, edges GROUP BY ALL) WHERE inside""",
    "region_assign_sites": f"""SELECT sample_url, round(longitude_dd@six) AS longitude_dd,
        round(latitude_dd@six) AS latitude_dd, CASE WHEN longitude_dd < {STRIPS['West'][1]} THEN 'West' ELSE 'East' END AS bioregion
        FROM dep WHERE longitude_dd < {STRIPS['East'][1]}""",
    "region_assign_geodesic": _in_arcs(_edges(WIDE_RINGS)),
    "region_assign_datum": _in_arcs(_shifted(
        "(" + _shifted("(" + _edges(WIDE_RINGS) + ")", "bioregion, x2, y2", "x1", "y1") + ")", "bioregion, x1, y1", "x2", "y2")),
    "sites_shifted": f"""SELECT sample_url, round(longitude_dd@six) AS longitude_dd, round(latitude_dd@six) AS latitude_dd
        FROM ({_shifted("dep", "sample_url", "longitude_dd", "latitude_dd")})""",
    "overview_kpis": _kpis("overview"),
    "region_kpis": _kpis(f"region_figures WHERE bioregion = '{REGION}'", "bioregion,"),
    "region_choices": "SELECT DISTINCT bioregion FROM ok ORDER BY 1",
    "year_choices": f"SELECT DISTINCT year FROM top_species_year WHERE bioregion = '{REGION}' AND year IS NOT NULL",
    "region_deployments": f"SELECT {DEPLOYMENT_COLUMNS}, 'BRUVs' AS method FROM dep WHERE bioregion = '{REGION}'",
    "all_deployments": f"SELECT {DEPLOYMENT_COLUMNS}, 'BRUVs' AS method FROM dep",
    "region_bounds": f"SELECT {BOUNDS} FROM dep WHERE bioregion = '{REGION}'",
    "top_species_view": _top_view("false"),
    "top_species_view_status": _top_view("true"),
    "top_species_in_year": _year_view("'1997'"),
    "top_species_last_year": _year_view(f"(SELECT max(year) FROM top_species_year WHERE bioregion = '{REGION}')"),
    "metric_timeseries": _timeseries(REGION),
    "metric_mean_se": f"SELECT grp, n, round(m@six) AS mean, round(s@six) AS se, lower, upper FROM ({_mean_se('status', 'grp')})",
    "metric_map": _metric_map(REGION),
    "metric_map_bounds": f"""SELECT {BOUNDS} FROM dep WHERE sample_url IN
        (SELECT sample_url FROM metrics WHERE bioregion = '{REGION}' AND metric = '{METRIC}' AND value IS NOT NULL)""",
    "metric_labels": """SELECT DISTINCT metric, CASE metric WHEN 'total_abundance' THEN 'Average no. individuals'
        WHEN 'species_richness' THEN 'Average no. species'
        WHEN 'cti' THEN 'Community temperature index (°C)' ELSE metric END AS label FROM metrics""",
    "metric_slug": "SELECT DISTINCT bioregion, replace(lower(bioregion), ' ', '_') AS slug FROM dep",
    "refresh_tables": _refresh_tables(),
    "location_bundle": _bundle_sizes(),
    "location_bubbles": "SELECT sample_url, location, method, display_name, count FROM seen WHERE method = 'stereo-BRUVs'",
    "location_metric_bubbles": f"SELECT {METRIC_BUBBLE_COLUMNS} FROM park_metrics WHERE method = 'stereo-BRUVs'",
    "location_lengths": """SELECT display_name, round(length_mm@six) AS length_mm, method, jurisdiction, location, status
        FROM park_lengths""",
    "species_pages": """SELECT DISTINCT 'pages/' || family || '/' || genus AS url FROM names
        WHERE display_name IN (SELECT display_name FROM picked)""",
    "location_deployments": """SELECT sample_url, location, method, round(longitude_dd@six) AS longitude_dd,
        round(latitude_dd@six) AS latitude_dd FROM park""",
    "location_bounds": f"SELECT {BOUNDS} FROM park",
    "species_ranking": "SELECT display_name, total_number FROM ranking",
    "effort_by_year": """, counted AS (SELECT CAST(year AS BIGINT) AS year, method, count(*) AS n FROM park GROUP BY ALL)
        SELECT y AS year, method, coalesce(n, 0) AS n FROM (
          SELECT unnest(range(min(year), max(year) + 1)) AS y FROM counted) LEFT JOIN counted ON y = year""",
    "depth_hist": _histogram("SELECT * FROM park", "depth_m", 5, "method"),
    "length_hist": _histogram(PARK_LENGTHS, "length_mm", 50, "status, jurisdiction, method"),
    "length_density": f"""SELECT *, round(n / sum(n) OVER (PARTITION BY status, jurisdiction, method) / 50@six) AS density
        FROM ({_histogram(PARK_LENGTHS, "length_mm", 50, "status, jurisdiction, method")})""",
    "species_by_method": rf"""SELECT method, display_name, regexp_extract(display_name, '^(.*?)\s*\((.*?)\)$', 1) AS sci,
        regexp_extract(display_name, '^(.*?)\s*\((.*?)\)$', 2) AS common, {HTML} AS label, total_number,
        row_number() OVER (PARTITION BY method ORDER BY total_number, {HTML}) AS order_index FROM park_species""",
    "bubble_map": _bubbles(
        "SELECT * FROM park_metrics WHERE method = 'stereo-BRUVs' AND metric = 'total_abundance'",
        "value", METRIC_BUBBLE_COLUMNS),
    "bubble_map_diver": _bubbles(
        "SELECT * FROM park_metrics WHERE method = 'UVC' AND metric = 'species_richness'",
        "value", METRIC_BUBBLE_COLUMNS),
    "species_map": _species_map("stereo-BRUVs"),
    "species_map_diver": _species_map("UVC"),
}


ORACLE["region_assign_geojson"] = ORACLE["region_assign"]
ORACLE["region_assign_shapefile"] = ORACLE["region_assign_geodesic"]

# Tables of the refresh and views on them, over the strips.
SERVED = {
    "refresh_deployments": ORACLE["all_deployments"].replace(", 'BRUVs' AS method", ""),
    "refresh_metrics": ORACLE["metrics_long"].replace(
        "FROM metrics", """, (SELECT round(longitude_dd@six) FROM dep d WHERE d.sample_url = metrics.sample_url) AS longitude_dd,
        (SELECT round(latitude_dd@six) FROM dep d WHERE d.sample_url = metrics.sample_url) AS latitude_dd FROM metrics"""),
    "refresh_top_species": ORACLE["top_species"],
    "refresh_top_species_year": ORACLE["top_species_year"],
    "refresh_overview_stats": ORACLE["overview_stats"],
    "refresh_region_stats": ORACLE["region_stats"],
    "refresh_campaign_lookup": ORACLE["sampling_events"],
    "served_metric_timeseries": _timeseries(STRIP),
    "served_metric_map": _metric_map(STRIP),
    "served_top_species_view": _top_view("false", STRIP),
    "served_metrics_long": ORACLE["metrics_long"],
    "served_sample_page": "SELECT sample_url, campaignid, bioregion, status, CAST(date AS VARCHAR) AS date, round(depth_m@six) AS depth_m, "
    + ", ".join(
        f"(SELECT round(m.value@six) FROM metrics m WHERE m.sample_url = dep.sample_url AND m.metric = '{name}') AS {name}"
        for name in ("total_abundance", "species_richness", "cti"))
    + " FROM dep WHERE bioregion IS NOT NULL AND sample_url IN (" + ", ".join(f"'{name}'" for name in SAMPLES) + ")",
}


def oracle_sql():
    # @six rounds to six decimals, shifted off ties as in the registry.
    texts = {**{name: BASE + text for name, text in ORACLE.items()}, **{name: STRIP_BASE + text for name, text in SERVED.items()}}
    return {name: text.replace("@six", f" + {OFF_TIE}, 6") for name, text in texts.items()}
