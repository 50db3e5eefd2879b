"""The queries' SQL for DuckDB, written by itself from the rules (only the views are shared)."""

from __future__ import annotations

import re

from ..sources import generator
from . import views
from .queries import MAKE, NOW, YEAR

_L = "ABCDEFGHJKLMNPRSTUVWXYZ"
_D = "12345678123457923456789"
SPACES = r"[\s\v\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _view(text: str, **names: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: names.get(m[1], m[1]), text)


def _digit(v: str) -> str:
    total = " + ".join(f"CAST(substr(translate(upper({v}), '{_L}', '{_D}'), {i + 1}, 1) AS INT) * {w}" for i, w in enumerate([8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]) if w)
    return f"CASE WHEN regexp_full_match(upper({v}), '[A-HJ-NPR-Z0-9]{{17}}') THEN substr('0123456789X', ({total}) % 11 + 1, 1) END"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def _number(c: str) -> str:
    t = _trim(c)
    return f"CASE WHEN {t} = '' THEN 0.0 WHEN regexp_full_match({t}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST({t} AS DOUBLE) END"


def _clean(c: str) -> str:
    return f"nullif({_trim(c)}, '')"


def _form(c: str) -> str:
    navi = f"regexp_replace(upper({c}), ' NAVI$', '')"
    return f"regexp_replace(regexp_replace({navi}, ' AWD$', ''), '[^A-Z0-9]', '', 'g')"


def _rounded(c: str) -> str:
    """Mean of whole non-negative numbers, halves up, by whole numbers."""
    return f"CAST((2 * sum({c}) + count({c})) // (2 * nullif(count({c}), 0)) AS BIGINT)"


_KNOWN = {(m, mo): t for m, mo, t in generator.trims()}
_TRIMS = ", ".join(f"('{m}', '{mo}', {i}, '{t}')" for (m, mo), ts in _KNOWN.items() for i, t in enumerate(ts))

RAW = f"raw AS ({_view(views.RAW)})"
CHECKED = f"""{RAW}, checked AS (
    SELECT *, CASE WHEN t = '' THEN 'vin_missing' WHEN length(t) <> 17 THEN 'vin_wrong_length' WHEN coalesce(digit <> substr(upper(t), 9, 1), true) THEN 'vin_bad_check_digit' END AS r1,
           CASE WHEN year IS NULL OR year = '' THEN 'year_missing' WHEN yn IS NULL OR yn < 1980 OR yn > {YEAR + 1} THEN 'year_out_of_range' END AS r2
    FROM (SELECT *, {_digit("t")} AS digit FROM (SELECT *, {_trim("vin")} AS t, {_number("year")} AS yn FROM raw) a) b
)"""
REASONS = "concat_ws(',', r1, r2)"
NORMAL = f"""{CHECKED}, dict AS (
    SELECT make, model, {_form("known")} AS form, arg_min(known, place) AS known FROM (VALUES {_TRIMS}) d(make, model, place, known) GROUP BY ALL
), n0 AS (
    SELECT ord, source, batch_id, upper(t) AS vin, yn AS raw_year, {_clean("make")} AS make, {_clean("model")} AS model, {_clean("trim")} AS trim0, body_style, fuel_type, exterior_color, listed_at, status, stock_number,
           {_number("odometer")} AS km0, odometer,
           CASE WHEN price_kind = 'number' THEN CAST(price AS BIGINT) * 100 WHEN {_trim("price")} = '' THEN NULL
                ELSE CAST(floor(100 * ({_number("regexp_replace(price, '[$, ]', '', 'g')")}) + 0.5) AS BIGINT) END AS price_cents
    FROM checked WHERE r1 IS NULL AND r2 IS NULL
), n1 AS (
    SELECT *, CASE WHEN odometer <> '' AND km0 >= 0 THEN km0 END AS km1 FROM n0
), normal AS (
    SELECT n1.* EXCLUDE (km0, km1, odometer, trim0), CAST(floor(CASE WHEN miles THEN km1 * 1.60934 ELSE km1 END + 0.5) AS BIGINT) AS odometer_km, coalesce(miles, false) AS miles,
           coalesce(d.known, trim0) AS trim, d.known IS NOT NULL AS matched
    FROM (SELECT *, coalesce(source = 'marketplace-b' AND km1 / greatest(1.0, {YEAR} - raw_year) < 11000, false) AS miles FROM n1) n1
    LEFT JOIN dict d ON n1.make = d.make AND n1.model = d.model AND {_form("trim0")} = d.form
)"""
_SCORE = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in ("make", "model", "trim", "body_style", "fuel_type", "exterior_color", "price_cents", "odometer_km"))
_BEST = ", ".join(f"arg_min({c}, rn) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("make", "model", "trim", "body_style", "fuel_type", "exterior_color"))
SURVIVORS = f"""{NORMAL}, survivors AS (
    SELECT vin, {_BEST}, arg_min(raw_year, ord) AS first_year, count(DISTINCT raw_year) AS n_years, min(ord) AS first_ordinal
    FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY {_SCORE} DESC, coalesce(listed_at, '') DESC, ord) AS rn FROM normal) r GROUP BY vin
), cache AS ({_view(views.CACHE, vins="normal")})"""
VEHICLES = f"""{SURVIVORS}, vehicles AS (
    SELECT s.vin, coalesce(CASE WHEN ok THEN nullif(trim(d.make), '') END, s.make) AS make, coalesce(CASE WHEN ok THEN nullif(trim(d.model), '') END, s.model) AS model,
           coalesce(CASE WHEN ok THEN d.year END, s.first_year) AS model_year, coalesce(CASE WHEN ok THEN coalesce(nullif(trim(d.trim), ''), nullif(trim(d.series), '')) END, s.trim) AS trim,
           coalesce(CASE WHEN ok THEN d.body_style END, s.body_style) AS body_style, s.fuel_type, CASE WHEN ok THEN d.drive_type END AS drive_train, CASE WHEN ok THEN d.transmission END AS transmission,
           CASE WHEN ok THEN 'decoded' ELSE 'undecoded' END AS decode_source, CASE WHEN ok THEN d.year END AS decoded_year,
           CASE WHEN ok AND trim(d.make) <> '' AND trim(d.model) <> '' AND s.make <> '' AND s.model <> '' THEN lower(trim(d.make)) = lower(s.make) AND lower(trim(d.model)) = lower(s.model) END AS agrees, s.first_ordinal
    FROM (SELECT s.*, coalesce(d.valid, false) AS ok FROM survivors s LEFT JOIN cache d ON substr(s.vin, 1, 11) = d.wmi_vds_prefix) s LEFT JOIN cache d ON substr(s.vin, 1, 11) = d.wmi_vds_prefix
), listings AS (
    SELECT n.*, v.make AS vehicle_make, v.model AS vehicle_model, v.model_year AS vehicle_year, coalesce(v.decoded_year <> n.raw_year, false) AS year_conflict, v.first_ordinal FROM normal n JOIN vehicles v ON n.vin = v.vin
), staged AS (
    SELECT * FROM (
        SELECT *, coalesce(stock_number, source || '-' || vin) AS source_listing_id, coalesce(status, 'active') AS status1,
               row_number() OVER (PARTITION BY source, coalesce(stock_number, source || '-' || vin) ORDER BY first_ordinal DESC, ord DESC) AS rn FROM listings
    ) x WHERE rn = 1
)"""
LISTING = f"listing AS ({_view(views.LISTING)})"
STATS = "status = 'active' AND price_cents IS NOT NULL AND make IS NOT NULL"
HISTORY = f"history AS ({_view(views.HISTORY)})"
DROPS = f"""{HISTORY}, c AS (
    SELECT *, lag(price_cents) OVER w AS prev, lag(observed_at) OVER w AS prev_at FROM history WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at)
), drops AS (SELECT * FROM c WHERE price_cents < prev)"""
OLD = f"old AS ({_view(views.OLD_LISTINGS)})"
OLDV = f"oldv AS ({_view(views.OLD_VEHICLES, vins='normal')})"


#: The raw view as it is read from landed files: empty texts for source B's nulls, A's rows before B's.
LAKE = RAW.replace("raw AS (", "raw0 AS (", 1) + f""", raw AS (
    SELECT * REPLACE (ord + CASE source WHEN 'dealer-feed-a' THEN 0 ELSE 1000000000000 END AS ord, {", ".join(f"CASE source WHEN 'marketplace-b' THEN coalesce({c}, '') ELSE {c} END AS {c}" for c in ("stock_number", "model", "trim", "body_style", "fuel_type", "exterior_color", "listed_at", "status"))},
        'bronze/source=' || source || CASE source WHEN 'dealer-feed-a' THEN '/date=2026-01-01/batch-' || lpad(CAST(ord // 4000 AS VARCHAR), 4, '0') || '.ndjson.gz' ELSE '/date=2026-01-02/batch-' || lpad(CAST(ord // 4000 AS VARCHAR), 4, '0') || '.csv.gz' END AS batch_id)
    FROM raw0
)"""


#: What the default decoder knows of the view's prefixes: one seed has their first five characters.
SEED_CACHE = """SELECT wmi_vds_prefix, valid, CASE WHEN valid THEN 'Honda' END AS make, CASE WHEN valid THEN 'Accord' END AS model, CASE WHEN valid THEN y + CASE WHEN y < 8 THEN 2030 ELSE 2000 END END AS year, CAST(NULL AS VARCHAR) AS trim, CAST(NULL AS VARCHAR) AS series,
    CASE WHEN valid THEN 'sedan' END AS body_style, CASE WHEN valid THEN 'gasoline' END AS fuel_type, CAST(NULL AS VARCHAR) AS drive_type, CAST(NULL AS VARCHAR) AS transmission
    FROM (SELECT DISTINCT substr(vin, 1, 11) AS wmi_vds_prefix, substr(vin, 4, 5) = 'CM826' AS valid, CAST(substr(vin, 10, 1) AS INT) AS y FROM normal) q"""


def _in_lake(text: str) -> str:
    """A chain of steps over the landed view; plain fields are trimmed there, and empty ones null."""
    assert text.startswith(RAW)
    plain = ", ".join(f"nullif({c}, '') AS {c}" for c in ("body_style", "fuel_type", "exterior_color", "listed_at", "status"))
    text = text.replace(_view(views.CACHE, vins="normal"), SEED_CACHE)
    return LAKE + text[len(RAW) :].replace("body_style, fuel_type, exterior_color, listed_at, status, stock_number,", f"{plain}, stock_number,", 1)


def _pct(places: int) -> str:
    """100 * drop / prev with so many places, halves away from zero, as a whole number of units of the last place; 0 is guarded."""
    f = 10 ** (2 + places)
    return f"CAST(sign(prev - price_cents) * sign(prev) * ((2 * abs(prev - price_cents) * {f} + abs(prev)) // (2 * nullif(abs(prev), 0))) AS BIGINT)"


ORACLES: dict[str, str] = {
    "market_stats": f"WITH {LISTING} SELECT make, model, model_year, province, count(*) AS listing_count, {_rounded('price_cents')} AS avg_price_cents, CAST(2 * quantile_cont(price_cents, 0.5) AS BIGINT) AS median_price_cents_x2, {_rounded('odometer_km')} AS avg_odometer_km FROM listing WHERE {STATS} GROUP BY ALL",
    "browse_topk": f"WITH {LISTING} SELECT id, vin, price_cents, odometer_km, city FROM listing WHERE make = '{MAKE}' AND model = 'LARGE' AND model_year BETWEEN 1993 AND 1997 AND province = 'NATION_3' AND status = 'active' ORDER BY price_cents ASC NULLS LAST, id LIMIT 50",
    "browse_wide": f"WITH {LISTING} SELECT id, vin, price_cents, odometer_km, city FROM listing WHERE model_year BETWEEN 1993 AND 1997 AND province = 'NATION_3' AND status = 'active' ORDER BY price_cents ASC NULLS LAST, id LIMIT 50",
    "make_stats_topk": f"WITH {LISTING} SELECT make, model, model_year, province, count(*) AS n, {_rounded('price_cents')} AS avg_price_cents, CAST(round_even(quantile_cont(price_cents, 0.5), 0) AS BIGINT) AS median_price_cents FROM listing WHERE {STATS} AND make = '{MAKE}' GROUP BY ALL ORDER BY n DESC, make, model, model_year, province LIMIT 20",
    "vin_history": f"WITH {HISTORY}, owner AS ({_view(views.OWNER)}) SELECT o.source, o.price_cents, o.status, h.price_cents AS history_price, h.observed_at FROM owner o LEFT JOIN history h ON h.listing_id = o.id WHERE o.vin = (SELECT min(vin) FROM owner WHERE status = 'active')",
    "recent_topk": f"WITH {LISTING} SELECT id, vin, make, model, price_cents, listed_at FROM listing WHERE status = 'active' AND province = 'NATION_7' ORDER BY listed_at DESC NULLS FIRST, id LIMIT 50",
    "price_drops": f"WITH {DROPS} SELECT listing_id, vin, prev AS previous_price_cents, price_cents AS current_price_cents, prev - price_cents AS price_drop_cents, {_pct(2)} AS price_drop_pct, prev_at AS previous_observed_at, observed_at AS current_observed_at FROM drops",
    "price_drops_top20": f"WITH {DROPS} SELECT vin, prev AS prev_price, price_cents, {_pct(1)} AS pct_drop FROM drops ORDER BY pct_drop DESC NULLS FIRST, vin, listing_id, observed_at LIMIT 20",
    "latest_price": f"WITH {HISTORY} SELECT listing_id, price_cents AS latest_cents FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC) AS rn FROM history) h WHERE rn = 1",
    "price_changes": f"WITH {VEHICLES}, {OLD} SELECT s.vin, o.id AS listing_id, s.price_cents, TIMESTAMP '{NOW}' AS observed_at FROM staged s JOIN old o ON s.source = o.source AND s.source_listing_id = o.source_listing_id WHERE s.price_cents IS NOT NULL AND (CASE WHEN o.status <> 'removed' THEN o.price_cents END) IS DISTINCT FROM s.price_cents",
    "check_digit": f"WITH {RAW} SELECT ord AS ordinal, digit, coalesce(digit = substr(upper(trim(vin)), 9, 1), false) AS is_valid FROM (SELECT *, {_digit('trim(vin)')} AS digit FROM raw) x",
    "build_vin": f"""SELECT o_orderkey, code, substr(v, 1, 8) || {_digit('v')} || substr(v, 10, 8) AS vin FROM (
        SELECT *, '1VWBH7A30' || code || 'C' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS v FROM (SELECT o_orderkey, substr('ABCDEFGHJKLMNPRSTVWXY123456789', CAST(o_custkey % 55 % 30 AS INT) + 1, 1) AS code FROM orders) a) b""",
    "validate_split": f"WITH {CHECKED} SELECT ord AS ordinal, source, {REASONS} AS reasons, CASE WHEN r1 IS NULL AND r2 IS NULL THEN upper(t) END AS vin FROM checked",
    "reason_counts": f"WITH {CHECKED}, q AS (SELECT DISTINCT source, batch_id, {_view(views.RECORD)} AS rec, r1, r2 FROM checked WHERE r1 IS NOT NULL OR r2 IS NOT NULL) SELECT reason, source, count(*) AS n FROM (SELECT source, unnest([r1, r2]) AS reason FROM q) u WHERE reason IS NOT NULL GROUP BY ALL",
    "quarantine_hash": f"WITH {CHECKED} SELECT DISTINCT source, batch_id, md5({views.RECORD} || '|' || {REASONS}) AS content_hash, {REASONS} AS reasons FROM checked WHERE (r1 IS NOT NULL OR r2 IS NOT NULL) AND batch_id NOT IN ('batch-0', 'batch-1', 'batch-2')",
    "quarantine_age": f"SELECT event_type AS source, CAST(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 86400) AS BIGINT) AS days, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY ALL",
    "rejection_rate": f"WITH {CHECKED} SELECT source, batch_id, count(*) AS rows_in, count(*) FILTER (WHERE {REASONS} <> '') AS rejects, CAST(round(1000000.0 * count(*) FILTER (WHERE {REASONS} <> '') / count(*)) AS BIGINT) AS rejection_rate FROM checked GROUP BY ALL",
    "parse_price": f"""WITH {RAW} SELECT ord AS ordinal, CASE WHEN price_kind = 'number' THEN CAST(price AS BIGINT) * 100 WHEN price <> '' THEN CAST(floor(100 * ({_number("regexp_replace(price, '[$, ]', '', 'g')")}) + 0.5) AS BIGINT) END AS cents, price_kind <> 'number' AND price <> '' AS malformed FROM raw""",
    "odometer_units": f"WITH {NORMAL} SELECT ord AS ordinal, odometer_km, miles AS odometer_was_converted_from_miles FROM normal",
    "trim_canonical": f"WITH {NORMAL} SELECT ord AS ordinal, make, model, trim, matched AS trim_matched FROM normal",
    "normalized": f"WITH {NORMAL} SELECT ord AS ordinal, vin, make, model, CAST(raw_year * 10 AS BIGINT) AS year_x10, body_style, fuel_type, exterior_color, listed_at, status, stock_number FROM normal",
    "french_names": """SELECT CAST(o_orderkey AS VARCHAR) AS "stockNumber", o_orderstatus AS status FROM orders""",
    "spellings": """WITH p AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS d, 'EX-' || o_orderstatus AS t FROM orders)
        SELECT o_orderkey, '$' || format('{:,}', d) AS dollars, replace(format('{:,}', d), ',', ' ') || ' $' AS quebec, replace(t, '-', '') AS v1, replace(t, '-', ' ') AS v2, upper(t) AS v3, lower(t) AS v4, t || ' Navi' AS v5, t || ' AWD' AS v6,
               CAST(floor(d * 0.621371::DOUBLE + 0.5) AS BIGINT) AS miles, replace(t, '-', '') AS form FROM p""",
    "survivors": f"WITH {SURVIVORS} SELECT vin, make, model, trim, body_style, fuel_type, exterior_color, CAST(first_year * 10 AS BIGINT) AS first_year_x10, n_years, n_years > 1 AS year_conflict, first_ordinal FROM survivors",
    "completeness_score": f"WITH {NORMAL} SELECT ord AS ordinal, {_SCORE} AS score FROM normal",
    "decode_misses": f"WITH {SURVIVORS} SELECT substr(vin, 1, 11) AS prefix, arg_min(vin, first_ordinal) AS vin FROM survivors WHERE substr(vin, 1, 11) NOT IN (SELECT wmi_vds_prefix FROM cache) GROUP BY 1",
    "enrich_vehicles": f"WITH {VEHICLES} SELECT * EXCLUDE (model_year, first_ordinal), CAST(model_year * 10 AS BIGINT) AS model_year FROM vehicles",
    "enrich_listings": f"WITH {VEHICLES} SELECT ord AS ordinal, vehicle_make, vehicle_model, year_conflict FROM listings",
    "enrich_metrics": f"WITH {VEHICLES} SELECT count(*) AS unique_vins, count(DISTINCT substr(vin, 1, 11)) AS unique_prefixes, count(*) FILTER (WHERE decode_source = 'decoded') AS decode_success, count(agrees) AS agreement_checked, count(*) FILTER (WHERE agrees) AS agreement, (SELECT count(*) FILTER (WHERE year_conflict) FROM listings) AS year_conflict_listings FROM vehicles",
    "listing_keys": f"WITH {VEHICLES} SELECT source, source_listing_id, vin, price_cents, batch_id, status1 AS status FROM staged",
    "upsert_listings": f"""WITH {VEHICLES}, {OLD} SELECT coalesce(s.source, o.source) AS source, coalesce(s.source_listing_id, o.source_listing_id) AS source_listing_id, coalesce(o.vin, s.vin) AS vin, coalesce(s.batch_id, o.batch_id) AS batch_id,
        CASE WHEN s.source IS NOT NULL THEN s.price_cents ELSE o.price_cents END AS price_cents, CAST(coalesce(s.odometer_km, o.odometer_km) AS INT) AS odometer_km, coalesce(s.trim, o.trim_raw) AS trim_raw, o.province, coalesce(s.status1, o.status) AS status, coalesce(s.year_conflict, o.year_conflict) AS year_conflict,
        coalesce(s.vehicle_make, o.make) AS make, coalesce(s.vehicle_model, o.model) AS model, CAST(coalesce(trunc(s.vehicle_year), o.model_year) AS INT) AS model_year, coalesce(s.status1 = 'removed' AND o.status <> 'removed', false) AS delisted, s.source IS NOT NULL AS touched
        FROM staged s FULL JOIN old o ON s.source = o.source AND s.source_listing_id = o.source_listing_id""",
    "upsert_vehicles": f"""WITH {VEHICLES}, {OLDV} SELECT coalesce(n.vin, o.vin) AS vin, coalesce(o.wmi, substr(n.vin, 1, 3)) AS wmi, coalesce(n.make, o.make) AS make, coalesce(n.model, o.model) AS model, CAST(coalesce(trunc(n.model_year), o.model_year) AS INT) AS model_year, coalesce(n.trim, o.trim) AS trim,
        coalesce(n.body_style, o.body_style) AS body_style, coalesce(n.fuel_type, o.fuel_type) AS fuel_type, coalesce(n.drive_train, o.drive_train) AS drive_train, coalesce(n.transmission, o.transmission) AS transmission,
        CASE WHEN o.vin IS NULL OR n.decode_source = 'decoded' THEN n.decode_source ELSE o.decode_source END AS decode_source, o.vin IS NULL AS is_new, n.vin IS NOT NULL AS seen FROM vehicles n FULL JOIN oldv o ON n.vin = o.vin""",
    "backfill": f"WITH {OLD}, own AS ({_view(views.OWN_VEHICLES)}) SELECT o.id, coalesce(o.make, w.make) AS make, CASE WHEN o.make IS NULL AND w.vin IS NOT NULL THEN 'X' ELSE o.model END AS model, CASE WHEN o.make IS NULL AND w.vin IS NOT NULL THEN 2010 ELSE o.model_year END AS model_year FROM old o LEFT JOIN own w ON o.vin = w.vin",
    "dup_conflict": f"""WITH {NORMAL}, s AS (SELECT vin, source, count(*) AS n FROM normal GROUP BY ALL), v AS (SELECT vin, max(n) AS most, count(*) AS k FROM s GROUP BY vin), y AS (SELECT vin, count(DISTINCT raw_year) > 1 AS c FROM normal GROUP BY vin)
        SELECT count(*) AS unique_vins, count(*) FILTER (WHERE most > 1) AS within_source_duplicate, count(*) FILTER (WHERE k > 1) AS cross_source_duplicate, count(*) FILTER (WHERE c) AS year_conflict, CAST(round(1000000.0 * count(*) FILTER (WHERE c) / count(*)) AS BIGINT) AS year_conflict_rate_ppm,
        CAST(round(1000000.0 * count(*) FILTER (WHERE most > 1) / count(*)) AS BIGINT) AS within_source_duplicate_rate_ppm, CAST(round(1000000.0 * count(*) FILTER (WHERE k > 1) / count(*)) AS BIGINT) AS cross_source_duplicate_rate_ppm FROM v JOIN y USING (vin)""",
    "price_outliers": f"WITH {LISTING}, g AS (SELECT make, model, count(*) AS n, avg(price_cents) AS m, stddev_pop(price_cents) AS d FROM listing WHERE price_cents IS NOT NULL GROUP BY ALL) SELECT count(*) FILTER (WHERE abs(price_cents - m) / d > 1.75) AS outliers, count(*) AS scored FROM listing JOIN g USING (make, model) WHERE price_cents IS NOT NULL AND n >= 5 AND d > 0",
    "completeness": f"""WITH {NORMAL}, c AS (SELECT source, count(*) AS rows_in, count(*) FILTER (WHERE {REASONS} = '') AS valid, count(*) FILTER (WHERE {REASONS} <> '') AS quarantined FROM checked GROUP BY source),
        k AS (SELECT source, count(price_cents) AS priced, count(odometer_km) AS with_odometer, count(trim) AS with_trim, count(*) FILTER (WHERE matched) AS known_trim FROM normal GROUP BY source)
        SELECT c.*, priced, with_odometer, with_trim, known_trim, CAST(round(1000000.0 * known_trim / with_trim) AS BIGINT) AS trim_coverage_ppm FROM c JOIN k USING (source)""",
    "stage_rollup": f"WITH runs AS ({_view(views.RUNS)}) SELECT stage, source, CAST(sum(rows_in) AS BIGINT) AS rows_in, CAST(sum(rows_out) AS BIGINT) AS rows_out, CAST(sum(rejects) AS BIGINT) AS rejects, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(*) AS batches FROM runs WHERE run_id = 'run-1' GROUP BY ALL",
    "latest_run": f"WITH runs AS ({_view(views.RUNS)}) SELECT run_id FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1",
    "run_metrics": f"WITH runs AS ({_view(views.RUNS)}), metrics AS ({_view(views.METRICS)}) SELECT m.source, metric_name, metric_value FROM metrics m JOIN runs r ON r.id = m.run_id WHERE r.run_id = 'run-1'",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in views.TABLES),
    "both_sources": f"WITH {RAW} SELECT source, batch_id, count(*) AS n FROM raw GROUP BY ALL",
    "manifest_rollup": f"WITH {LAKE} SELECT source, count(*) AS total_rows, count(DISTINCT batch_id) AS total_objects, CAST(1 AS BIGINT) AS dates FROM raw GROUP BY source",
    "cached_prefixes": f"WITH {SURVIVORS} SELECT wmi_vds_prefix, valid, year FROM cache WHERE wmi_vds_prefix IN (SELECT substr(vin, 1, 11) FROM survivors WHERE trim IS NOT NULL)",
    "landed_batches": f"WITH {LAKE}, b AS (SELECT source, batch_id AS key, count(*) AS n FROM raw GROUP BY ALL) SELECT source, CASE source WHEN 'dealer-feed-a' THEN '2026-01-01' ELSE '2026-01-02' END AS date, key, n, CAST(sum(n) OVER w AS BIGINT) AS total_rows, count(*) OVER w AS total_objects, true AS compressed FROM b WINDOW w AS (PARTITION BY source)",
    "bronze_read": f"""WITH {LAKE} SELECT source, batch_id, vin AS vin_text, 'string' AS vin_kind, price AS price_text, price_kind, stock_number AS stocknumber_text, CASE WHEN stock_number IS NULL THEN 'missing' ELSE 'string' END AS stocknumber_kind,
        trim AS trim_text, CASE WHEN trim IS NULL THEN 'missing' ELSE 'string' END AS trim_kind, CAST(NULL AS VARCHAR) AS interiorcolor_text, 'missing' AS interiorcolor_kind FROM raw""",
    "bronze_read_date": f"WITH {LAKE} SELECT source, batch_id, count(*) AS n FROM raw WHERE source = 'marketplace-b' GROUP BY ALL",
    "lake_run": f"""WITH {_in_lake(VEHICLES)}, per AS (SELECT source, batch_id, count(*) AS n, count(*) FILTER (WHERE {REASONS} = '') AS good, count(*) FILTER (WHERE {REASONS} <> '') AS bad FROM checked GROUP BY ALL),
        s AS (SELECT vin, source, count(*) AS n FROM normal GROUP BY ALL), v AS (SELECT vin, max(n) AS most, count(*) AS k FROM s GROUP BY vin), y AS (SELECT vin, count(DISTINCT raw_year) > 1 AS c FROM normal GROUP BY vin),
        d AS (SELECT count(*) AS u, count(*) FILTER (WHERE most > 1) AS w, count(*) FILTER (WHERE k > 1) AS x, count(*) FILTER (WHERE c) AS y, (SELECT count(*) FROM normal) AS n FROM v JOIN y USING (vin)),
        p AS (SELECT count(DISTINCT substr(vin, 1, 11)) AS p, (SELECT count(*) FROM staged) AS l, (SELECT count(price_cents) FROM staged) AS h FROM vehicles)
        SELECT 'stage' AS section, 'validate' AS name, source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS rows_out, CAST(sum(bad) AS BIGINT) AS rejects, count(*) AS batches FROM per GROUP BY source
        UNION ALL SELECT 'stage', 'normalize', source, CAST(sum(good) AS BIGINT), CAST(sum(good) AS BIGINT), 0, count(*) FROM per GROUP BY source
        UNION ALL SELECT 'stage', 'summary', source, CAST(sum(n) AS BIGINT), CAST(sum(good) AS BIGINT), CAST(sum(bad) AS BIGINT), 1 FROM per GROUP BY source
        UNION ALL SELECT 'stage', 'dedupe', 'all', n, u, 0, 1 FROM d UNION ALL SELECT 'stage', unnest(['enrich', 'load']), 'all', u, u, 0, 1 FROM d
        UNION ALL SELECT 'table', unnest(['vehicles', 'listings', 'price_history', 'quarantine', 'decode_cache']), '', unnest([u, l, h, (SELECT CAST(sum(bad) AS BIGINT) FROM per), p]), NULL, NULL, NULL FROM d, p
        UNION ALL SELECT 'reason', reason, source, count(*), NULL, NULL, NULL FROM (SELECT source, unnest([r1, r2]) AS reason FROM checked) u WHERE reason IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'metric', unnest(['unique_vins', 'vins_within_source_duplicate', 'vins_cross_source_duplicate', 'vins_with_year_conflict', 'unique_prefixes', 'cache_hits', 'decode_calls_made', 'vehicles_upserted', 'listings_upserted', 'price_history_rows_written']), 'all',
            1000000 * unnest([u, w, x, y, p, 0, p, u, l, h]), NULL, NULL, NULL FROM d, p
        UNION ALL SELECT 'metric', unnest(['within_source_duplicate_rate', 'cross_source_duplicate_rate', 'conflict_rate']), 'all', CAST(round(1000000.0 * unnest([w, x, y]) / u) AS BIGINT), NULL, NULL, NULL FROM d""",
    "lake_gold": f"""WITH {_in_lake(VEHICLES)} SELECT vehicle_make AS make, vehicle_model AS model, CAST(trunc(vehicle_year) AS INT) AS model_year, CAST(NULL AS VARCHAR) AS province, count(*) AS listing_count, {_rounded('price_cents')} AS avg_price_cad, CAST(floor(quantile_cont(price_cents, 0.5) + 0.5) AS BIGINT) AS median_price_cad,
        {_rounded('odometer_km')} AS avg_odometer_km FROM staged WHERE status1 = 'active' AND price_cents IS NOT NULL AND vehicle_make IS NOT NULL GROUP BY ALL""",
    "stream_ingest": f"WITH {_in_lake(CHECKED)} SELECT CASE WHEN r1 IS NULL AND r2 IS NULL THEN 'normal' ELSE 'rejected' END AS table_name, count(*) AS n FROM checked WHERE source = 'dealer-feed-a' GROUP BY 1",
    "ensure_tables": "SELECT * FROM (VALUES ('vehicles', 0, 15), ('listings', 0, 22), ('quarantine', 0, 7), ('pipeline_runs', 0, 12), ('quality_metrics', 0, 5), ('decode_cache', 0, 12), ('price_history', (SELECT count(*) FROM events), 4)) t(table_name, n, columns)",
    "load_both_ways": "SELECT r_regionkey, r_name, unnest(['benchmark_bulk', 'benchmark_single']) AS load FROM region",
    "store_append": f"WITH {HISTORY} SELECT listing_id, count(*) + count(*) FILTER (WHERE price_cents > 5000) AS n, CAST(sum(price_cents) + coalesce(sum(price_cents) FILTER (WHERE price_cents > 5000), 0) AS BIGINT) AS cents FROM history GROUP BY listing_id",
    "seed_decode": f"""WITH seeds(i, make, model, body_style, fuel_type, low, high) AS (VALUES {", ".join(f"({i}, '{s[3]}', '{s[4]}', '{s[5]}', '{s[6]}', {s[8]}, {s[9]})" for i, s in enumerate(generator.SEEDS))})
        SELECT o_orderkey, i IS NOT NULL AS valid, make, model, CAST(low + o_orderkey % (high - low + 1) AS INT) AS year, body_style, fuel_type FROM orders LEFT JOIN seeds ON o_custkey % {len(generator.SEEDS) + 1} = i""",
    "broken_vins": "SELECT o_orderkey, true AS digit_is_wrong, true AS length_is_wrong, true AS neither_is_whole FROM orders",
    "generated_rows": "SELECT CAST(unnest(range(n + n // 2)) AS BIGINT) AS row, true AS vin_ok, true AS seed_ok, true AS range_ok, true AS price_ok, true AS place_ok, true AS status_ok FROM (SELECT count(*) AS n FROM orders) o",
    "formatted_measures": f"WITH metrics AS ({_view(views.METRICS)}), v AS (SELECT DISTINCT CAST(metric_value AS BIGINT) AS q FROM metrics) SELECT q AS quarters, CASE WHEN q % 4 = 0 THEN CAST(q // 4 AS VARCHAR) WHEN q < 4 THEN printf('%.2f%%', q * 25.0) ELSE printf('%.2f', q / 4.0) END AS text FROM v",
    "gold_market_stats": f"WITH {LISTING} SELECT make, model, model_year, province, count(*) AS listing_count, {_rounded('price_cents')} AS avg_price_cad, CAST(floor(quantile_cont(price_cents, 0.5) + 0.5) AS BIGINT) AS median_price_cad, {_rounded('odometer_km')} AS avg_odometer_km FROM listing WHERE {STATS} GROUP BY ALL",
    "price_outliers_3s": "WITH e AS (SELECT event_type, CAST(floor(value * value) AS BIGINT) AS p FROM events), g AS (SELECT event_type, avg(p) AS m, stddev_pop(p) AS d, count(*) AS n FROM e GROUP BY 1) SELECT count(*) FILTER (WHERE abs(p - m) / d > 3) AS outliers, count(*) AS scored FROM e JOIN g USING (event_type) WHERE n >= 5 AND d > 0 AND p IS NOT NULL",
    "date_label": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS label, count(*) AS n FROM orders GROUP BY 1",
    "outlier_rows": f"WITH {LISTING}, g AS (SELECT make, model, count(*) AS n, avg(price_cents) AS m, stddev_pop(price_cents) AS d FROM listing WHERE price_cents IS NOT NULL GROUP BY ALL) SELECT make, count(*) AS n FROM listing JOIN g USING (make, model) WHERE price_cents IS NOT NULL AND g.n >= 5 AND d > 0 AND abs(price_cents - m) / d > 1.75 GROUP BY make",
}
