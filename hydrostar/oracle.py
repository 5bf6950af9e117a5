"""DuckDB twins of the queries, for the correctness gate.

Written from the result definitions, apart from the engine: the base queries
share two views (``place``: every plant with all it belongs to; ``reading``:
every measurement at its place and parameter, joined plainly so that repeated
rows multiply) from which one ``tally`` counts, and percentages come from
window totals or scalar lookups.  They run over the fixture tables (FIXTURES.md
section 2) inlined as CTEs.  Hygiene that makes the two engines agree:
``ILIKE`` for the case-blind LIKE, NULLIF for division by zero, and rounding
written in integer arithmetic (DuckDB's ``round(double)`` is not exact
half-up); sums of BIGINT are cast back to BIGINT and month to INTEGER.
"""

from __future__ import annotations

from collections.abc import Sequence

FIXTURE_CTES = """
f_region AS (
  SELECT CAST(r_regionkey AS BIGINT) AS region_id, r_name AS region_name FROM region),
f_state AS (
  SELECT CAST(n_nationkey AS BIGINT) AS state_id, CAST(n_regionkey AS BIGINT) AS region_id,
         concat('N', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS state_code,
         n_name AS state_name FROM nation),
f_municipality AS (
  SELECT c_custkey AS municipality_id, CAST(c_nationkey AS BIGINT) AS state_id FROM customer),
f_office AS (
  SELECT c_custkey AS office_id,
         CAST(c_nationkey * 5 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
              WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS BIGINT) AS institution_id
  FROM customer),
f_institution AS (
  SELECT DISTINCT
         CAST(c_nationkey * 5 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
              WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS BIGINT) AS institution_id,
         concat(c_mktsegment, ' ', CAST(c_nationkey AS VARCHAR)) AS institution_name,
         c_mktsegment AS institution_type
  FROM customer),
f_plant AS (
  SELECT o_orderkey AS plant_id, o_custkey AS municipality_id,
         CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS office_id,
         CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL WHEN '5-LOW' THEN ''
              ELSE o_orderpriority END AS filtration_type
  FROM orders),
f_point AS (
  SELECT s_suppkey AS point_id, concat('T', CAST(s_nationkey AS VARCHAR)) AS point_type,
         s_name AS point_name FROM supplier),
f_parameter AS (
  SELECT p_partkey AS parameter_id,
         CASE WHEN p_size = 49 THEN NULL WHEN p_size = 50 THEN '' ELSE p_name END AS parameter_name,
         CASE WHEN p_size <= 5 THEN 'None' WHEN p_size <= 8 THEN NULL ELSE p_brand END AS unit,
         p_type AS category
  FROM part),
f_band AS (
  SELECT * FROM (VALUES (1, 'A'), (2, 'N'), (3, 'R')) AS t(band_id, band_name)),
f_measurement AS (
  SELECT l_orderkey * 8 + l_linenumber AS measurement_id, l_orderkey AS plant_id,
         CASE WHEN l_linenumber = 6 AND l_tax = 0 THEN NULL ELSE l_suppkey END AS point_id,
         CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN NULL ELSE l_partkey END AS parameter_id,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS band_id,
         l_quantity AS value,
         CAST(month(l_shipdate) AS INTEGER) AS month,
         CAST(year(l_shipdate) AS INTEGER) AS year
  FROM lineitem)
"""


def with_fixture(*ctes_and_body: str) -> str:
    """``WITH <fixture views>[, extra CTEs] <body>``; the last argument is
    the body, the ones before it extra CTE definitions."""
    *extra, body = ctes_and_body
    ctes = FIXTURE_CTES.strip()
    for cte in extra:
        ctes += ",\n" + cte.strip()
    return f"WITH {ctes}\n{body.strip()}"


def half_up(a: str, b: str, digits: int) -> str:
    """ROUND(a / b, digits) half away from zero, for integers a >= 0, b > 0,
    as ``(2*M*a + b) // (2*b) / M`` with M = 10**digits; NULL when b = 0."""
    m = 10**digits
    return f"((2 * {m} * ({a}) + ({b})) // (2 * NULLIF({b}, 0))) / {m}.0e0"


def half_even(a: str, b: str) -> str:
    """a / b rounded to an integer, ties to even (a >= 0, b > 0), BIGINT."""
    q = f"(({a}) // NULLIF({b}, 0))"
    r2 = f"(2 * (({a}) - {q} * ({b})))"
    return f"({q} + CASE WHEN {r2} > ({b}) OR ({r2} = ({b}) AND {q} % 2 = 1) THEN 1 ELSE 0 END)"


def mean_half_even(total_units: str, n: str, in_digits: int, out_digits: int) -> str:
    """Mean of values held as whole units of 10**-in_digits, rounded
    half-even to out_digits decimals, DOUBLE."""
    shift = out_digits - in_digits
    a, b = f"CAST({total_units} AS BIGINT)", f"CAST({n} AS BIGINT)"
    if shift >= 0:
        a = f"{a} * {10**shift}"
    else:
        b = f"{b} * {10**(-shift)}"
    return f"({half_even(a, b)} / {10**out_digits}.0e0)"


def units(col: str, digits: int) -> str:
    """A value rounded to ``digits`` decimals as whole units (BIGINT)."""
    return f"CAST(round({col} * {10**digits}.0e0) AS BIGINT)"


def sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lit(v: object) -> str:
    return sql_str(v) if isinstance(v, str) else str(v)


# --- base queries -----------------------------------------------------------
# Each returns (extra CTEs, SELECT without ORDER BY, ORDER BY list), so that a
# derived oracle can inline a base query as a CTE of its own.

Parts = tuple[list[str], str, str]


def run(parts: Parts) -> str:
    ctes, select, order = parts
    return with_fixture(*ctes, f"{select.strip()}\nORDER BY {order}")


def inline(name: str, parts: Parts, *more: str) -> list[str]:
    """CTE list defining ``name`` as the base query (unordered)."""
    ctes, select, _ = parts
    return [*ctes, f"{name} AS (\n{select.strip()})", *more]


def _place(branch: str) -> str:
    """Every plant with what it belongs to along one branch (repeats on the
    other branch must not multiply it): states, geo (and regions), institution."""
    towns = """
  LEFT JOIN f_municipality town ON town.municipality_id = plant.municipality_id
  LEFT JOIN f_state home ON home.state_id = town.state_id"""
    place = "town.municipality_id AS town_id, home.state_id AS home_id, home.state_code, home.state_name"
    if branch == "geo":
        towns += "\n  LEFT JOIN f_region area ON area.region_id = home.region_id"
        place += ", area.region_id AS area_id, area.region_name"
    if branch == "institution":
        towns = """
  LEFT JOIN f_office desk ON desk.office_id = plant.office_id
  LEFT JOIN f_institution owner ON owner.institution_id = desk.institution_id"""
        place = "owner.institution_id AS owner_id, owner.institution_name, owner.institution_type"
    return f"""
place AS (
  SELECT plant.plant_id, {place}
  FROM f_plant plant{towns})"""


READING = """
reading AS (
  SELECT place.*, x.measurement_id, x.parameter_id, x.month, x.year, p.parameter_id AS known_id
  FROM place
  JOIN f_measurement x ON x.plant_id = place.plant_id
  LEFT JOIN f_parameter p ON p.parameter_id = x.parameter_id)"""

# Without the parameter side, for counts that do not ask for it.
READING_ANY = """
reading AS (
  SELECT place.*, x.measurement_id, x.month, x.year
  FROM place JOIN f_measurement x ON x.plant_id = place.plant_id)"""


def _tally(keys: str, where: str, counts: dict[str, str]) -> str:
    """One grouping of ``reading``: distinct values of the named columns, and
    the records that have an id."""
    several = ",\n         ".join(f"len(list(DISTINCT {c})) AS {n}" for n, c in counts.items())
    return f"""
tally AS (
  SELECT {keys}, {several},
         count(measurement_id) AS measurements
  FROM reading WHERE {where} GROUP BY ALL)"""


def q1_filtration_share() -> Parts:
    share = half_up("100 * plants", "everything", 2)
    return ["""
kinds AS (
  SELECT coalesce(filtration_type, '') AS filtration_type, count(*) AS plants,
         CAST(sum(count(*)) OVER () AS BIGINT) AS everything
  FROM f_plant GROUP BY 1)"""], f"""
SELECT filtration_type, plants, {share} AS pct FROM kinds WHERE filtration_type <> ''""", (
        "plants DESC, filtration_type NULLS FIRST"
    )


def _first_match(rules, default: object) -> str:
    """The value of the earliest rule whose pattern fits ``parameter_name``."""
    listed = ", ".join(f"({k}, {sql_str(p)}, {_lit(v)})" for k, (p, v) in enumerate(rules))
    return (
        f"coalesce((SELECT arg_min(r.value, r.place) FROM (VALUES {listed}) AS r(place, pattern, value) "
        f"WHERE parameter_name ILIKE r.pattern), {_lit(default)})"
    )


def q2_parameter_purpose(rules, default, sort_rules, sort_default) -> Parts:
    return [], f"""
SELECT parameter_name, unit,
       {_first_match(rules, default)} AS purpose,
       {_first_match(sort_rules, sort_default)} AS purpose_rank,
       parameter_id
FROM f_parameter WHERE length(parameter_name) > 0""", (
        "purpose_rank, parameter_name NULLS FIRST, unit NULLS FIRST, parameter_id NULLS FIRST"
    )


def q2_public(parts: Parts) -> str:
    """Q2 as the dashboard shows it: without its sort helpers."""
    return with_fixture(
        *inline("q2", parts),
        f"SELECT parameter_name, unit, purpose FROM q2 ORDER BY {parts[2]}",
    )


def q3_state_coverage() -> Parts:
    return [_place("geo"), """
served AS (
  SELECT state_code, state_name, len(list(DISTINCT plant_id)) AS plants,
         len(list(DISTINCT town_id)) AS municipalities
  FROM place WHERE home_id IS NOT NULL GROUP BY ALL)"""], f"""
SELECT *, {half_up('plants', 'municipalities', 2)} AS plants_per_municipality
FROM served WHERE plants > 0""", "plants DESC, state_code NULLS FIRST, state_name NULLS FIRST"


def _volume(fk: str, table: str, keys: str, order: str) -> Parts:
    """Records per key counted on the fact alone, then named."""
    share = half_up("100 * measurements", "(SELECT CAST(sum(everything) AS BIGINT) FROM per_key)", 2)
    return [f"""
per_key AS (
  SELECT {fk}, count(measurement_id) AS records, count(*) AS everything
  FROM f_measurement GROUP BY {fk})""", f"""
named AS (
  SELECT {keys}, CAST(sum(records) AS BIGINT) AS measurements
  FROM per_key NATURAL JOIN {table} GROUP BY ALL)"""], f"""
SELECT *, {share} AS pct FROM named""", order


def q4_point_volume() -> Parts:
    return _volume(
        "point_id", "f_point", "point_type, point_name",
        "measurements DESC, point_type NULLS FIRST, point_name NULLS FIRST",
    )


def q5_parameter_volume() -> Parts:
    return _volume(
        "parameter_id", "f_parameter", "category, parameter_name",
        "category NULLS FIRST, measurements DESC, parameter_name NULLS FIRST",
    )


def q6_geo_activity() -> Parts:
    counts = {"municipalities": "town_id", "plants": "plant_id"}
    tally = _tally("region_name, state_code", "area_id IS NOT NULL", counts)
    return [_place("geo"), READING_ANY, tally], f"""
SELECT *, {half_up('measurements', 'plants', 0)} AS measurements_per_plant
FROM tally WHERE measurements > 0""", (
        "measurements DESC, region_name NULLS FIRST, state_code NULLS FIRST"
    )


def q7_institution_performance(min_measurements: int) -> Parts:
    tally = _tally(
        "institution_name, institution_type",
        "owner_id IS NOT NULL AND known_id IS NOT NULL",
        {"plants": "plant_id", "parameters": "known_id"},
    )
    return [_place("institution"), READING, tally], f"""
SELECT *, {half_up('measurements', 'plants', 0)} AS measurements_per_plant
FROM tally WHERE measurements > {min_measurements}""", (
        "plants DESC, institution_name NULLS FIRST, institution_type NULLS FIRST"
    )


def q8_band_distribution(pairs, min_records: int) -> Parts:
    """Bands of the listed pairs first, the share by a lookup of the total."""
    listed = ", ".join(f"({sql_str(p)}, {sql_str(b)})" for p, b in sorted(set(pairs)))
    return [f"""
listed AS (
  SELECT parameter_id, parameter_name, band_id, band_name
  FROM f_parameter, f_band WHERE (parameter_name, band_name) IN (VALUES {listed}))""", """
bands AS (
  SELECT filtration_type, parameter_name, band_name, sum(value) AS analyses,
         len(list(DISTINCT plant_id)) AS plants, count(measurement_id) AS records
  FROM listed NATURAL JOIN f_measurement NATURAL JOIN (SELECT plant_id, filtration_type FROM f_plant)
  WHERE filtration_type IS NOT NULL GROUP BY ALL)""", """
totals AS (
  SELECT map_from_entries(list((filtration_type || chr(0) || parameter_name, total))) AS of FROM (
    SELECT filtration_type, parameter_name, CAST(sum(analyses) AS BIGINT) AS total
    FROM bands GROUP BY ALL))"""], f"""
SELECT filtration_type, parameter_name, band_name, analyses, plants,
       {half_up('100 * CAST(analyses AS BIGINT)',
                "(SELECT of[filtration_type || chr(0) || parameter_name] FROM totals)", 2)} AS pct
FROM bands WHERE records >= {min_records}""", (
        "filtration_type NULLS FIRST, parameter_name NULLS FIRST, band_name DESC"
    )


def q9_state_ranking(min_plants: int) -> Parts:
    tally = _tally(
        "state_name",
        "home_id IS NOT NULL AND known_id IS NOT NULL",
        {"plants": "plant_id", "parameters": "known_id"},
    )
    return [_place("states"), READING, tally], f"""
SELECT * FROM tally WHERE plants >= {min_plants}""", (
        "parameters DESC, measurements DESC, state_name NULLS FIRST"
    )


def q10_monthly_evolution(year: int, min_measurements: int, bounds, labels) -> Parts:
    # The number of bounds that the month is past picks the label.
    past = " + ".join(f"(month > {b})::INT" for b in bounds)
    texts = ", ".join(sql_str(x) for x in labels)
    tally = _tally(
        "region_name, month",
        f"area_id IS NOT NULL AND known_id IS NOT NULL AND year = {year}",
        {"plants": "plant_id", "parameters": "known_id"},
    )
    return [_place("geo"), READING, tally], f"""
SELECT region_name, CAST(month AS INTEGER) AS month, measurements, plants, parameters,
       {half_up('measurements', 'plants', 1)} AS intensity,
       {half_up('parameters', 'plants', 2)} AS diversity,
       [{texts}][coalesce({past}, {len(labels) - 1}) + 1] AS period
FROM tally WHERE measurements >= {min_measurements}""", (
        "region_name NULLS FIRST, month NULLS FIRST"
    )


def q11_kpi_summary(names) -> Parts:
    texts = ", ".join(sql_str(x) for x in names)
    return [_place("states"), """
headline AS (
  SELECT [
    (SELECT len(list(DISTINCT state_name)) FROM place WHERE home_id IS NOT NULL),
    (SELECT count(*) FROM f_plant), (SELECT count(*) FROM f_measurement),
    (SELECT count(*) FROM f_parameter),
    (SELECT len(list(DISTINCT town_id)) FROM place WHERE town_id IS NOT NULL)] AS numbers)"""], f"""
SELECT CAST(k AS INTEGER) AS ord, [{texts}][k] AS metric, CAST(numbers[k] AS BIGINT) AS value
FROM headline, range(1, 6) AS r(k)""", "ord"


# --- derived results ----------------------------------------------------------
# Each takes the Parts of the base query it reads and returns full SQL.

def _from(name: str, parts: Parts, *more: str, body: str) -> str:
    return with_fixture(*inline(name, parts), *more, body)


def top(name: str, parts: Parts, k: int, cols: str = "*", order: str | None = None) -> str:
    return _from(
        name, parts, body=f"SELECT {cols} FROM {name} ORDER BY {order or parts[2]} LIMIT {k}"
    )


def share_by(name: str, parts: Parts, key: str) -> str:
    per = f"""
per AS (
  SELECT {key}, CAST(SUM(measurements) AS BIGINT) AS measurements
  FROM {name} WHERE {key} IS NOT NULL GROUP BY {key})"""
    return _from(name, parts, per, body=f"""
SELECT {key}, measurements,
       {half_up('100 * measurements', '(SELECT CAST(SUM(measurements) AS BIGINT) FROM per)', 2)} AS pct
FROM per ORDER BY measurements DESC, {key} NULLS FIRST""")


def total_of(name: str, parts: Parts, measure: str) -> str:
    return _from(name, parts, body=f"""
SELECT CAST(SUM({measure}) AS BIGINT) AS {measure},
       format('{{:,}}', CAST(SUM({measure}) AS BIGINT)) AS {measure}_text
FROM {name}""")


def p4_purpose_counts(q2: Parts) -> str:
    return _from("q2", q2, body="""
SELECT purpose, COUNT(*) AS parameters FROM q2 WHERE purpose IS NOT NULL
GROUP BY purpose ORDER BY parameters DESC, purpose""")


def p5_purpose_detail(q2: Parts, none_text: str, qualitative: str) -> str:
    """Numbered rows of Q2: a purpose stands where its first row does."""
    numbered = f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY {q2[2]}) AS rn FROM q2 WHERE purpose IS NOT NULL)"""
    return _from("q2", q2, numbered, body=f"""
SELECT purpose, count(*) OVER (PARTITION BY purpose) AS purpose_parameters, parameter_name,
       CASE WHEN unit = {sql_str(none_text)} THEN {sql_str(qualitative)} ELSE unit END AS unit_label
FROM numbered ORDER BY min(rn) OVER (PARTITION BY purpose), rn""")


def p6_state_coverage_display(q3: Parts) -> str:
    return _from("q3", q3, body=f"""
SELECT *, printf('%.2f', plants_per_municipality) AS efficiency FROM q3 ORDER BY {q3[2]}""")


def p9_category_hierarchy(q5: Parts) -> str:
    return _from("q5", q5, body="""
SELECT category, parameter_name, GROUPING_ID(category, parameter_name) AS level,
       CAST(SUM(measurements) AS BIGINT) AS measurements
FROM q5 GROUP BY ROLLUP (category, parameter_name)
ORDER BY level, category NULLS FIRST, parameter_name NULLS FIRST""")


def p11_regional_summary(q6: Parts) -> str:
    return _from("q6", q6, body=f"""
SELECT region_name,
       CAST(SUM(measurements) AS BIGINT) AS measurements,
       CAST(SUM(plants) AS BIGINT) AS plants,
       {mean_half_even(f"SUM({units('measurements_per_plant', 0)})", 'COUNT(measurements_per_plant)', 0, 1)}
         AS measurements_per_plant,
       CAST(SUM(municipalities) AS BIGINT) AS municipalities
FROM q6 WHERE region_name IS NOT NULL
GROUP BY region_name ORDER BY region_name""")


def p12_band_series(q8: Parts) -> str:
    """Numbered rows of Q8: a parameter stands where its first row does."""
    numbered = f"numbered AS (SELECT *, row_number() OVER (ORDER BY {q8[2]}) AS rn FROM q8)"
    return _from("q8", q8, numbered, body="""
SELECT parameter_name, filtration_type, band_name, pct FROM numbered
ORDER BY min(rn) OVER (PARTITION BY parameter_name), rn""")


def p15_ranking_mean_parameters(q9: Parts) -> str:
    return _from("q9", q9, body=f"""
SELECT {half_even('CAST(SUM(parameters) AS BIGINT)', 'COUNT(parameters)')} AS mean_parameters FROM q9""")


def p17_select_options(q8: Parts, all_filtrations: str, all_parameters: str) -> str:
    f = """
f_opts AS (
  SELECT filtration_type AS option,
         CAST(ROW_NUMBER() OVER (ORDER BY filtration_type) AS INTEGER) AS ord
  FROM (SELECT DISTINCT filtration_type FROM q8))"""
    p = """
p_opts AS (
  SELECT parameter_name AS option,
         CAST(ROW_NUMBER() OVER (ORDER BY first_f, parameter_name) AS INTEGER) AS ord
  FROM (SELECT parameter_name, MIN(filtration_type) AS first_f FROM q8 GROUP BY parameter_name))"""
    return _from("q8", q8, f, p, body=f"""
SELECT 'filtration_type' AS field, 0 AS ord, {sql_str(all_filtrations)} AS option
UNION ALL SELECT 'filtration_type', ord, option FROM f_opts
UNION ALL SELECT 'parameter_name', 0, {sql_str(all_parameters)}
UNION ALL SELECT 'parameter_name', ord, option FROM p_opts
ORDER BY field, ord""")


def choice_where(filtration: str | None, parameter: str | None) -> str:
    conds = []
    if filtration is not None:
        conds.append(f"filtration_type = {sql_str(filtration)}")
    if parameter is not None:
        conds.append(f"parameter_name = {sql_str(parameter)}")
    return " AND ".join(conds) or "TRUE"


def p18_filter_choice(q8: Parts, filtration: str | None, parameter: str | None) -> str:
    where = choice_where(filtration, parameter)
    return _from("q8", q8, body=f"SELECT * FROM q8 WHERE {where} ORDER BY {q8[2]}")


def columns_of(name: str, parts: Parts, cols: str, where: str = "TRUE") -> str:
    return _from(name, parts, body=f"SELECT {cols} FROM {name} WHERE {where} ORDER BY {parts[2]}")


def p19_monthly_series(q10: Parts) -> str:
    return _from("q10", q10, body="""
SELECT region_name, month, 'measurements' AS series, CAST(measurements AS DOUBLE) AS value FROM q10
UNION ALL
SELECT region_name, month, 'intensity', intensity FROM q10
ORDER BY region_name NULLS FIRST, month NULLS FIRST, series DESC""")


def p20_intensity_heatmap(q10: Parts) -> str:
    cells = ",\n       ".join(
        f"MAX(CASE WHEN month = {m} THEN intensity END) AS m{m:02d}" for m in range(1, 13)
    )
    return _from("q10", q10, body=f"""
SELECT region_name,
       {cells}
FROM q10 WHERE month IS NOT NULL
GROUP BY region_name ORDER BY region_name NULLS FIRST""")


def p21_period_summary(q10: Parts) -> str:
    return _from("q10", q10, body=f"""
SELECT region_name, period,
       CAST(SUM(measurements) AS BIGINT) AS measurements,
       {mean_half_even(f"SUM({units('intensity', 1)})", 'COUNT(intensity)', 1, 2)} AS intensity,
       {mean_half_even(f"SUM({units('diversity', 2)})", 'COUNT(diversity)', 2, 2)} AS diversity
FROM q10 WHERE region_name IS NOT NULL
GROUP BY region_name, period ORDER BY region_name, period""")


def p22_intensity_box_stats(q10: Parts) -> str:
    """Hazen quartiles by row numbers over the individual rows."""
    v = f"""
v AS (
  SELECT region_name, {units('intensity', 1)} AS u,
         ROW_NUMBER() OVER (PARTITION BY region_name ORDER BY intensity) AS rn,
         COUNT(*) OVER (PARTITION BY region_name) AS n
  FROM q10 WHERE region_name IS NOT NULL AND intensity IS NOT NULL)"""
    h = """
h AS (
  SELECT DISTINCT region_name, n,
         LEAST(GREATEST(n * 1 + 2, 4), 4 * n) AS h1,
         LEAST(GREATEST(n * 2 + 2, 4), 4 * n) AS h2,
         LEAST(GREATEST(n * 3 + 2, 4), 4 * n) AS h3
  FROM v)"""

    def q4(hc: str) -> str:
        a = f"MAX(CASE WHEN v.rn = h.{hc} // 4 THEN v.u END)"
        b = f"MAX(CASE WHEN v.rn = LEAST(h.{hc} // 4 + 1, h.n) THEN v.u END)"
        return f"(4 * {a} + (h.{hc} % 4) * ({b} - {a}))"

    qs = f"""
qs AS (
  SELECT h.region_name, h.n, {q4('h1')} AS q1_4, {q4('h2')} AS m_4, {q4('h3')} AS q3_4
  FROM h JOIN v ON h.region_name = v.region_name
  GROUP BY h.region_name, h.n, h.h1, h.h2, h.h3)"""
    w = """
w AS (
  SELECT *, 2 * q1_4 - 3 * (q3_4 - q1_4) AS lo8, 2 * q3_4 + 3 * (q3_4 - q1_4) AS hi8 FROM qs)"""
    inside = "8 * v.u >= w.lo8 AND 8 * v.u <= w.hi8"
    return _from("q10", q10, v, h, qs, w, body=f"""
SELECT w.region_name, CAST(w.n AS BIGINT) AS n,
       w.q1_4 / 40.0e0 AS q1, w.m_4 / 40.0e0 AS median, w.q3_4 / 40.0e0 AS q3,
       MIN(CASE WHEN {inside} THEN v.u END) / 10.0e0 AS lower_whisker,
       MAX(CASE WHEN {inside} THEN v.u END) / 10.0e0 AS upper_whisker,
       CAST(SUM(CASE WHEN {inside} THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM w JOIN v ON w.region_name = v.region_name
GROUP BY w.region_name, w.n, w.q1_4, w.m_4, w.q3_4
ORDER BY w.region_name""")


def p22_intensity_outliers(q10: Parts) -> str:
    """Points beyond 1.5 times the quartile distance, quartiles by the Hazen
    rule over the sorted list of each region."""
    lists = f"""
lists AS (
  SELECT region_name, list({units('intensity', 1)} ORDER BY intensity) AS us
  FROM q10 WHERE region_name IS NOT NULL AND intensity IS NOT NULL GROUP BY region_name)"""

    def quartile(p4: int) -> str:
        h = f"least(greatest(len(us) * {p4} + 2, 4), 4 * len(us))"
        lo, hi = f"us[{h} // 4]", f"us[least({h} // 4 + 1, len(us))]"
        return f"(4 * {lo} + ({h} % 4) * ({hi} - {lo}))"

    box = f"box AS (SELECT region_name, {quartile(1)} AS low4, {quartile(3)} AS high4 FROM lists)"
    u = units("intensity", 1)
    return _from("q10", q10, lists, box, body=f"""
SELECT region_name, month, intensity FROM q10 NATURAL JOIN box
WHERE 8 * {u} < 5 * low4 - 3 * high4 OR 8 * {u} > 5 * high4 - 3 * low4
ORDER BY region_name, month NULLS FIRST, intensity""")


def _std_sql(col: str, digits: int, out_digits: int) -> str:
    u = units(col, digits)
    num = f"CAST(COUNT({col}) * SUM({u} * {u}) - SUM({u}) * SUM({u}) AS DOUBLE)"
    den = f"CAST(NULLIF(COUNT({col}) * (COUNT({col}) - 1), 0) AS DOUBLE)"
    m = f"{10**out_digits}.0e0"
    return f"(round_even(sqrt({num} / {den}) / {10**digits}.0e0 * {m}, 0) / {m})"


def p23_consolidated_stats(q10: Parts) -> str:
    return _from("q10", q10, body=f"""
SELECT region_name,
       CAST(SUM(measurements) AS BIGINT) AS measurements_sum,
       {mean_half_even('SUM(measurements)', 'COUNT(measurements)', 0, 2)} AS measurements_mean,
       {mean_half_even('SUM(plants)', 'COUNT(plants)', 0, 2)} AS plants_mean,
       {mean_half_even('SUM(parameters)', 'COUNT(parameters)', 0, 2)} AS parameters_mean,
       {mean_half_even(f"SUM({units('intensity', 1)})", 'COUNT(intensity)', 1, 2)} AS intensity_mean,
       {_std_sql('intensity', 1, 2)} AS intensity_std,
       {mean_half_even(f"SUM({units('diversity', 2)})", 'COUNT(diversity)', 2, 2)} AS diversity_mean,
       {_std_sql('diversity', 2, 2)} AS diversity_std
FROM q10 WHERE region_name IS NOT NULL
GROUP BY region_name ORDER BY region_name""")


def p25_coverage_dual_axis(q3: Parts) -> str:
    numbered = f"numbered AS (SELECT *, row_number() OVER (ORDER BY {q3[2]}) AS rn FROM q3)"
    return _from("q3", q3, numbered, body="""
SELECT state_code, series.measure, series.value FROM (
  SELECT rn, state_code, unnest([{'measure': 'plants', 'value': plants},
                                 {'measure': 'municipalities', 'value': municipalities}]) AS series
  FROM numbered)
ORDER BY rn, series.measure DESC""")


def p26_labels(name: str, parts: Parts, keys: str, label_col: str, width: int, measure: str) -> str:
    return _from(name, parts, body=f"""
SELECT {keys},
       substring({label_col}, 1, {width}) || '...' AS label,
       format('{{:,}}', {measure}) AS value_text,
       printf('%.1f', pct) || '%' AS delta_text
FROM {name} ORDER BY {parts[2]}""")
