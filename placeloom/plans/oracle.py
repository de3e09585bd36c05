"""The core queries in SQL, for a second engine to run over the same tables."""

from __future__ import annotations

WS = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _grams(c: str) -> str:
    words = f"list_filter(string_split_regex(lower({_strip(c)}), '{WS}+'), lambda w: w <> '')"
    return f"flatten(list_transform({words}, lambda w: CASE WHEN length(w) < 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)) END))"


_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{24b6}-\x{24e9}\x{200c}\x{200d}"
_TOKEN = rf"[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{20000}}-\x{{3134F}}]|[{_W}]+(?:[-_][{_W}]+)*|[^{WS[1:-1]}]"


CTE = {
    "places": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY geonameid ORDER BY loaded_at DESC NULLS LAST, modification_date DESC NULLS LAST, population DESC NULLS LAST) AS rn FROM geonames) WHERE rn = 1",
    "alternates": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alternate_name_id ORDER BY loaded_at DESC NULLS LAST, alternate_name DESC NULLS LAST) AS rn FROM alternate_names) WHERE rn = 1",
    "scope": "SELECT * FROM places WHERE country_code IN ('RU', 'US', 'TR', 'CN') AND feature_code NOT IN ('PPLH', 'PPLQ', 'PPLW', 'PPLX')",
    "rows": """SELECT geonameid, country_code, admin1_code, population, asciiname, name, 'en' AS isolanguage FROM scope WHERE name IS NOT NULL
      UNION SELECT geonameid, country_code, admin1_code, population, asciiname, asciiname, 'en' FROM scope WHERE asciiname IS NOT NULL
      UNION SELECT s.geonameid, s.country_code, s.admin1_code, s.population, s.asciiname, a.alternate_name, a.isolanguage FROM alternates a JOIN scope s USING (geonameid)
      WHERE a.isolanguage IN ('ru', 'en', 'tr', 'zh') AND a.alternate_name IS NOT NULL""",
    "names": "SELECT DISTINCT name FROM rows",
    "requests": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY generated_at DESC NULLS LAST, attempts DESC NULLS LAST, query DESC NULLS LAST) AS rn FROM query_dataset) WHERE rn = 1",
    "groups": f"""SELECT name, isolanguage, country_code, admin1_code, list_sort(list(geonameid)) AS ids, max(admin1_name) AS admin1_name, max(population) AS max_population,
        {_strip("max(admin1_name)")} <> '' AND (coalesce(bool_or(lower({_strip("asciiname")}) = lower({_strip("admin1_name")})), false) OR lower({_strip("name")}) = lower({_strip("max(admin1_name)")})) AS region_repeats_city
      FROM (SELECT r.name, r.isolanguage, r.country_code, coalesce(r.admin1_code, '') AS admin1_code, r.geonameid, r.population, r.asciiname, coalesce(a.admin1_name, '') AS admin1_name
            FROM rows r LEFT JOIN admin1 a ON r.country_code = a.country_code AND r.admin1_code = a.admin1_code) GROUP BY 1, 2, 3, 4""",
    "pools": """SELECT *, max(pop_in_country) OVER (PARTITION BY name, isolanguage) AS pop_anywhere, count(*) OVER (PARTITION BY name, isolanguage) AS n_countries
      FROM (SELECT name, isolanguage, country_code, max(max_population) AS pop_in_country, count(*) AS n_admin1_in_country, bool_or(NOT region_repeats_city) AS has_valid_region FROM groups GROUP BY 1, 2, 3)""",
    "texts": "SELECT DISTINCT array_to_string(list_transform(entities, lambda e: e.text), ' ') AS q FROM requests",
    "docs": f"SELECT name AS doc, g, len(g) AS dl FROM (SELECT name, {_grams('name')} AS g FROM names)",
    "postings": "SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, dl, unnest(g) AS term FROM docs) GROUP BY 1, 2, 3",
    "asked": f"SELECT q, unnest(g) AS term FROM (SELECT q, {_grams('q')} AS g FROM texts)",
    "scores": """SELECT q, doc, CAST(sum(c) AS BIGINT) / 1e12::DOUBLE AS score FROM (
        SELECT a.q, p.doc, CAST(floor(p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / (SELECT avg(dl) FROM docs))) * 1e12::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS c FROM asked a JOIN postings p USING (term)) GROUP BY 1, 2""",
    "found": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM scores) WHERE rank <= 10",
    "filled": """SELECT q, doc, score FROM found UNION ALL SELECT t.q, n.name, 0.0 FROM texts t CROSS JOIN (SELECT name FROM names ORDER BY name LIMIT 20) n
      WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.q = t.q AND f.doc = n.name)""",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM filled) WHERE rank <= 10",
    "run": "SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, population DESC, geonameid) AS rank FROM matched",
    "matched": """SELECT request_id, geonameid, score, population FROM (SELECT request_id, geonameid, retriever_score AS score, coalesce(population, 0) AS population,
        row_number() OVER (PARTITION BY request_id, geonameid ORDER BY retriever_score DESC, coalesce(population, 0) DESC) AS k FROM geoname_matches WHERE retriever_score IS NOT NULL AND NOT isnan(retriever_score)) WHERE k = 1""",
    "gold": "SELECT request_id, language, e.start AS s, e.end AS e2, e.label AS label, confidence FROM (SELECT request_id, language, confidence, unnest(entities) AS e FROM requests)",
    "guess": """SELECT request_id, language, strpos(lower(query), part) - 1 AS s, strpos(lower(query), part) - 1 + length(part) AS e2, 'CITY' AS label, coalesce(confidence, 0.0) AS score FROM (
        SELECT DISTINCT request_id, language, query, confidence, trim(p) AS part FROM (SELECT request_id, language, query, confidence, unnest(string_split(lower(name), ',')) AS p FROM requests))
      WHERE part <> '' AND strpos(lower(query), part) > 0""",
    "spans": "SELECT coalesce(g.request_id, p.request_id) AS request_id, coalesce(g.language, p.language) AS language, coalesce(g.s, p.s) AS s, coalesce(g.e2, p.e2) AS e2, coalesce(g.label, p.label) AS label, (g.request_id IS NOT NULL)::INT AS g, (p.request_id IS NOT NULL)::INT AS p, p.score FROM (SELECT DISTINCT request_id, language, s, e2, label FROM gold) g FULL JOIN (SELECT request_id, language, s, e2, label, max(score) AS score FROM guess GROUP BY ALL) p ON g.request_id = p.request_id AND g.s = p.s AND g.e2 = p.e2 AND g.label = p.label",
    "qrels": "SELECT DISTINCT request_id AS query, unnest(geonameid) AS id FROM requests",
    "lines": r"""SELECT line_id, file_name, CASE WHEN coalesce(file_name, '') LIKE 'alternateNames%' THEN 'name' ELSE 'place' END AS kind, chr(9) || coalesce(line, '') AS x FROM raw_lines""",
    "cut": r"""SELECT line_id, file_name, kind, CASE WHEN regexp_full_match(x, '(?s)(?:\t(?:"(?:[^"]|"")*"|(?:[^"\t][^\t]*)?))+') THEN
        list_transform(regexp_extract_all(x, '(?s)\t("(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)', 1), lambda c: CASE WHEN c LIKE '"%' THEN replace(substring(c, 2, length(c) - 2), '""', '"') ELSE c END) END AS c FROM lines""",
    "judged": r"""SELECT *, CASE WHEN c IS NULL THEN 'quoting' WHEN len(c) <> CASE kind WHEN 'name' THEN 10 ELSE 19 END THEN 'columns'
        WHEN kind = 'place' AND NOT regexp_full_match(c[15], '[0-9]*') THEN 'population'
        WHEN kind = 'place' AND NOT regexp_full_match(c[5], '(-?0*([0-8]?[0-9](\.[0-9]+)?|90(\.0+)?))?') THEN 'latitude'
        WHEN kind = 'name' AND NOT regexp_full_match(c[3], '([a-z]{2,3}(-[A-Za-z]{2,4})?)?') THEN 'isolanguage' END AS reason FROM cut""",
    "new_places": """SELECT * FROM (SELECT TRY_CAST(c[1] AS BIGINT) AS geonameid, c[2] AS name, c[3] AS asciiname, nullif(c[8], '') AS feature_code, nullif(c[9], '') AS country_code, nullif(c[11], '') AS admin1_code,
        CASE WHEN c[15] = '' THEN 0 ELSE TRY_CAST(c[15] AS BIGINT) END AS population, row_number() OVER (PARTITION BY TRY_CAST(c[1] AS BIGINT) ORDER BY line_id DESC) AS rn FROM judged
        WHERE reason IS NULL AND kind = 'place' AND file_name LIKE 'modifications-%' AND c[7] = 'P' AND c[9] IN ('RU', 'US', 'TR', 'CN') AND TRY_CAST(c[1] AS BIGINT) IS NOT NULL) WHERE rn = 1""",
    "base": "SELECT geonameid, name, asciiname, feature_code, country_code, admin1_code, population FROM places",
    "left_places": "SELECT geonameid, name, asciiname, feature_code, country_code, admin1_code, population FROM places WHERE geonameid NOT IN (SELECT geonameid FROM places WHERE feature_class <> 'P')",
    "delta_places": "SELECT * FROM left_places WHERE geonameid NOT IN (SELECT geonameid FROM new_places) UNION ALL SELECT * EXCLUDE (rn) FROM new_places",
    "new_names": """SELECT * EXCLUDE (rn) FROM (SELECT TRY_CAST(c[1] AS BIGINT) AS alternate_name_id, TRY_CAST(c[2] AS BIGINT) AS geonameid, nullif(c[3], '') AS isolanguage, c[4] AS alternate_name,
        row_number() OVER (PARTITION BY TRY_CAST(c[1] AS BIGINT) ORDER BY line_id DESC) AS rn FROM judged
        WHERE reason IS NULL AND kind = 'name' AND file_name LIKE 'alternateNamesModifications%' AND c[3] IN ('ru', 'en', 'tr', 'zh') AND TRY_CAST(c[1] AS BIGINT) IS NOT NULL
          AND TRY_CAST(c[2] AS BIGINT) IN (SELECT geonameid FROM delta_places)) WHERE rn = 1""",
    "delta_names": """SELECT alternate_name_id, geonameid, isolanguage, alternate_name FROM alternates WHERE geonameid IN (SELECT geonameid FROM left_places) AND NOT coalesce(is_historic, false)
        AND alternate_name_id NOT IN (SELECT alternate_name_id FROM new_names) UNION ALL SELECT * FROM new_names""",
    "ideal": "SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY x.request_id ORDER BY (q2.id IS NOT NULL) DESC, x.rank, x.geonameid) AS rank FROM run x LEFT JOIN qrels q2 ON q2.query = x.request_id AND q2.id = x.geonameid",
    "peopled": "SELECT request_id, geonameid, row_number() OVER (PARTITION BY request_id ORDER BY population DESC, score DESC, geonameid) AS rank FROM matched",
    "results": f"""SELECT * FROM (
          SELECT c.q, c.geonameid, s.asciiname, s.country_code, s.population, c.score, row_number() OVER (PARTITION BY c.q ORDER BY c.score DESC, coalesce(s.population, 0) DESC, c.geonameid) AS rank
          FROM (SELECT t.q, r.geonameid, max(t.score) AS score FROM top t JOIN rows r ON r.name = t.doc WHERE {_strip("t.q")} <> '' GROUP BY 1, 2) c JOIN scope s USING (geonameid)) WHERE rank <= 10""",
    "toks": f"""SELECT request_id, i, CAST(sum(length(piece)) OVER (PARTITION BY request_id ORDER BY i) AS BIGINT) - length(piece) AS s, length(tok) AS w, tok FROM (
        SELECT request_id, i, replace(piece, chr(2), '') AS piece, split_part(piece, chr(2), 1) AS tok FROM (
          SELECT request_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS i FROM (SELECT request_id, string_split(regexp_replace(query, '({_TOKEN})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS pieces FROM requests)))""",
    "words": "SELECT request_id, i - 1 AS at, s, s + w AS e, tok FROM toks WHERE i > 0",
    "spans_at": "SELECT request_id, unnest(entities) AS en, generate_subscripts(entities, 1) - 1 AS pos, query FROM requests",
    "aligned": "SELECT x.request_id, x.pos, x.en, x.query, CASE WHEN b.at >= a.at THEN a.at END AS first, CASE WHEN b.at >= a.at THEN b.at END AS last FROM spans_at x LEFT JOIN words a ON a.request_id = x.request_id AND a.s = x.en.start LEFT JOIN words b ON b.request_id = x.request_id AND b.e = x.en.end",
}


def _with(order: str, last: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order.split()) + "\n" + last


def _draw(*parts: str) -> str:
    return f"CAST('0x' || substring(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


_RATES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 4) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE) ELSE 0 END, 4) AS f1"""
_COUNTS = "CAST(sum(g * p) AS BIGINT) AS tp, CAST(sum((1 - g) * p) AS BIGINT) AS fp, CAST(sum(g * (1 - p)) AS BIGINT) AS fn"
_BASE = "places alternates scope rows"
_IR = """SELECT count(*) AS queries, round(avg(rr), 4) AS rr, round(avg(p1), 4) AS p1, round(avg(r5), 4) AS r5, round(avg(r10), 4) AS r10, round(avg(r25), 4) AS r25, round(avg(r50), 4) AS r50 FROM (
  SELECT q.query, coalesce(1.0::DOUBLE / min(r.rank), 0) AS rr, coalesce((min(r.rank) = 1)::DOUBLE, 0) AS p1, count(CASE WHEN r.rank <= 5 THEN 1 END) / count(*)::DOUBLE AS r5, count(CASE WHEN r.rank <= 10 THEN 1 END) / count(*)::DOUBLE AS r10,
    count(CASE WHEN r.rank <= 25 THEN 1 END) / count(*)::DOUBLE AS r25, count(CASE WHEN r.rank <= 50 THEN 1 END) / count(*)::DOUBLE AS r50
  FROM qrels q LEFT JOIN %s r ON q.query = r.request_id AND q.id = r.geonameid GROUP BY q.query)"""
_LABELS = "array_to_string(list_transform(list_filter(entities, lambda e: e.label IN (%s)), lambda e: e.text), ' ')"


_DESCRIBED = f"""SELECT geonameid, {_strip("concat_ws(chr(10), names, coalesce(c.country_name, country_code, ''), coalesce(a.admin1_name, ''))")} AS description FROM (
    SELECT geonameid, country_code, admin1_code, array_to_string(list_sort(list(DISTINCT name)), ' | ') AS names FROM %s GROUP BY 1, 2, 3) g
  LEFT JOIN admin1 a USING (country_code, admin1_code) LEFT JOIN (VALUES ('RU', 'Russia'), ('US', 'United States'), ('TR', 'Turkey'), ('CN', 'China')) c(country_code, country_name) USING (country_code)"""


def _bucket_sql(prefix: str = "") -> str:
    kinds = {"city_entities": "'CITY'", "country_entities": "'COUNTRY'", "admin1_entities": "'REGION', 'STATE'"}
    return ", ".join(f"{_LABELS % v} AS {prefix}{k}" for k, v in kinds.items())


def _quoted(t: str) -> str:
    escaped = f"replace(replace(replace({t}, '\\', '\\\\'), chr(10), '\\n'), chr(9), '\\t')"
    return f"""CASE WHEN contains({t}, '''') AND NOT contains({t}, '"') THEN '"' || {escaped} || '"' ELSE '''' || replace({escaped}, '''', '\\''') || '''' END"""


def _fold(c: str) -> str:
    return f"replace(translate(lower({c}), 'ς', 'σ'), 'ß', 'ss')"


_COUNT = "len(list_filter(entities, lambda e: e.label IN (%s)))"
_WANT_CITY = f"CASE WHEN coalesce(sample_source, '') = 'multi_city' THEN len(list_filter(string_split(coalesce(name, ''), ','), lambda p: {_strip('p')} <> '')) ELSE 1 END"
_WANT_REGION, _WANT_COUNTRY = "(coalesce(sample_source, '') IN ('city_admin1', 'city_admin1_country'))::INT", "(coalesce(sample_source, '') IN ('city_country', 'city_admin1_country'))::INT"
_REASON = f"""CASE WHEN len(list_filter(entities, lambda e: NOT contains(query, e.text))) > 0 THEN 'span not found verbatim in query: [' || array_to_string(list_transform(list_filter(entities, lambda e: NOT contains(query, e.text)), lambda e: {_quoted('e.text')}), ', ') || ']'
  WHEN {_COUNT % "'CITY'"} <> {_WANT_CITY} THEN 'expected ' || {_WANT_CITY} || ' CITY span(s), got ' || {_COUNT % "'CITY'"}
  WHEN {_COUNT % "'REGION', 'STATE'"} <> {_WANT_REGION} THEN 'expected ' || {_WANT_REGION} || ' admin1 span(s), got ' || {_COUNT % "'REGION', 'STATE'"}
  WHEN {_COUNT % "'COUNTRY'"} <> {_WANT_COUNTRY} THEN 'expected ' || {_WANT_COUNTRY} || ' COUNTRY span(s), got ' || {_COUNT % "'COUNTRY'"}
  WHEN {_fold(_strip("query"))} = {_fold(_strip("coalesce(name, '')"))} THEN 'query is the bare name' ELSE '' END"""


# Columns of dump lines in SQL: text kept as it is, text with empty as null, and typed ones with the form of their values.
_INT, _NUM, _DAY = "-?[0-9]+", r"-?[0-9]+(\.[0-9]+)?", "[0-9]{4}-[0-9]{2}-[0-9]{2}"
_PLACE_LINE = [
    ("geonameid", _INT, "BIGINT"), ("name", None, ""), ("asciiname", None, ""), ("alternatenames", None, ""), ("latitude", _NUM, "DOUBLE"), ("longitude", _NUM, "DOUBLE"), ("feature_class", "", ""), ("feature_code", "", ""), ("country_code", "", ""), ("cc2", "", ""),
    ("admin1_code", "", ""), ("admin2_code", "", ""), ("admin3_code", "", ""), ("admin4_code", "", ""), ("population", _INT, "DECIMAL(38,0)"), ("elevation", _INT, "BIGINT"), ("dem", _INT, "BIGINT"), ("timezone", "", ""), ("modification_date", _DAY, "DATE"),
]
_NAME_LINE = [("alternate_name_id", _INT, "BIGINT"), ("geonameid", _INT, "BIGINT"), ("isolanguage", "", ""), ("alternate_name", None, ""), *[(f, "flag", "") for f in ("is_preferred_name", "is_short_name", "is_colloquial", "is_historic")], ("from_period", "", ""), ("to_period", "", "")]


def _typed(columns: list[tuple[str, str | None, str]], kind: str) -> str:
    out, left = [], []
    for i, (n, form, type_) in enumerate(columns, 1):
        v = f"c[{i}]"
        if type_:
            cast = f"CASE WHEN regexp_full_match({v}, '{form}') THEN TRY_CAST({v} AS {type_}) END"
            left.append((n, f"CASE WHEN {v} <> '' AND {cast} IS NULL THEN '{n}=' || {v} END"))
            v = f"CASE WHEN {v} = '' THEN 0 ELSE {cast} END" if n == "population" else cast
        elif form == "flag":
            v = f"{v} = '1'"
        elif form == "":
            v = f"nullif({v}, '')"
        out.append(f"{v} AS {n}")
    return f"SELECT line_id, {', '.join(out)}, concat_ws('|', {', '.join(x for _, x in sorted(left))}) AS unparsed FROM judged WHERE reason IS NULL AND kind = '{kind}'"


SQL: dict[str, str] = {
    "p6_found": _with("lines cut judged", "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"),
    "scope_filter": _with("places scope", "SELECT geonameid, country_code, feature_code FROM scope"),
    "dedupe_last": _with("places", "SELECT geonameid, name, population FROM places"),
    "dedupe_first": "SELECT geonameid, population FROM (SELECT *, row_number() OVER (PARTITION BY geonameid ORDER BY loaded_at NULLS LAST, modification_date NULLS LAST, population NULLS LAST) AS rn FROM geonames) WHERE rn = 1",
    "upsert_keep_last": _with("places base lines cut judged new_places", "SELECT * FROM base WHERE geonameid NOT IN (SELECT geonameid FROM new_places) UNION ALL SELECT * EXCLUDE (rn) FROM new_places"),
    "apply_deletes": _with("places", "SELECT geonameid, feature_class FROM places WHERE geonameid NOT IN (SELECT geonameid FROM places WHERE feature_class <> 'P')"),
    "cascade_orphans": _with("places alternates scope", "SELECT alternate_name_id, geonameid FROM alternates a WHERE EXISTS (SELECT 1 FROM scope s WHERE s.geonameid = a.geonameid)"),
    "apply_delta": _with("places lines cut judged new_places left_places delta_places", "SELECT geonameid, name, population FROM delta_places"),
    "apply_delta_names": _with("places alternates lines cut judged new_places left_places delta_places new_names delta_names", "SELECT * FROM delta_names"),
    "name_rows": _with(_BASE, "SELECT geonameid, country_code, admin1_code, population, asciiname, name, isolanguage FROM rows"),
    "name_groups": _with(_BASE, "SELECT name, count(*) AS n, string_agg(geonameid || ':' || population, ',' ORDER BY geonameid, population) AS places FROM (SELECT DISTINCT name, geonameid, coalesce(population, 0) AS population FROM rows) GROUP BY name"),
    "places_projection": _with("places scope", "SELECT geonameid, asciiname, country_code, population, feature_code, latitude, longitude FROM scope"),
    "admin1_names": _with("places scope", "SELECT s.geonameid, coalesce(a.admin1_name, '') AS admin1_name FROM scope s LEFT JOIN admin1 a ON s.country_code = a.country_code AND s.admin1_code = a.admin1_code"),
    "descriptions": _with(_BASE, _DESCRIBED % "rows"),
    "hydrate_semi": _with("places scope", "SELECT geonameid, asciiname, population FROM scope s WHERE EXISTS (SELECT 1 FROM geoname_matches m WHERE m.geonameid = s.geonameid)"),
    "coverage_check": _with(_BASE, "SELECT count(*) AS missing FROM (SELECT DISTINCT geonameid FROM rows) r WHERE NOT EXISTS (SELECT 1 FROM scope s WHERE s.geonameid = r.geonameid)"),
    "char_ngrams": _with(f"{_BASE} names docs", "SELECT term, count(*) AS n FROM (SELECT unnest(g) AS term FROM docs) GROUP BY term"),
    "ngram_df": _with(f"{_BASE} names docs postings", "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM postings GROUP BY term"),
    "doc_stats": _with(f"{_BASE} names docs", "SELECT doc, CAST(dl AS BIGINT) AS dl FROM docs"),
    "bm25_scores": _with(f"{_BASE} names docs postings requests texts asked scores", "SELECT q, doc, round(score, 6) AS score FROM scores"),
    "bm25_top_names": _with(f"{_BASE} names docs postings requests texts asked scores found filled top", "SELECT q, doc, round(score, 6) AS score, rank FROM top"),
    "search_topk": _with(f"{_BASE} names docs postings requests texts asked scores found filled top results", "SELECT q, rank, geonameid, asciiname, country_code, population, round(score, 6) AS score FROM results"),
    "rerank_topk": _with(f"{_BASE} names docs postings requests texts asked scores found filled top results", "SELECT q, row_number() OVER (PARTITION BY q ORDER BY floor(score) DESC, coalesce(population, 0) DESC, geonameid) AS rank, geonameid FROM results"),
    "search_documents": _with(
        f"{_BASE} names docs postings requests texts asked scores found filled top results",
        f"""SELECT q, rank, geonameid, coalesce(description, '') AS document FROM results LEFT JOIN ({_DESCRIBED % "(SELECT * FROM rows WHERE population > 0)"}) USING (geonameid)""",
    ),
    "place_groups": _with(f"{_BASE} groups", "SELECT name, isolanguage, country_code, admin1_code, array_to_string(ids, ',') AS ids, admin1_name, max_population, region_repeats_city FROM groups"),
    "name_gold": _with(_BASE, "SELECT name, isolanguage, string_agg(geonameid::VARCHAR, ',' ORDER BY geonameid) AS ids FROM rows GROUP BY 1, 2"),
    "name_pools": _with(f"{_BASE} groups pools", "SELECT * FROM pools"),
    "country_targets": _with(_BASE, "SELECT name, isolanguage, country_code, string_agg(geonameid::VARCHAR, ',' ORDER BY geonameid) AS ids, max(population) AS max_population FROM rows GROUP BY 1, 2, 3"),
    "pool_unique": _with(f"{_BASE} groups pools", "SELECT name, isolanguage, country_code FROM pools WHERE n_countries = 1 AND n_admin1_in_country = 1"),
    "pool_homonym": _with(f"{_BASE} groups pools", "SELECT name, isolanguage, country_code, n_admin1_in_country FROM pools WHERE n_admin1_in_country > 1"),
    "stratified_sample": _with(
        f"{_BASE} groups pools",
        f"""SELECT name, isolanguage, country_code, CASE WHEN rn <= 2 THEN 'top' WHEN mid AND k <= 2 THEN 'mid' ELSE 'low' END AS strat_band FROM (
          SELECT *, row_number() OVER (PARTITION BY isolanguage, country_code, mid ORDER BY dr, name) AS k FROM (
            SELECT *, rn > 2 AND rn <= n - 2 AS mid, CASE WHEN rn > 2 AND rn <= n - 2 THEN {_draw("'42'", "name", "isolanguage", "country_code")} END AS dr FROM (
              SELECT *, row_number() OVER (PARTITION BY isolanguage, country_code ORDER BY pop_in_country DESC NULLS LAST, name) AS rn, count(*) OVER (PARTITION BY isolanguage, country_code) AS n FROM pools)))
          WHERE rn <= 2 OR (mid AND k <= 2) OR rn > n - 2""",
    ),
    "expand_targets": _with(
        f"{_BASE} groups pools",
        """SELECT name, isolanguage, country_code, admin1_code, array_to_string(ids, ',') AS ids FROM (
          SELECT *, row_number() OVER (PARTITION BY name, isolanguage ORDER BY max_population DESC NULLS LAST, country_code, admin1_code) AS t FROM (
            SELECT g.*, row_number() OVER (PARTITION BY g.name, g.isolanguage, g.country_code ORDER BY g.max_population DESC NULLS LAST, g.admin1_code) AS c FROM groups g
            WHERE NOT g.region_repeats_city AND EXISTS (SELECT 1 FROM pools p WHERE p.name = g.name AND p.isolanguage = g.isolanguage AND p.n_countries > 1 AND p.has_valid_region)) WHERE c = 1) WHERE t <= 2""",
    ),
    "plan_counts": "SELECT sample_source, pool, group_language, group_country, count(*) AS n FROM query_plan GROUP BY 1, 2, 3, 4",
    "limit_per_source": "SELECT request_id, sample_source FROM (SELECT *, row_number() OVER (PARTITION BY sample_source ORDER BY request_id) AS rn FROM (SELECT DISTINCT request_id, sample_source FROM query_plan)) WHERE rn <= 100",
    "style_topic": f"""SELECT request_id, CASE WHEN s < 0.6::DOUBLE THEN 'search' WHEN s < 0.85::DOUBLE THEN 'casual' WHEN s < 0.97::DOUBLE THEN 'formal' ELSE 'rich' END AS style,
        ['flights', 'hotels', 'weather', 'transport', 'food', 'tourism', 'history', 'population', 'relocation', 'news', 'education'][least(CAST(floor(t * 11) AS BIGINT) + 1, 11)] AS topic
      FROM (SELECT request_id, {_draw("'42'", "'style'", "request_id::VARCHAR")} AS s, {_draw("'42'", "'topic'", "request_id::VARCHAR")} AS t FROM (SELECT DISTINCT request_id FROM query_plan))""",
    "plan_provenance": _with("requests", "SELECT r.request_id, r.sample_source, p.strat_band, p.group_country FROM requests r JOIN (SELECT request_id, min(strat_band) AS strat_band, min(group_country) AS group_country FROM query_plan GROUP BY 1) p USING (request_id)"),
    "request_messages": """SELECT request_id, CASE WHEN sample_source IN ('one_city', 'multi_city', 'city_admin1', 'city_country', 'city_admin1_country') THEN
        'language: ' || coalesce(isolanguage, '') || chr(10) || CASE WHEN sample_source = 'multi_city' THEN 'names: ' ELSE 'name: ' END || coalesce(name, '')
        || CASE WHEN sample_source IN ('city_admin1', 'city_admin1_country') THEN chr(10) || 'region: ' || coalesce(admin1_name, '') ELSE '' END
        || CASE WHEN sample_source IN ('city_country', 'city_admin1_country') THEN chr(10) || 'country: ' || coalesce(country_name, '') ELSE '' END
        || chr(10) || 'style: ' || coalesce(style, '') || chr(10) || 'topic: ' || coalesce(topic, '') END AS message FROM query_plan""",
    "result_table": _with("places scope", "SELECT geonameid, CASE WHEN regexp_full_match(upper(country_code), '[A-Z]{2}') THEN chr(127397 + ascii(substring(upper(country_code), 1, 1))) || chr(127397 + ascii(substring(upper(country_code), 2, 1))) ELSE '' END AS flag, floor(latitude * 10000 + 0.5) / 10000 AS latitude, floor(longitude * 10000 + 0.5) / 10000 AS longitude, greatest(coalesce(population, 0), 1) AS size FROM scope"),
    "validate_rows": _with("requests", f"SELECT request_id, reason = '' AS valid, reason AS invalid_reason FROM (SELECT request_id, {_REASON} AS reason FROM requests)"),
    "checkpoint_latest": f"""SELECT request_id, query, {_bucket_sql("gold_")} FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY generated_at DESC NULLS LAST, attempts DESC NULLS LAST, query DESC NULLS LAST) AS rn FROM query_dataset WHERE prompt_version = (SELECT max(prompt_version) FROM query_dataset))
      WHERE rn = 1 AND ({_REASON}) = ''""",
    "entity_buckets": _with("requests", f"SELECT request_id, {_bucket_sql()} FROM requests"),
    "json_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "done_ids": "SELECT DISTINCT request_id FROM query_dataset WHERE prompt_version = (SELECT max(prompt_version) FROM query_dataset)",
    "confidence_stats": _with("requests", "SELECT language, count(confidence) AS n, min(confidence) AS least, round(median(confidence), 6) AS median, round(avg(confidence), 6) AS mean, count(CASE WHEN confidence < 0.8 THEN 1 END) AS below FROM requests GROUP BY 1"),
    "cjk_tokenize": f"SELECT doc_id, coalesce(array_to_string(regexp_extract_all(text, '{_TOKEN}'), ' '), '') AS tokens FROM documents",
    "label_counts": _with("requests gold", "SELECT language, label, count(*) AS n FROM gold GROUP BY 1, 2"),
    # the greedy fill as a fold: running totals of the rows taken, in the order of the digests
    "split_by_name": _with(
        "requests",
        """SELECT r.request_id, r.language, r.name, CASE WHEN s.name IS NULL THEN 'train' ELSE 'validation' END AS split FROM requests r LEFT JOIN (
          SELECT unnest(list_filter(list_transform(ns, lambda x, i: CASE WHEN upto[i + 1] > upto[i] THEN x END), lambda x: x IS NOT NULL)) AS name FROM (
            SELECT list(f.name ORDER BY f.d) AS ns, list_reduce(list_prepend([0]::BIGINT[], list([f.n]::BIGINT[] ORDER BY f.d)), lambda acc, x: list_append(acc, acc[-1] + CASE WHEN acc[-1] + x[1] <= 0.1::DOUBLE * any_value(t.total) THEN x[1] ELSE 0 END)) AS upto
            FROM (SELECT name, language, n, md5(concat_ws('|', '42', language, name)) || '|' || name AS d FROM (
                SELECT name, language, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY language) AS k FROM requests WHERE name IS NOT NULL AND language IS NOT NULL GROUP BY 1, 2) WHERE k = 1) f
            JOIN (SELECT language, count(*) AS total FROM requests WHERE name IS NOT NULL AND language IS NOT NULL GROUP BY 1) t USING (language) GROUP BY f.language)) s USING (name)
        WHERE r.name IS NOT NULL AND r.language IS NOT NULL""",
    ),
    "span_prf": _with(
        "requests gold guess spans",
        f"""SELECT bucket, tp, fp, fn, {_RATES} FROM (SELECT bucket, {_COUNTS} FROM (
            SELECT 'overall' AS bucket, g, p FROM spans UNION ALL SELECT 'lang:' || coalesce(language, ''), g, p FROM spans UNION ALL SELECT 'label:' || label, g, p FROM spans WHERE label IN ('CITY', 'REGION', 'STATE', 'COUNTRY')
            UNION ALL SELECT 'label:' || l, 0, 0 FROM (SELECT unnest(['CITY', 'REGION', 'STATE', 'COUNTRY']) AS l)) GROUP BY bucket)""",
    ),
    "threshold_sweep": _with(
        "requests gold guess spans",
        f"""SELECT printf('%.2f', t) AS threshold, tp, fp, fn, {_RATES} FROM (SELECT t, {_COUNTS} FROM (
            SELECT t, g, coalesce(score >= t, false)::INT AS p FROM spans CROSS JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS t)) GROUP BY t)""",
    ),
    "span_errors": _with("requests gold guess spans", "SELECT request_id, coalesce(string_agg(CASE WHEN g = 1 THEN s || ':' || e2 || ':' || label END, ' ' ORDER BY s || ':' || e2 || ':' || label), '') AS missed, coalesce(string_agg(CASE WHEN p = 1 THEN s || ':' || e2 || ':' || label END, ' ' ORDER BY s || ':' || e2 || ':' || label), '') AS wrong FROM spans WHERE g <> p GROUP BY 1"),
    "rank_pairs": _with("matched run requests", "SELECT r.request_id, r.geonameid, r.rank, coalesce(list_contains(q.geonameid, r.geonameid), false)::INT AS label FROM run r JOIN requests q USING (request_id)"),
    "log_population": _with("places scope", "SELECT geonameid, round(ln(1 + greatest(coalesce(population, 0), 0)::DOUBLE), 6) AS log_population FROM scope"),
    "split_by_query": _with("requests", f"SELECT request_id, CASE WHEN {_draw(chr(39) + '42' + chr(39), 'query')} < 0.2::DOUBLE THEN 'test' ELSE 'train' END AS split FROM requests"),
    "ir_metrics": _with("requests qrels matched run", _IR % "run"),
    "oracle_run": _with("requests qrels matched run ideal", _IR % "ideal"),
    "empty_accuracy": _with("requests matched run", "SELECT count(*) AS queries, coalesce(round(avg((m.request_id IS NULL)::DOUBLE), 4), 0) AS accuracy FROM (SELECT DISTINCT request_id FROM query_plan) q LEFT JOIN requests r ON r.request_id = q.request_id LEFT JOIN (SELECT DISTINCT request_id FROM run) m ON m.request_id = q.request_id WHERE coalesce(len(r.geonameid), 0) = 0"),
    "latency_percentiles": "SELECT event_type, n, "
    + ", ".join(f"round(v[floor(a{p})::BIGINT] + (v[least(floor(a{p})::BIGINT + 1, n)] - v[floor(a{p})::BIGINT]) * (a{p} - floor(a{p})), 6) AS p{p}" for p in (50, 90, 95, 99))
    + ", v[1] AS least, v[n] AS most FROM (SELECT *, "
    + ", ".join(f"greatest(1.0::DOUBLE, least(n::DOUBLE, (n + 1) * {p} / 100.0::DOUBLE)) AS a{p}" for p in (50, 90, 95, 99))
    + " FROM (SELECT event_type, list(value ORDER BY value) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1))",
    "p6_places": _with("lines cut judged", _typed(_PLACE_LINE, "place")),
    "p6_names": _with("lines cut judged", _typed(_NAME_LINE, "name")),
    "evaluation_report": _with("requests qrels matched run ideal peopled", " UNION ALL ".join(f"SELECT '{n}' AS system, * FROM ({_IR % t})" for n, t in (("baseline", "run"), ("population", "peopled"), ("ideal", "ideal")))),
    "first_seen_queries": _with("requests", "SELECT query, min(request_id) AS request_id FROM requests GROUP BY 1"),
    "distinct_names": "SELECT sample_source, count(DISTINCT struct_pack(n := coalesce('=' || name, ''), l := coalesce('=' || isolanguage, ''))) AS n FROM query_plan GROUP BY 1",
    "usage_stats": _with("requests", "SELECT sample_source, count(*) AS rows, count(CASE WHEN attempts = 1 THEN 1 END) AS hits, round(count(CASE WHEN attempts = 1 THEN 1 END) / count(*)::DOUBLE, 4) AS hit_rate, CAST(coalesce(sum(attempts), 0) AS BIGINT) AS spent, CAST(coalesce(max(attempts), 0) AS BIGINT) AS peak FROM requests GROUP BY 1"),
    "align_span": _with("requests toks words spans_at aligned", "SELECT request_id, pos, first, last FROM aligned"),
    "ner_examples": _with(
        "requests toks words spans_at aligned",
        """SELECT request_id, t.tokens, a.ner FROM (
          SELECT request_id, string_agg(first || ':' || last || ':' || en.label, ',' ORDER BY pos) AS ner FROM aligned GROUP BY 1 HAVING bool_and(first IS NOT NULL AND substring(query, en.start + 1, en.end - en.start) = en.text)) a
        JOIN (SELECT request_id, count(*) AS tokens FROM words GROUP BY 1) t USING (request_id)""",
    ),
    # each text is looked up behind the one before, else anywhere; one text that is nowhere makes the whole null
    "locate_spans": "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTE[n]})" for n in ("requests",)) + """,
      walk AS (SELECT request_id, query, list_transform(entities, lambda e: e.text) AS texts, 0 AS i, 0::BIGINT AS behind, true AS ok, '' AS spans FROM requests
        UNION ALL SELECT request_id, query, texts, i + 1, p + length(texts[i + 1]), ok AND p >= 0, spans || CASE WHEN i > 0 THEN ',' ELSE '' END || p || '-' || (p + length(texts[i + 1])) FROM (
          SELECT *, CASE WHEN strpos(substring(query, behind + 1), texts[i + 1]) > 0 THEN behind + strpos(substring(query, behind + 1), texts[i + 1]) - 1 ELSE strpos(query, texts[i + 1]) - 1 END AS p FROM walk WHERE i < len(texts)))
      SELECT request_id, CASE WHEN ok THEN spans END AS spans FROM walk WHERE i = len(texts)""",
    "highlight_segments": _with(
        "requests spans_at",
        """SELECT r.request_id, CASE WHEN p.parts IS NULL THEN r.query || '/-' ELSE p.parts || CASE WHEN p.upto < length(r.query) THEN '|' || substring(r.query, p.upto + 1) || '/-' ELSE '' END END AS segments FROM requests r LEFT JOIN (
          SELECT request_id, string_agg(CASE WHEN s > before THEN substring(query, before + 1, s - before) || '/-|' ELSE '' END || substring(query, s + 1, e - s) || '/' || coalesce(l, '-'), '|' ORDER BY k) AS parts, max_by(e, k) AS upto FROM (
            SELECT request_id, query, en.start AS s, en.end AS e, en.label AS l, row_number() OVER w AS k, coalesce(lag(en.end) OVER w, 0) AS before FROM spans_at WINDOW w AS (PARTITION BY request_id ORDER BY en.start, en.end, en.label)) GROUP BY 1) p USING (request_id)""",
    ),
    # the longest name at the first place where one begins, then on behind it
    "gazetteer_spans": "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTE[n]})" for n in "places alternates scope rows requests toks words".split()) + """,
      known AS (SELECT DISTINCT lower(name) AS name FROM rows),
      hits AS (SELECT request_id, s, max(e) AS e FROM (SELECT a.request_id, a.s, b.e FROM words a JOIN words b ON a.request_id = b.request_id AND b.at >= a.at JOIN requests r ON r.request_id = a.request_id
        WHERE lower(substring(r.query, a.s + 1, b.e - a.s)) IN (SELECT name FROM known)) GROUP BY 1, 2),
      walk AS (SELECT request_id, min_by(s, s) AS s, min_by(e, s) AS e FROM hits GROUP BY 1
        UNION ALL SELECT request_id, s, e FROM (SELECT h.request_id, h.s, h.e, row_number() OVER (PARTITION BY h.request_id ORDER BY h.s) AS k FROM walk w JOIN hits h ON h.request_id = w.request_id AND h.s >= w.e) WHERE k = 1)
      SELECT request_id, s AS "start", e AS "end", 'CITY' AS label FROM walk""",
    "generate_dataset": _with(
        "requests",
        f"""SELECT request_id, least(attempts, 3) AS attempts, reason = '' AND attempts <= 3 AS valid, CASE WHEN attempts <= 3 THEN {_strip("query")} ELSE '' END AS query FROM (
          SELECT request_id, query, CASE WHEN ({_REASON}) = '' THEN attempts ELSE greatest(attempts, 3) END AS attempts, ({_REASON}) AS reason FROM (
            SELECT r.* REPLACE (p.name AS name, p.sample_source AS sample_source) FROM requests r JOIN (SELECT request_id, min(name) AS name, min(sample_source) AS sample_source FROM query_plan GROUP BY 1) p USING (request_id) WHERE r.request_id % 10 <> 1))""",
    ),
}
