"""The expected result of every query as SQL over the driver's views.

Written on its own terms: window ranking instead of ``max_by``, a plain theta join for matching, JSON
functions and ordered string aggregation for replies.
"""

from __future__ import annotations

from checks import inputs
from venuematch.operators.prompts import SYSTEM_TEMPLATE

TABLES = {name: name for name in ["orders", "customer", "nation"]}
PLACE_TABLES = {name: name for name in inputs.PLACE_TABLES}


def alias(key: str, fallback: str) -> str:
    return f"""CASE {key} WHEN 'bengaluru' THEN 'Bangalore' WHEN 'bangalore' THEN 'Bangalore'
      WHEN 'new delhi' THEN 'Delhi' WHEN 'delhi' THEN 'Delhi' WHEN 'gurugram' THEN 'Gurgaon'
      WHEN 'gurgaon' THEN 'Gurgaon' WHEN 'bombay' THEN 'Mumbai' WHEN 'mumbai' THEN 'Mumbai' ELSE {fallback} END"""


def title(text: str) -> str:
    return f"""array_to_string(list_transform(regexp_extract_all({text}, '[A-Za-z]+|[^A-Za-z]+'),
      lambda w: upper(w[1]) || lower(w[2:])), '')"""


CITY = """CASE WHEN contains(lower(address), 'new delhi') THEN 'Delhi'
    WHEN contains(lower(address), 'bangalore') THEN 'Bangalore' WHEN contains(lower(address), 'bengaluru') THEN 'Bangalore'
    WHEN contains(lower(address), 'hyderabad') THEN 'Hyderabad' WHEN contains(lower(address), 'gurugram') THEN 'Gurgaon'
    WHEN contains(lower(address), 'chennai') THEN 'Chennai' WHEN contains(lower(address), 'kolkata') THEN 'Kolkata'
    WHEN contains(lower(address), 'gurgaon') THEN 'Gurgaon' WHEN contains(lower(address), 'mumbai') THEN 'Mumbai'
    WHEN contains(lower(address), 'noida') THEN 'Noida' WHEN contains(lower(address), 'pune') THEN 'Pune' END"""

# Named steps; each may read the ones before it.
STEPS = {
    "raw": inputs.for_oracle(inputs.LISTINGS, **TABLES),
    "parsed": f"""SELECT row_index, trim(name, ' ' || chr(9) || chr(160)) AS name, coalesce(trim(location), '') AS area, {CITY} AS found_city,
      CASE WHEN cuisines IS NULL OR trim(cuisines) = '' THEN 'unknown' ELSE lower(trim(cuisines)) END AS cuisine,
      TRY_CAST(regexp_extract(rate, '([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS rating_number,
      CAST(CASE WHEN TRY_CAST(regexp_replace("approx_cost(for two people)", '[^0-9]', '', 'g') AS BIGINT) <= 100000
        THEN TRY_CAST(regexp_replace("approx_cost(for two people)", '[^0-9]', '', 'g') AS BIGINT) END AS INTEGER) AS cost_for_two
      FROM raw""",
    "annotated": """SELECT row_index, name, coalesce(found_city, 'Bangalore') AS city, found_city IS NULL AS city_defaulted,
      CASE WHEN area = '' THEN coalesce(found_city, 'Bangalore') ELSE area END AS location, cuisine,
      CASE WHEN rating_number <= 5 THEN round(rating_number, 2) WHEN rating_number <= 10 THEN round(rating_number / 2, 2) END AS rating,
      cost_for_two,
      CASE WHEN cost_for_two IS NULL OR cost_for_two <= 0 THEN 'unknown' WHEN cost_for_two <= 500 THEN 'low'
        WHEN cost_for_two <= 1500 THEN 'medium' ELSE 'high' END AS budget_band FROM parsed""",
    "clean": """SELECT row_index, substr(sha256(name || '|' || city || '|' || location || '|' || row_index), 1, 16) AS id,
      name, location, city, cuisine, rating, cost_for_two, budget_band FROM annotated WHERE name <> ''""",
    "catalog": """SELECT id, name, location, city, cuisine, rating, cost_for_two, budget_band, first_index FROM (
        SELECT *, row_number() OVER (PARTITION BY lower(name), lower(city), lower(location)
            ORDER BY coalesce(rating, 0) DESC, row_index) AS rn,
          min(row_index) OVER (PARTITION BY lower(name), lower(city), lower(location)) AS first_index
        FROM clean) ranked WHERE rn = 1""",
    "prefs": inputs.for_oracle(inputs.PREFERENCES, **TABLES),
    "checked": f"""SELECT pref_id, nullif(trim(location), '') AS location, budget, nullif(trim(cuisine), '') AS cuisine,
      coalesce(min_rating, 0) AS min_rating, substr(nullif(trim(additional_preferences), ''), 1, 500) AS additional_preferences,
      {alias("lower(trim(location))", title("nullif(trim(location), '')"))} AS normalized_location,
      array_to_string(list_filter([
        CASE WHEN trim(coalesce(location, '')) = '' THEN 'location_blank' END,
        CASE WHEN budget NOT IN ('low', 'medium', 'high') THEN 'budget_invalid' END,
        CASE WHEN trim(coalesce(cuisine, '')) = '' THEN 'cuisine_blank' END,
        CASE WHEN coalesce(min_rating, 0) NOT BETWEEN 0 AND 5 THEN 'min_rating_out_of_range' END],
        lambda e: e IS NOT NULL), ',') AS errors FROM prefs""",
    "valid": """SELECT *, lower(normalized_location) AS target,
      CASE WHEN lower(cuisine) IN ('any', '*', 'all') THEN '' ELSE lower(cuisine) END AS needle
      FROM checked WHERE errors = ''""",
    "pairs": """SELECT p.pref_id, c.*, p.needle = '' OR contains(lower(c.cuisine), p.needle) AS has_cuisine,
        p.min_rating <= 0 OR coalesce(c.rating >= p.min_rating, false) AS is_rated,
        c.budget_band <> 'unknown' AND c.budget_band = p.budget AS in_budget
      FROM valid p JOIN catalog c ON lower(c.city) = p.target OR contains(lower(c.location), p.target)""",
    "counted": """SELECT v.*, (SELECT count(*) FROM catalog) AS candidates_considered,
        coalesce(after_location, 0) AS after_location, coalesce(after_cuisine, 0) AS after_cuisine,
        coalesce(after_rating, 0) AS after_rating, coalesce(after_budget, 0) AS after_budget,
        least(coalesce(after_budget, 0), 30) AS returned
      FROM valid v LEFT JOIN (SELECT pref_id, count(*) AS after_location, count(*) FILTER (has_cuisine) AS after_cuisine,
        count(*) FILTER (has_cuisine AND is_rated) AS after_rating,
        count(*) FILTER (has_cuisine AND is_rated AND in_budget) AS after_budget
      FROM pairs GROUP BY pref_id) n USING (pref_id)""",
    "ranked": """SELECT * FROM (SELECT pref_id, CAST(row_number() OVER (PARTITION BY pref_id
          ORDER BY coalesce(rating, -1) DESC, lower(name), id) AS INTEGER) AS position,
        id, name, location, city, cuisine, rating, cost_for_two, budget_band
      FROM pairs WHERE has_cuisine AND is_rated AND in_budget) r WHERE position <= 30""",
    "responses": inputs.for_oracle(inputs.RESPONSES, candidates="ranked"),
    "unfenced": """SELECT *, trim(regexp_replace(regexp_replace(trim(raw_response), '^```[a-zA-Z]*\\s*', ''), '\\s*```$', '')) AS body
      FROM responses""",
    # Bare numbers that JSON lacks, as texts that no reply holds.
    "readable": r"""SELECT * EXCLUDE (body), regexp_replace(regexp_replace(body, '([:,\[])NaN', '\1"~nan"', 'g'),
        '([:,\[])(-?)Infinity', '\1"~\2inf"', 'g') AS body FROM unfenced""",
    "documents_in": "SELECT *, TRY_CAST(CASE WHEN json_valid(body) AND NOT contains(body, ':-NaN') THEN body END AS JSON) AS doc FROM readable",
    "parsed_replies": """SELECT *, CASE WHEN doc IS NULL THEN 'not_json' WHEN json_type(doc) <> 'OBJECT' THEN 'not_object'
        WHEN coalesce(json_type(doc, '$.recommendations'), '') <> 'ARRAY' THEN 'no_list' END AS parse_error,
      CASE WHEN json_type(doc, '$.summary') = 'VARCHAR' THEN nullif(trim(CASE WHEN starts_with(doc->>'$.summary', '~') THEN '' ELSE doc->>'$.summary' END), '') END AS summary
      FROM documents_in""",
    "listed": """SELECT pref_id, CAST(idx AS INTEGER) AS item_position, json_extract(doc, '$.recommendations[' || idx || ']') AS item
      FROM (SELECT pref_id, doc, unnest(range(CAST(json_array_length(doc, '$.recommendations') AS BIGINT))) AS idx
        FROM parsed_replies WHERE parse_error IS NULL) u""",
    "items": """SELECT pref_id, item_position, CASE WHEN json_type(item, '$.id') IN ('ARRAY', 'OBJECT')
        THEN replace(replace(replace(replace(replace(CAST(item->'$.id' AS VARCHAR), '"', chr(39)), 'true', 'True'), 'null', 'None'),
          ':', ': '), ',', ', ') ELSE ltrim(trim(item->>'$.id'), '~') END AS id,
      coalesce(CASE json_type(item, '$.rank') WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(item->>'$.rank'), '[+-]?[0-9]+')
          THEN TRY_CAST(trim(item->>'$.rank') AS BIGINT) END
        WHEN 'BOOLEAN' THEN CASE WHEN item->>'$.rank' = 'true' THEN 1 ELSE 0 END
        ELSE CAST(trunc(TRY_CAST(item->>'$.rank' AS DOUBLE)) AS BIGINT) END, 9999) AS rank,
      CASE WHEN json_type(item, '$.explanation') = 'VARCHAR' AND trim(item->>'$.explanation') <> ''
        THEN trim(item->>'$.explanation') ELSE 'Recommended based on your preferences.' END AS explanation
      FROM listed WHERE json_type(item) = 'OBJECT' AND coalesce(json_type(item, '$.id'), 'NULL') <> 'NULL'""",
    "resolved": """SELECT i.pref_id, i.item_position, i.id, i.rank AS reply_rank, i.explanation, r.name, r.location, r.city, r.cuisine,
      r.rating, r.cost_for_two, r.budget_band, r.id IS NOT NULL AS is_known
      FROM items i LEFT JOIN ranked r ON i.pref_id = r.pref_id AND i.id = r.id""",
    "reranked": """SELECT *, CAST(row_number() OVER (PARTITION BY pref_id ORDER BY reply_rank, id, item_position) AS INTEGER) AS rank
      FROM resolved WHERE is_known""",
    "reply_state": """SELECT p.pref_id, p.raw_response, p.error_type, p.error_message, p.latency_ms, p.summary, p.parse_error,
        coalesce(k.n_known, 0) AS n_known, coalesce(u.warnings, '') AS warnings,
        CASE WHEN p.error_type IN ('LLMTimeoutError', 'LLMRateLimitError', 'LLMConfigurationError', 'LLMAPIError') THEN p.error_type
          WHEN p.error_type IS NOT NULL THEN 'Exception' WHEN p.parse_error IS NOT NULL OR k.n_known IS NULL THEN 'LLMParseError'
          WHEN k.lowest < 1 THEN 'Exception' END AS error
      FROM parsed_replies p
      LEFT JOIN (SELECT pref_id, count(*) AS n_known, min(reply_rank) AS lowest FROM resolved WHERE is_known GROUP BY pref_id) k USING (pref_id)
      LEFT JOIN (SELECT pref_id, string_agg('Hallucinated candidate ID ''' || id || ''' dropped.', '|' ORDER BY item_position) AS warnings
        FROM resolved WHERE NOT is_known GROUP BY pref_id) u USING (pref_id)""",
    "reasons": """SELECT pref_id, CASE WHEN returned > 0 THEN NULL
        WHEN after_location = 0 THEN 'No restaurants found in ''' || normalized_location || '''. This dataset is primarily Bangalore-based.'
        WHEN after_rating = 0 THEN 'No restaurants found. Try a different location or lower your minimum rating.'
        ELSE 'No restaurants in your budget range. Try a different budget level.' END AS message FROM counted""",
    "answers": """SELECT c.*, s.error, s.summary AS reply_summary, s.n_known, s.warnings AS reply_warnings, s.latency_ms,
        CASE WHEN c.returned = 0 THEN 'empty' WHEN s.error IS NOT NULL THEN 'error' WHEN s.warnings <> '' THEN 'partial'
          ELSE 'success' END AS status,
        CASE WHEN c.returned = 0 THEN m.message
          WHEN s.error = 'LLMConfigurationError' THEN s.error_message
          WHEN s.error IN ('LLMTimeoutError', 'LLMAPIError') THEN 'Recommendations temporarily unavailable. Please try again.'
          WHEN s.error = 'LLMRateLimitError' THEN 'Service is busy. Please try again in a moment.'
          WHEN s.error = 'LLMParseError' THEN 'We couldn''t generate recommendations right now. Please try again.'
          WHEN s.error = 'Exception' THEN 'Something went wrong. Please try again.' END AS message,
        CASE WHEN s.error = 'Exception' THEN s.error_message END AS own_error
      FROM counted c JOIN reasons m USING (pref_id) LEFT JOIN reply_state s USING (pref_id)""",
}


def using(last: str, body: str) -> str:
    """``body`` after all steps up to and including ``last``."""
    names = list(STEPS)
    steps = names[: names.index(last) + 1]
    return "WITH " + ",\n".join(f"{name} AS ({STEPS[name]})" for name in steps) + "\n" + body


CARD = "id, name, location, city, cuisine, rating, cost_for_two, budget_band"
ONE = "(lower(city) = 'bangalore' OR contains(lower(location), 'bangalore'))"
ONE_STAGES = [ONE, "contains(cuisine, 'indian')", "coalesce(rating >= 3.5, false)", "budget_band = 'medium'"]
ONE_ALL = " AND ".join(ONE_STAGES)
QUALITY = """input_rows, rows_normalized, dropped_missing_name, rows_normalized - output_rows AS collapsed_duplicates,
      defaulted_city, output_rows, CASE WHEN input_rows = 0 THEN 0 ELSE rows_normalized / input_rows END AS success_rate
    FROM (SELECT count(*) AS input_rows, count(*) FILTER (name <> '') AS rows_normalized,
      count(*) FILTER (name = '') AS dropped_missing_name, count(*) FILTER (name <> '' AND city_defaulted) AS defaulted_city,
      count(DISTINCT CASE WHEN name <> '' THEN lower(name) || '|' || lower(city) || '|' || lower(location) END) AS output_rows
      FROM annotated) t"""

ONE_COUNTS = f"""count(*) AS candidates_considered,
        count(*) FILTER ({ONE_STAGES[0]}) AS after_location,
        count(*) FILTER ({" AND ".join(ONE_STAGES[:2])}) AS after_cuisine,
        count(*) FILTER ({" AND ".join(ONE_STAGES[:3])}) AS after_rating,
        count(*) FILTER ({ONE_ALL}) AS after_budget, least(count(*) FILTER ({ONE_ALL}), 30) AS returned"""

ORACLES = {
    # scans and sinks
    "scan_positions": "SELECT o_orderkey AS row_index, o_orderkey FROM orders",
    "text_positions": """SELECT 'csv' AS format, o_orderkey AS row_index, o_orderkey FROM orders
        UNION ALL SELECT 'json', o_orderkey, o_orderkey FROM orders""",
    "replaced_snapshot": using("catalog", f"SELECT {CARD}, (SELECT count(*) FROM catalog) AS n_stored FROM catalog"),
    "csv_export": using("catalog", f"SELECT {CARD} FROM catalog"),
    "parquet_export": using("catalog", f"SELECT {CARD} FROM catalog"),
    "json_sample": using("catalog", f"SELECT {CARD} FROM catalog ORDER BY first_index LIMIT 100"),
    "export_preview": using("catalog", """SELECT 'csv' AS format, count(*) AS n FROM catalog UNION ALL
        SELECT 'parquet', count(*) FROM catalog UNION ALL SELECT 'json', least(count(*), 100) FROM catalog"""),
    "merged_catalog": using("catalog", f"SELECT {CARD}, first_index AS position FROM catalog"),
    "merged_counters": using("annotated", f"SELECT {QUALITY}"),
    "snapshot": using("catalog", f"SELECT {CARD} FROM catalog"),
    "snapshot_stats": using("annotated", f"SELECT {QUALITY}"),
    "seed_repair": using("catalog", f"SELECT {CARD} FROM catalog"),
    "source_fallback": using("catalog", f"SELECT {CARD} FROM catalog"),
    "stale_exports": using("catalog", f"SELECT {CARD} FROM catalog"),
    # scalar projections
    "strip_text": using("raw", """SELECT row_index, trim(name, ' ' || chr(9) || chr(160)) AS name, trim(address) AS address, trim(location) AS location FROM raw"""),
    "parse_rating": using("annotated", "SELECT row_index, rating FROM annotated"),
    "parse_cost": using("annotated", "SELECT row_index, cost_for_two FROM annotated"),
    "extract_city": using("parsed", "SELECT row_index, found_city AS city FROM parsed"),
    "find_places": f"""WITH a AS ({inputs.for_oracle(inputs.ADDRESSES, **PLACE_TABLES)}), d AS ({inputs.for_oracle(inputs.PLACES, **PLACE_TABLES)})
        SELECT row_index, address, place FROM (SELECT row_index, address, place,
            row_number() OVER (PARTITION BY row_index ORDER BY length(name) DESC, position) AS rn
          FROM a LEFT JOIN d ON contains(lower(address), lower(name))) ranked WHERE rn = 1""",
    "alias_location": using("prefs", f"""SELECT pref_id,
        {alias("lower(trim(location))", title("trim(location)"))} AS normalized_location FROM prefs"""),
    "budget_band": using("annotated", "SELECT row_index, budget_band FROM annotated"),
    "normalize_cuisine": using("parsed", "SELECT row_index, cuisine FROM parsed"),
    "default_place": using("annotated", "SELECT row_index, city, location, city_defaulted FROM annotated"),
    "stable_id": using("clean", "SELECT row_index, id FROM clean"),
    "title_case": f"""SELECT p_partkey, {title("concat(p_name, '-', lower(p_type), '''s ', p_brand)")} AS titled FROM part""",
    "clean_listings": using("clean", f"SELECT row_index, {CARD} FROM clean"),
    "any_cuisine": using("prefs", """SELECT pref_id, lower(trim(cuisine)) IN ('any', '*', 'all') AS is_any FROM prefs"""),
    "free_text": using("checked", "SELECT pref_id, additional_preferences FROM checked"),
    "round_exact": """SELECT l_extendedprice / 8 AS price, CAST(format('{:.2f}', l_extendedprice / 8) AS DOUBLE) AS two_digits,
        CAST(format('{:.1f}', l_extendedprice / 8) AS DOUBLE) AS one_digit FROM lineitem""",
    # predicates
    "filter_location": using("catalog", """SELECT id, city, location FROM catalog
        WHERE lower(city) = 'nation_1' OR contains(lower(location), 'nation_1')"""),
    "filter_cuisine": using("catalog", "SELECT id, cuisine FROM catalog WHERE contains(cuisine, 'e, tex')"),
    "filter_min_rating": using("catalog", "SELECT id, rating FROM catalog WHERE rating >= 3.5"),
    "filter_no_rating_floor": using("catalog", "SELECT id, rating FROM catalog"),
    "filter_budget": using("catalog", "SELECT id, budget_band FROM catalog WHERE budget_band = 'medium'"),
    "city_lookup": using("catalog", f"SELECT {CARD} FROM catalog WHERE city = 'Gurgaon'"),
    "city_lookup_batch": using("checked", f"""SELECT {CARD} FROM catalog
        WHERE lower(city) IN (SELECT lower(normalized_location) FROM checked)"""),
    # catalog aggregates
    "dedupe_catalog": using("catalog", f"SELECT {CARD} FROM catalog"),
    "quality_counters": using("annotated", f"SELECT {QUALITY}"),
    "facet_locations": using("catalog", "SELECT DISTINCT location FROM catalog WHERE lower(city) = 'bangalore' AND location <> ''"),
    "facet_cuisines": using("catalog", f"""SELECT DISTINCT {title("trim(token)")} AS cuisine, false AS is_any
        FROM (SELECT unnest(string_split(cuisine, ',')) AS token FROM catalog) t UNION ALL SELECT 'Any', true"""),
    "facet_cities": using("catalog", "SELECT DISTINCT city FROM catalog"),
    "default_facet": using("catalog", """SELECT coalesce(max(CASE WHEN location = 'Indiranagar' THEN location END), min(location)) AS location
        FROM catalog WHERE lower(city) = 'bangalore' AND location <> ''"""),
    "catalog_count": using("catalog", "SELECT count(*) AS n FROM catalog"),
    "preview_rows": using("catalog", f"SELECT {CARD} FROM catalog WHERE city = 'Mumbai' ORDER BY first_index LIMIT 5"),
    "preview_lines": using("catalog", """SELECT id, name || ' | ' || cuisine || ' | ★' || coalesce(CAST(rating AS VARCHAR), 'N/A') || ' | ' ||
        CASE WHEN coalesce(cost_for_two, 0) = 0 THEN 'N/A' ELSE '₹' || cost_for_two END || ' | ' || budget_band AS line FROM catalog"""),
    "data_summary": using("catalog", f"""SELECT q.*, (SELECT count(*) FROM catalog) AS total,
        (SELECT count(DISTINCT city) FROM catalog) AS n_cities, (SELECT string_agg(name, ',' ORDER BY first_index)
          FROM (SELECT * FROM catalog WHERE city = 'Mumbai' ORDER BY first_index LIMIT 5) s) AS sample_names,
        (SELECT string_agg(DISTINCT city, ',' ORDER BY city) FROM catalog) AS cities,
        (SELECT count(*) FROM catalog WHERE city = 'Mumbai') AS in_city FROM (SELECT {QUALITY}) q"""),
    # one preference
    "top_candidates": using("catalog", f"""SELECT CAST(row_number() OVER (ORDER BY coalesce(rating, -1) DESC, lower(name), id) AS INTEGER) AS position,
        {CARD} FROM catalog WHERE {ONE_ALL} ORDER BY position LIMIT 30"""),
    "funnel_one": using("catalog", f"SELECT {ONE_COUNTS} FROM catalog"),
    "match_one": using("catalog", f"""SELECT 'Bangalore' AS normalized_location, {ONE_COUNTS}, CAST(30 AS INTEGER) AS top_n,
        (SELECT string_agg(id, ',' ORDER BY coalesce(rating, -1) DESC, lower(name), id) FROM (SELECT * FROM catalog
          WHERE {ONE_ALL} ORDER BY coalesce(rating, -1) DESC, lower(name), id LIMIT 30) best) AS ids FROM catalog"""),
    # preference tables
    "validate_preferences": using("checked", """SELECT pref_id, location, budget, cuisine, min_rating, additional_preferences,
        normalized_location, errors FROM checked"""),
    "rejected_preferences": using("checked", "SELECT pref_id, errors FROM checked WHERE errors <> ''"),
    "batch_match_topn": using("ranked", f"SELECT pref_id, position, {CARD} FROM ranked"),
    "funnel_counts": using("counted", """SELECT pref_id, candidates_considered, after_location, after_cuisine, after_rating,
        after_budget, returned FROM counted"""),
    "candidate_lists": using("ranked", """SELECT v.pref_id, coalesce(string_agg(r.id, ',' ORDER BY r.position), '') AS ids
        FROM valid v LEFT JOIN ranked r USING (pref_id) GROUP BY v.pref_id"""),
    "empty_reason": using("reasons", "SELECT pref_id, message FROM reasons WHERE message IS NOT NULL"),
    "root_cause": using("counted", """SELECT pref_id,
        CASE WHEN after_location = 0 THEN 'location' WHEN after_cuisine = 0 THEN 'cuisine' WHEN after_rating = 0 THEN 'rating' ELSE 'budget' END AS cause,
        CASE WHEN after_location = 0 THEN candidates_considered WHEN after_cuisine = 0 THEN after_location
          WHEN after_rating = 0 THEN after_cuisine ELSE after_rating END AS stage_before,
        CASE WHEN after_location = 0 THEN 'No Restaurants in ' || normalized_location
          WHEN after_cuisine = 0 THEN 'No ' || needle || ' Restaurants in ' || normalized_location
          WHEN after_rating = 0 THEN 'Rating Too High for This Combination' ELSE 'No Restaurants in This Budget Range' END AS title,
        CASE WHEN after_location = 0 THEN 'We don''t have any restaurant data for "' || normalized_location
            || '" in our database. This location may not be covered in our current Bangalore dataset.'
          WHEN after_cuisine = 0 THEN 'We found ' || after_location || ' restaurant' || CASE WHEN after_location = 1 THEN '' ELSE 's' END || ' in '
            || normalized_location || ', but none of them serve ' || needle || ' cuisine. This cuisine type may not be available in this neighborhood.'
          WHEN after_rating = 0 THEN 'We found ' || after_cuisine || ' ' || kind || 'restaurant' || CASE WHEN after_cuisine = 1 THEN '' ELSE 's' END
            || ' in ' || normalized_location || ', but none have a rating of ' || printf('%.1f', min_rating) || ' or above.'
          ELSE 'We found ' || after_rating || ' ' || kind || 'restaurant' || CASE WHEN after_rating = 1 THEN '' ELSE 's' END || ' in '
            || normalized_location || ' rated ' || printf('%.1f', min_rating) || '+, but none fall in the "'
            || CASE budget WHEN 'low' THEN 'under ₹500' WHEN 'medium' THEN '₹500–₹1500' ELSE 'above ₹1500' END || '" budget range.' END AS explanation,
        CASE WHEN after_location = 0 THEN 'Try a nearby popular area like Indiranagar, Koramangala, or Whitefield.|'
            || 'Double-check the location spelling or select from the dropdown.'
          WHEN after_cuisine = 0 THEN 'Set Cuisine Type to "Any" to see all ' || after_location || ' restaurants in ' || normalized_location
            || '.|Try nearby locations that may have ' || needle || ' restaurants.'
          WHEN after_rating = 0 THEN 'Lower your minimum rating to 3.5 or below — the available restaurants here may be rated slightly lower.|'
            || 'Check nearby areas like Koramangala or Indiranagar for higher-rated ' || kind || 'options.'
          ELSE 'Try a different budget level — the matching restaurants may be in a ' || CASE WHEN budget = 'low' THEN 'higher' ELSE 'different' END
            || ' price bracket.|Lower your minimum rating to expand the pool of candidates within your budget.' END AS suggestions
        FROM (SELECT *, CASE WHEN needle = '' THEN '' ELSE needle || ' ' END AS kind FROM counted) c WHERE returned = 0"""),
    "filters_applied": using("valid", """SELECT pref_id, normalized_location AS location, budget, min_rating,
        CASE WHEN needle = '' THEN 'any' ELSE needle END AS cuisine, additional_preferences FROM valid"""),
    # prompts
    "prompt_payload": using("ranked", """SELECT v.pref_id, v.location, v.budget, v.cuisine, v.min_rating, v.additional_preferences,
        count(*) AS n_candidates, string_agg(r.id, ',' ORDER BY r.position) AS ids,
        string_agg(CASE WHEN r.rating IS NULL THEN 'N/A' ELSE CAST(r.rating AS VARCHAR) END, ',' ORDER BY r.position) AS ratings,
        string_agg(r.name, '|' ORDER BY r.position) AS card_name, string_agg(r.cuisine, '|' ORDER BY r.position) AS card_cuisine,
        string_agg(coalesce(CAST(r.cost_for_two AS VARCHAR), 'N/A'), '|' ORDER BY r.position) AS card_cost_for_two,
        string_agg(r.location, '|' ORDER BY r.position) AS card_location,
        CAST(least(5, count(*)) AS INTEGER) AS request_top_k
        FROM valid v JOIN ranked r USING (pref_id) GROUP BY ALL"""),
    "prompt_text": using("ranked", """SELECT v.pref_id, sha256('{' || chr(10) || '  "preferences": {' || chr(10)
        || '    "location": ' || to_json(v.location) || ',' || chr(10) || '    "budget": ' || to_json(v.budget) || ',' || chr(10)
        || '    "cuisine": ' || to_json(v.cuisine) || ',' || chr(10) || '    "min_rating": ' || CAST(v.min_rating AS VARCHAR)
        || coalesce(',' || chr(10) || '    "additional_preferences": ' || to_json(v.additional_preferences), '') || chr(10) || '  },' || chr(10)
        || '  "candidates": [' || chr(10) || string_agg('    {' || chr(10) || '      "id": ' || to_json(r.id) || ',' || chr(10)
          || '      "name": ' || to_json(r.name) || ',' || chr(10) || '      "cuisine": ' || to_json(r.cuisine) || ',' || chr(10)
          || '      "rating": ' || coalesce(CAST(r.rating AS VARCHAR), '"N/A"') || ',' || chr(10)
          || '      "cost_for_two": ' || coalesce(CAST(r.cost_for_two AS VARCHAR), '"N/A"') || ',' || chr(10)
          || '      "location": ' || to_json(r.location) || chr(10) || '    }', ',' || chr(10) ORDER BY r.position)
        || chr(10) || '  ],' || chr(10) || '  "request_top_k": ' || least(5, count(*)) || chr(10) || '}') AS prompt_sha256
        FROM valid v JOIN ranked r USING (pref_id)
        GROUP BY v.pref_id, v.location, v.budget, v.cuisine, v.min_rating, v.additional_preferences"""),
    "effective_top_k": using("ranked", """SELECT pref_id, CAST(greatest(1, least(5, count(*))) AS INTEGER) AS top_k
        FROM ranked GROUP BY pref_id"""),
    "system_text": using("ranked", f"""SELECT pref_id, replace('{SYSTEM_TEMPLATE.replace("'", "''")}', '%d',
        CAST(least(5, count(*)) AS VARCHAR)) AS system FROM ranked GROUP BY pref_id"""),
    # replies
    "strip_fences": using("unfenced", "SELECT pref_id, body FROM unfenced"),
    "parse_responses": using("parsed_replies", "SELECT pref_id, parse_error, summary FROM parsed_replies"),
    "reply_items": using("items", "SELECT pref_id, item_position, id, rank, explanation FROM items"),
    "unknown_ids": using("resolved", """SELECT pref_id,
        CAST(row_number() OVER (PARTITION BY pref_id ORDER BY item_position) AS INTEGER) AS position, 'Hallucinated candidate ID ''' || id || ''' dropped.' AS warning
        FROM resolved WHERE NOT is_known"""),
    "rerank": using("reranked", """SELECT pref_id, rank, id, name, rating, cost_for_two, explanation FROM reranked"""),
    "reconcile": using("reply_state", """SELECT pref_id, n_known AS n_recommendations, warnings,
        CASE WHEN raw_response IS NULL THEN 'parse' WHEN error = 'LLMParseError' THEN 'parse' WHEN error = 'Exception' THEN 'rank' END AS reply_error
        FROM reply_state"""),
    # envelopes
    "resumed_replies": using("responses", """SELECT pref_id, raw_response, CASE WHEN pref_id % 2 = 0
          THEN (SELECT count(*) FROM responses WHERE pref_id % 2 = 0)
          ELSE (SELECT count(*) FROM responses WHERE pref_id % 2 = 1 OR error_type IS NOT NULL) END AS asked
        FROM responses WHERE error_type IS NULL"""),
    "recommend_batch": using("answers", """SELECT pref_id, status, message,
        CASE WHEN status IN ('success', 'partial') THEN reply_summary END AS summary,
        CASE WHEN status IN ('success', 'partial') THEN n_known ELSE 0 END AS n_recommendations,
        CASE WHEN status IN ('success', 'partial') THEN reply_warnings ELSE '' END AS warnings FROM answers"""),
    "error_envelope": using("answers", """SELECT pref_id, error AS error_type, message, own_error AS error,
        error NOT IN ('LLMConfigurationError', 'Exception') AS llm_called FROM answers WHERE status = 'error'"""),
    "result_metadata": using("answers", """SELECT pref_id, candidates_considered, after_location, after_cuisine, after_rating,
        after_budget, returned, CAST(30 AS INTEGER) AS top_n, status <> 'empty' AS llm_called,
        CASE WHEN status <> 'empty' THEN CAST(format('{:.1f}', latency_ms) AS DOUBLE) END AS llm_latency_ms
        FROM answers WHERE status <> 'error'"""),
    "result_badge": using("answers", """SELECT pref_id, 'Selected ' || n_known || ' restaurants from ' || after_budget || ' matches!' AS badge
        FROM answers WHERE status IN ('success', 'partial')"""),
    "result_cards": using("answers", """SELECT r.pref_id, r.rank, r.name,
        CASE WHEN r.rating IS NULL THEN '—' ELSE format('{:.1f}', r.rating) END AS rating,
        CASE WHEN coalesce(r.cost_for_two, 0) = 0 THEN 'Price not available' ELSE '₹' || r.cost_for_two END AS cost,
        r.cuisine, r.location || ', ' || r.city AS place, r.explanation
        FROM reranked r JOIN answers a USING (pref_id) WHERE a.status IN ('success', 'partial')"""),
}
