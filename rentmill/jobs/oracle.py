"""Oracle SQL of the queries over listings: other algorithms than the jobs' where the dialect has no look-around.

Hits are found by scanning positions, periods by cutting the text between matches; lists are literal."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import lexicons as x
from ..functions.price import AMOUNT
from ..sources import synthetic

BLANK = f"[{synthetic.NBSP}{synthetic.NARROW}]"


def quoted(words: Sequence[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def fold(e: str) -> str:
    for a, b in (("½", "1/2"), ("…", "..."), ("’", "''"), ("—", "-")):
        e = f"replace({e}, '{a}', '{b}')"
    return rf"trim(regexp_replace(lower(strip_accents(regexp_replace(coalesce({e}, ''), '{BLANK}', ' ', 'g'))), '\s+', ' ', 'g'))"


def any_of(t: str, words: Sequence[str]) -> str:
    return f"(len(list_filter({quoted(words)}, lambda n: contains({t}, n))) > 0)"


def first_of(t: str, words: Sequence[str]) -> str:
    return f"list_filter({quoted(words)}, lambda n: contains({t}, n))[1]"


def folded(base: str, texts: Sequence[tuple[str, str]] = (("title", "ft"), ("description", "fd"))) -> str:
    """CTEs base, folded and corpus of the rows of ``base``; ``texts`` are the columns of its corpus, raw and folded."""
    given = ", ".join(f"CASE WHEN length({raw}) > 0 THEN {to} END" for raw, to in texts)
    whole = f"list_filter([{given}], lambda s: s IS NOT NULL)"
    return f"""
    base AS ({base}),
    folded AS (SELECT *, {fold("price_text")} AS fp, {", ".join(f"{fold(raw)} AS {to}" for raw, to in texts)}, {fold("location_text")} AS fl FROM base),
    corpus AS (SELECT *, array_to_string({whole}, ' . ') AS clauses, array_to_string({whole}, ' ') AS line FROM folded)"""


FOLDED = folded(synthetic.LISTINGS)


def decimal(raw: str) -> str:
    return (
        f"TRY_CAST(CASE WHEN NOT regexp_matches({raw}, '[.,]') THEN {raw} "
        f"WHEN length(regexp_extract({raw}, '[.,]([^.,]*)$', 1)) = 3 THEN regexp_replace({raw}, '[.,]', '', 'g') "
        f"ELSE regexp_replace(regexp_replace({raw}, '[.,][^.,]*$', ''), '[.,]', '', 'g') || '.' || regexp_extract({raw}, '[.,]([^.,]*)$', 1) END AS DECIMAL(18,2))"
    )


def period(w: str) -> str:
    arms = " ".join(f"WHEN {any_of(w, words)} THEN '{name}'" for name, words in x.PERIOD_WORDS)
    return f"CASE {arms} ELSE 'unknown' END"


def best_price(t: str) -> str:
    """The largest amount in the folded text ``t`` as a struct, or null."""

    def found(pattern: str, groups: int) -> str:
        all_ = f"regexp_extract_all({t}, '{pattern}')"
        cut = f"string_split_regex({t}, '{pattern}')"
        raw = f"regexp_extract_all({t}, '{pattern}', 1)[i]"
        if groups == 2:
            raw = f"coalesce(nullif({raw}, ''), regexp_extract_all({t}, '{pattern}', 2)[i])"
        end = f"(length(array_to_string({cut}[1:i], '')) + length(array_to_string({all_}[1:i], '')))"
        return (
            f"list_transform(range(1, len({all_}) + 1), lambda i: {{'amount': {decimal(f'replace({raw}, chr(32), chr(0)[1:0])')}, 'place': -i, "
            f"'period': {period(f'substr({t}, {end} + 1, 24)')}}})"
        )

    marked = rf"(?:\$|cad)\s*({AMOUNT})|({AMOUNT})\s*(?:\$|cad\b|dollars?\b)"
    word = rf"(?:loyer|rent|prix|price)\s*:?\s*({AMOUNT})\b"
    both = f"CASE WHEN len({found(marked, 2)}) > 0 THEN {found(marked, 2)} ELSE {found(word, 1)} END"
    return f"list_sort({both}, 'DESC', 'NULLS LAST')[1]"


PRICES = f"""
    bests AS (
        SELECT *, {any_of("fp", x.ON_REQUEST)} AS r1, {any_of("ft", x.ON_REQUEST)} AS r2, {any_of("fd", x.ON_REQUEST)} AS r3,
               {best_price("fp")} AS b1, {best_price("ft")} AS b2, {best_price("fd")} AS b3
        FROM corpus
    ),
    chosen AS (
        SELECT *, CASE WHEN r1 THEN NULL WHEN b1.amount > 0 THEN b1 WHEN r2 THEN NULL WHEN b2.amount > 0 THEN b2
                       WHEN r3 THEN NULL WHEN b3.amount > 0 THEN b3 END AS b FROM bests
    ),
    priced AS (
        SELECT *, b.amount AS amount, b.period AS period,
               CAST(CASE b.period WHEN 'week' THEN round_even(CAST(b.amount AS DOUBLE) * 52 / 12, 2)
                    WHEN 'day' THEN round_even(CAST(b.amount AS DOUBLE) * 365 / 12, 2) ELSE b.amount END AS DECIMAL(18,2)) AS monthly
        FROM chosen
    )"""

POSTAL = "|".join("".join(("[a-z]" if i % 2 == 0 else "[0-9]") + ("[ -]" if i + 1 == gap else "") for i in range(6)) for gap in range(6))
PROVINCES = " ".join(f"WHEN '{letter}' THEN '{name}'" for letter, name in x.POSTAL_PROVINCES)
CENTRE = (45.4765, -75.7013)
PLACES = f"""
    spots AS (
        SELECT *, nullif(upper(substr(replace(replace(regexp_extract(fl, '{POSTAL}'), ' ', ''), '-', ''), 1, 3)), '') AS postal_prefix,
               {first_of("fl", x.ONTARIO_CITIES)} AS on_city, {first_of("fl", x.OUTAOUAIS_CITIES)} AS qc_city,
               {any_of("(' ' || fl || ' ')", x.ONTARIO_TOKENS)} AS is_on, {any_of("(' ' || fl || ' ')", x.QUEBEC_TOKENS)} AS is_qc,
               {2 * x.EARTH_RADIUS_KM} * asin(sqrt(pow(sin(radians({CENTRE[0]} - latitude) / 2), 2)
                   + cos(radians(latitude)) * cos(radians({CENTRE[0]})) * pow(sin(radians({CENTRE[1]} - longitude) / 2), 2))) AS distance
        FROM priced
    ),
    placed AS (
        SELECT *, coalesce(on_city, qc_city) AS city,
               CASE WHEN postal_prefix IS NOT NULL THEN CASE substr(postal_prefix, 1, 1) {PROVINCES} ELSE 'other' END
                    WHEN is_on THEN 'ON' WHEN is_qc THEN 'QC' WHEN on_city IS NOT NULL THEN 'ON' WHEN qc_city IS NOT NULL THEN 'QC' END AS province,
               CASE WHEN postal_prefix IS NOT NULL THEN 'postal:' || postal_prefix WHEN is_on THEN 'token:on' WHEN is_qc THEN 'token:qc'
                    WHEN coalesce(on_city, qc_city) IS NOT NULL THEN 'city:' || coalesce(on_city, qc_city) ELSE 'none' END AS evidence
        FROM spots
    )"""


def hits(terms: Sequence[str]) -> str:
    """Hits in ``clauses``: structs of the text before, the term and the text after, by a scan of all positions."""
    body = "(?:" + "|".join(terms) + ")s?"
    at = (
        f"list_filter(range(1, length(clauses) + 1), lambda i: (i = 1 OR NOT regexp_matches(substr(clauses, i - 1, 1), '[a-z0-9]')) "
        f"AND regexp_matches(substr(clauses, i), '^{body}([^a-z0-9]|$)'))"
    )
    term = f"regexp_extract(substr(clauses, i), '^({body})([^a-z0-9]|$)', 1)"
    return (
        f"list_transform({at}, lambda i: {{'before': regexp_extract(substr(clauses, greatest(1, i - 32), i - greatest(1, i - 32)), '[^.;!?|•·]*$'), "
        f"'term': {term}, 'after': regexp_extract(substr(clauses, i + length({term}), 40), '^[^.;!?|•·]*')}})"
    )


def absence(h: str) -> str:
    around = f"({h}.before || chr(10) || {h}.after)"
    return (
        f"coalesce('hookup:' || {first_of(around, x.HOOKUP_MARKERS)}, 'shared:' || {first_of(around, x.SHARED_MARKERS)}, "
        f"'negated:' || {first_of(f'{h}.after', x.NEGATED_AFTER)}, 'negated:' || trim({first_of(f'right({h}.before, 14)', x.NEGATED_BEFORE)}))"
    )


TERMS = (*x.APPLIANCE_TERMS, ("bundle", x.KITCHEN_BUNDLE))
APPLIANCES = f"""
    hit AS (SELECT *, {", ".join(f"{hits(terms)} AS h_{n}" for n, terms in TERMS)} FROM placed),
    classed AS (
        SELECT *, {", ".join(f"list_transform(h_{n}, lambda h: {{'absent': {absence('h')}, 'term': h.term}}) AS c_{n}" for n, _ in TERMS)} FROM hit
    ),
    decided AS (
        SELECT *, {", ".join(f'''CASE WHEN len(c_{n}) = 0 THEN 'unknown' WHEN len(list_filter(c_{n}, lambda c: c.absent IS NULL)) > 0 THEN 'present' ELSE 'absent' END AS s_{n},
            coalesce(list_filter(c_{n}, lambda c: c.absent IS NULL)[1].term, c_{n}[1].absent) AS e_{n}''' for n, _ in TERMS)} FROM classed
    ),
    equipped AS (
        SELECT *, {", ".join(f"s_{n} AS {n}_status, e_{n} AS {n}_evidence" for n in ("washer", "dryer", "dishwasher"))},
            {", ".join(f'''CASE WHEN s_{n} = 'unknown' AND s_bundle = 'present' THEN 'present' ELSE s_{n} END AS {n}_status,
            CASE WHEN s_{n} = 'unknown' AND s_bundle = 'present' THEN 'bundle:' || e_bundle ELSE e_{n} END AS {n}_evidence''' for n in ("fridge", "stove"))}
        FROM decided
    )"""


def count_of(pattern: str) -> str:
    """The first number from 1 to 12 before ``pattern`` in ``line`` that no digit, comma or point precedes."""
    at = "list_filter(range(1, length(line) + 1), lambda i: i = 1 OR NOT regexp_matches(substr(line, i - 1, 1), '[0-9,.]'))"
    values = f"list_transform({at}, lambda i: TRY_CAST(regexp_extract(substr(line, i), '^([0-9]{{1,2}}){pattern}', 1) AS INT))"
    return f"list_filter({values}, lambda n: n BETWEEN 1 AND 12)[1]"


UNIT = " ".join(f"WHEN {any_of('line', terms)} THEN '{name}'" for name, terms in x.UNIT_TYPES)
DWELLINGS = rf"""
    counted AS (
        SELECT *, {count_of(r"\s*[-\s]?\s*1/2")} AS halves, {count_of(r"\s*(?:pieces?|pcs?)\b")} AS pieces,
               {count_of(r"\s*(?:chambres?\s*(?:a\s*coucher)?|cac\b|c\.?a\.?c\b|bedrooms?|bdrms?|bdr\b|br\b)")} AS beds,
               {first_of("line", x.ROOM_PHRASES)} AS room, {first_of("line", x.UNIT_PHRASES)} AS unit, CASE {UNIT} END AS unit_type
        FROM equipped
    ),
    housed AS (
        SELECT *, coalesce(halves + 0.5, pieces)::DOUBLE AS rooms,
               coalesce(beds::DOUBLE, greatest(0.0, coalesce(halves + 0.5, pieces)::DOUBLE - 2.5)) AS bedrooms0
        FROM counted
    ),
    dwelt AS (
        SELECT *, CASE WHEN beds IS NULL AND rooms IS NULL THEN NULL ELSE bedrooms0 END AS bedrooms,
               CASE WHEN room IS NOT NULL THEN true WHEN unit IS NOT NULL OR rooms IS NOT NULL THEN false END AS is_room,
               CASE WHEN room IS NOT NULL THEN 'room:' || room WHEN unit IS NOT NULL THEN 'unit:' || unit
                    WHEN rooms IS NOT NULL THEN 'rooms:' || rooms::VARCHAR END AS dwelling_evidence
        FROM housed
    )"""
NEEDED = ("washer", "dryer", "fridge", "stove")


def verdicts(most: int, needed: Sequence[str], name: str, least: int = 400, radius: int = 40, rooms: bool = False, anywhere: bool = False) -> str:
    absent = ", ".join(f"CASE WHEN {n}_status = 'absent' THEN '{n}_absent:' || {n}_evidence END" for n in needed)
    unknown = ", ".join(f"CASE WHEN {n}_status = 'unknown' THEN '{n}_unknown' END" for n in needed)
    nowhere = "CASE WHEN province IS NULL THEN 'province_unknown' END"
    return f"""
    {name}0 AS (
        SELECT *, list_filter([CASE WHEN period IN ('week', 'day') THEN 'short_term_' || period || 'ly' END,
                CASE WHEN monthly > {most} THEN 'over_budget' WHEN monthly < {least} THEN 'price_implausible' END,
                {"NULL" if anywhere else nowhere}, CASE WHEN province <> 'QC' THEN 'province_not_qc:' || lower(province) END,
                CASE WHEN distance > {radius} THEN 'outside_radius' END, {absent},
                CASE WHEN is_room AND NOT {rooms} THEN 'room_rental:' || dwelling_evidence END], lambda r: r IS NOT NULL) AS rejections,
            list_filter([CASE WHEN amount IS NULL THEN 'price_unknown' END, {nowhere if anywhere else "NULL"},
                CASE WHEN distance IS NULL AND NOT coalesce(list_contains({quoted(x.OUTAOUAIS_CITIES)}, city), false) THEN 'proximity_unverified' END,
                {unknown}, CASE WHEN is_room IS NULL AND NOT {rooms} THEN 'dwelling_type_unknown' END], lambda r: r IS NOT NULL) AS unknowns
        FROM dwelt
    ),
    {name} AS (
        SELECT *, CASE WHEN len(rejections) > 0 THEN 'reject' WHEN len(unknowns) > 0 THEN 'maybe' ELSE 'match' END AS verdict FROM {name}0
    )"""


PARSED = f"WITH {FOLDED}, {PRICES}, {PLACES}, {APPLIANCES}, {DWELLINGS}"
JUDGED = f"{PARSED}, {verdicts(2000, NEEDED, 'judged')}"
BEFORE = f"WITH runs AS ({synthetic.RUNS}), old AS (SELECT * FROM runs WHERE run_day < DATE '2024-01-05'), batch AS (SELECT * FROM runs WHERE run_day >= DATE '2024-01-05')"
COLLAPSED = """SELECT platform, external_id, arg_max(verdict, seq) AS verdict,
        arg_max(price_cad, seq) FILTER (WHERE price_cad IS NOT NULL) AS price_cad FROM {} GROUP BY ALL"""
UPSERTED = f"""{BEFORE}, o AS ({COLLAPSED.format("old")}), b AS ({COLLAPSED.format("batch")}), after AS (
        SELECT platform, external_id, coalesce(b.verdict, o.verdict) AS verdict, coalesce(b.price_cad, o.price_cad) AS price_cad,
               o.platform IS NULL AS fresh, b.platform IS NOT NULL AS seen
        FROM o FULL JOIN b USING (platform, external_id)
    )"""
COUNTERS = f"""{BEFORE}, k AS (SELECT DISTINCT platform, external_id FROM batch),
    n AS (SELECT platform, count(*) AS new FROM k WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.platform = k.platform AND old.external_id = k.external_id) GROUP BY 1),
    s AS (SELECT platform, count(*) AS seen, count(*) FILTER (WHERE verdict = 'match') AS match, count(*) FILTER (WHERE verdict = 'maybe') AS maybe,
                 count(*) FILTER (WHERE verdict = 'reject') AS reject FROM batch GROUP BY 1),
    c AS (SELECT platform, seen, coalesce(new, 0) AS new, seen - coalesce(new, 0) AS updated, match, maybe, reject FROM s LEFT JOIN n USING (platform))"""
STORED = f"""{JUDGED}, stored AS (
        SELECT platform, external_id, verdict, array_to_string(list_concat(rejections, unknowns), ', ') AS reasons,
               monthly::DECIMAL(10,2) AS price_cad, period AS price_period, city, rooms, title, washer_status AS washer, dryer_status AS dryer,
               sha256('Vendeur ' || CAST(seq % 10 AS VARCHAR)) AS seller_hash
        FROM judged
    )"""


def cards(landing: str = "0") -> str:
    """CTEs of the cards, the last of each item among those that land together (``landing``: when a page's do)."""
    return f"""
    anchors AS ({synthetic.CARDS}),
    items AS (SELECT page_id, split_part(split_part(href, '/item/', 2), '/', 1) AS id, split_part(href, '?', 1) AS href, text, ord FROM anchors),
    best AS (SELECT page_id, id, arg_max(struct_pack(href := href, text := text), [length(text), -ord]) AS card FROM items GROUP BY ALL),
    last AS (SELECT id, {landing} AS landing, arg_max(card, page_id) AS card FROM best GROUP BY ALL),
    lines AS (SELECT id, landing, card.href AS href, list_filter(list_transform(string_split(card.text, chr(10)), lambda s: trim(s)), lambda s: s <> '' AND NOT starts_with(s, 'Publié')) AS ls FROM last),
    priced_line AS (SELECT *, list_filter(ls, lambda s: contains(s, '$'))[1] AS price_text FROM lines),
    others AS (SELECT *, list_filter(ls, lambda s: s IS DISTINCT FROM price_text) AS rest FROM priced_line),
    split AS (SELECT *, len(rest) > 1 AND length(rest[-1]) <= 48 AS is_placed FROM others),
    titled AS (
        SELECT id, landing, href, price_text, CASE WHEN is_placed THEN rest[-1] END AS location_text,
               list_sort(list_transform(range(1, len(rest) + 1 - is_placed::INT), lambda i: {{'n': length(rest[i]), 'i': -i, 's': rest[i]}}), 'DESC')[1].s AS title
        FROM split
    ),
    corpus AS (
        SELECT *, {fold("price_text")} AS fp, {fold("title")} AS ft, '' AS fd, {fold("location_text")} AS fl, NULL::DOUBLE AS latitude, NULL::DOUBLE AS longitude FROM titled
    )"""


CARDS = cards()
OPENED = f"""
    opened AS (
        SELECT *, NOT coalesce(monthly > 2000 OR period IN ('week', 'day'), false) AND NOT coalesce(length(location_text) > 0 AND province <> 'QC', false) AS worth_opening
        FROM placed
    )"""

SQL: dict[str, str] = {
    "card_listings": f"""WITH {CARDS}, {PRICES}, {PLACES}, {OPENED}
        SELECT 'facebook' AS platform, id AS external_id, href AS url, title, price_text, location_text, worth_opening,
               CASE WHEN worth_opening AND c_name IS NOT NULL THEN 'Laveuse incluse. ' || c_name END AS description
        FROM opened LEFT JOIN customer ON c_custkey::VARCHAR = id""",
    "judge_listings": f"{JUDGED} SELECT platform, external_id, verdict, array_to_string(rejections, '|') AS rejections, array_to_string(unknowns, '|') AS unknowns FROM judged",
    "fold_documents": r"""
        WITH f AS (SELECT doc_id, trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '\s+', ' ', 'g')) AS folded FROM documents)
        SELECT doc_id, length(folded) AS n_chars, md5(folded) AS folded_md5 FROM f""",
    "parse_prices": f"WITH {FOLDED}, {PRICES} SELECT platform, external_id, amount::DOUBLE AS amount, period, monthly::DOUBLE AS monthly, coalesce(period IN ('week', 'day'), false) AS short_term FROM priced",
    "locate_places": f"""WITH {FOLDED}, {PRICES}, {PLACES} SELECT platform, external_id, province, city, postal_prefix, round(distance, 6) AS distance_km,
        evidence, coalesce(province = 'QC', false) AS is_quebec FROM placed""",
    "detect_appliances": f"""WITH {FOLDED}, {PRICES}, {PLACES}, {APPLIANCES} SELECT platform, external_id,
        {", ".join(f"{n}_status, {n}_evidence" for n, _ in x.APPLIANCE_TERMS)} FROM equipped""",
    "parse_dwellings": f"{PARSED} SELECT platform, external_id, is_room::VARCHAR AS is_room, rooms, bedrooms, unit_type, dwelling_evidence AS evidence FROM dwelt",
    "verdict_counts": f"{JUDGED} SELECT platform, verdict, count(*) AS n FROM judged GROUP BY ALL",
    "stored_rows": f"{STORED} SELECT platform, external_id, verdict, price_cad::DOUBLE AS price_cad, price_period, city, rooms, washer, seller_hash FROM stored",
    "newest_maybe": f"""{STORED} SELECT platform, external_id, verdict,
            CASE WHEN price_cad IS NULL THEN '$?' ELSE '$' || format('{{:,}}', round_even(price_cad, 0)::BIGINT) END AS price,
            CASE WHEN rooms > 0 THEN floor(rooms)::BIGINT::VARCHAR || '½' ELSE '?' END AS rooms, coalesce(city, '?') AS city,
            'w:' || washer || ' d:' || dryer AS laundry, coalesce(title, '') AS title, '' AS url, CASE WHEN verdict <> 'match' THEN reasons ELSE '' END AS why
        FROM stored WHERE verdict = 'maybe' ORDER BY platform, external_id LIMIT 50""",
    "inspect_listings": f"""WITH base AS ({synthetic.LISTINGS}) SELECT platform, external_id, title, price_text, location_text,
            substr(coalesce(description, ''), 1, 500) AS description, (SELECT count(*) FROM base) AS total
        FROM base ORDER BY platform, external_id LIMIT 25""",
    "replay_transitions": f"""{JUDGED}, {verdicts(2500, ("fridge", "stove"), "loose")}
        SELECT j.verdict AS before, l.verdict AS after, count(*) AS n FROM judged j JOIN loose l USING (platform, external_id) GROUP BY ALL""",
    "search_frontier": f"""WITH r AS (SELECT DISTINCT base FROM ({synthetic.RESPONSES}))
        SELECT base, page::INT AS page, CASE WHEN page = 1 THEN base ELSE regexp_replace(base, '/([^/]*)$', '/page-' || page || '/\\1') END AS url
        FROM r, generate_series(1, 3) AS p(page)""".replace("\\\\1", "\\1"),
    "kept_pages": f"""WITH r AS ({synthetic.RESPONSES}),
        e AS (SELECT base, min(page) AS stop FROM r WHERE status NOT IN (200, 403, 429, 503) OR (status = 200 AND n_listings = 0) GROUP BY base),
        w AS (SELECT r.base, CASE WHEN status <> 200 THEN 'http ' || status || ' on ' || url END AS why FROM r JOIN e ON r.base = e.base AND r.page = e.stop)
        SELECT r.base, r.page, r.url, r.n_listings, w.why AS stop_reason FROM r LEFT JOIN e ON r.base = e.base LEFT JOIN w ON r.base = w.base
        WHERE r.status = 200 AND (e.stop IS NULL OR r.page < e.stop)""",
    "page_listings": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey % 5000 ORDER BY o_orderkey DESC) AS n FROM orders)
        SELECT o_orderkey AS page_id, 'kijiji' AS platform, (o_orderkey % 5000)::VARCHAR AS external_id,
            'https://www.kijiji.ca/v-' || o_orderkey AS url, 'Logement ' || o_custkey AS title,
            CASE o_orderkey % 4 WHEN 0 THEN printf('%.2f $', (100000 + o_orderkey % 90000) / 100) WHEN 1 THEN '1 450 $'
                WHEN 2 THEN printf('%.2f $', (o_orderkey % 3000)::DOUBLE) ELSE '950 $ / mois' END AS price_text,
            CASE o_orderkey % 3 WHEN 0 THEN 'Gatineau, QC' WHEN 1 THEN 'Hull J8X 1A1' END AS location_text,
            CASE WHEN o_orderkey % 3 = 1 THEN 45.5::DOUBLE END AS latitude, CASE WHEN o_orderkey % 3 = 1 THEN (-75.75)::DOUBLE END AS longitude,
            'Vendeur ' || o_custkey AS seller_name, 'Four=' || (o_custkey % 7) || '|Laveuse=Oui' AS attributes, false AS raw_names_seller, true AS raw_is_json
        FROM o WHERE n = 1""",
    "upsert_listings": f"""{UPSERTED} SELECT platform, external_id, verdict, price_cad::DOUBLE AS price_cad, CASE WHEN price_cad IS NOT NULL THEN 'month' END AS price_period,
            CASE WHEN fresh THEN '2026-08-01' ELSE '2026-07-01' END AS first_seen_at, CASE WHEN seen THEN '2026-08-01' ELSE '2026-07-01' END AS last_seen_at
        FROM after""",
    "run_counters": f"{COUNTERS} SELECT * FROM c",
    "run_summary": f"""{COUNTERS} SELECT platform, platform || ': ' || seen || ' seen | ' || new || ' new | ' || updated || ' updated | ' || match || ' match | '
            || maybe || ' maybe | ' || reject || ' reject' AS summary, seen AS written,
            '{{"ran_at":"2026-08-01T12:00:00Z","platform":"' || platform || '","seen":' || seen || ',"new":' || new || ',"updated":' || updated ||
            ',"by_verdict":{{"match":' || match || ',"maybe":' || maybe || ',"reject":' || reject || '}}}}' AS report FROM c""",
    "price_history": f"""WITH runs AS ({synthetic.RUNS}), h AS (
            SELECT *, lag(price_cad) OVER (PARTITION BY platform, external_id ORDER BY run_day, price_cad) - price_cad AS d FROM runs WHERE price_cad IS NOT NULL)
        SELECT platform, external_id, count(*) AS n_seen, count(*) FILTER (WHERE d > 0) AS n_drops, (max(d) FILTER (WHERE d > 0))::DOUBLE AS largest_drop FROM h GROUP BY ALL""",
    "new_matches": f"{UPSERTED} SELECT platform, external_id, price_cad::DOUBLE AS price_cad FROM after WHERE fresh AND verdict = 'match'",
}

SQL["page_details"] = """
    SELECT o_orderkey AS page_id, 'kijiji' AS platform, 'a' || o_orderkey AS external_id, NULL::VARCHAR AS url, 'Premier' AS title, 'Laveuse ' || o_custkey AS description,
        CASE o_orderkey % 3 WHEN 0 THEN '700 $' WHEN 1 THEN '125.00 $' ELSE '1250.50 $' END AS price_text, 'Hull J8Y 3X5' AS location_text,
        45.5::DOUBLE AS latitude, (-75.75)::DOUBLE AS longitude,
        CASE o_orderkey % 4 WHEN 0 THEN '2026-08-01 12:00' WHEN 1 THEN '2026-08-02 10:00' END AS posted_at, 'Frigo=Oui|Niveau=' || (o_orderkey % 5) AS attributes,
        'Vendeur ' || o_custkey AS seller_name, true AS raw_is_json, false AS raw_names_seller
    FROM orders
    UNION ALL
    SELECT page_id, 'kijiji', 'c' || o_custkey, CASE WHEN page_id % 2 = 0 THEN 'https://www.kijiji.ca/v/1' ELSE 'https://example.org/v' END, 'Voisin ' || page_id,
        NULL, NULL, NULL, NULL, NULL, NULL, '', NULL, true, false
    FROM (SELECT o_custkey, max(o_orderkey) AS page_id FROM orders GROUP BY 1)"""
SQL["included_appliances"] = f"""{PARSED} SELECT platform, external_id, {", ".join(f"{n}_status = 'present' AS {n}_included" for n, _ in x.APPLIANCE_TERMS)},
        washer_status = 'present' AND dryer_status = 'present' AS has_laundry, fridge_status = 'present' AND stove_status = 'present' AS has_kitchen FROM dwelt"""
SQL["judge_loosely"] = f"""{PARSED}, {verdicts(1500, ("washer", "dryer"), "judged", least=500, radius=25, rooms=True, anywhere=True)}
    SELECT platform, external_id, verdict, array_to_string(list_concat(rejections, unknowns), '|') AS reasons FROM judged"""
SQL["card_details"] = f"""WITH {CARDS}, {PRICES}, {PLACES}, {OPENED}
    SELECT 'facebook' AS platform, o.id AS external_id, md5(last.card.text) AS card_md5, CASE WHEN worth_opening AND c_name IS NOT NULL THEN 'Laveuse incluse. ' || c_name END AS detail_text
    FROM opened o JOIN last ON last.id = o.id LEFT JOIN customer ON c_custkey::VARCHAR = o.id"""

ATTRIBUTES = "replace(replace(attributes, '=', ' '), '|', ' ')"
BOTH = f"""
    SELECT platform, external_id, title, description, price_text, location_text, NULL::DOUBLE AS latitude, NULL::DOUBLE AS longitude, NULL::VARCHAR AS facts
    FROM ({SQL["card_listings"]})
    UNION ALL SELECT platform, external_id, title, NULL, price_text, location_text, latitude, longitude, {ATTRIBUTES} FROM ({SQL["page_listings"]})"""
FACTS = (("title", "ft"), ("description", "fd"), ("facts", "fa"))
ROW = "platform, external_id, verdict, array_to_string(list_concat(rejections, unknowns), '|') AS reasons, monthly::DECIMAL(10,2)::DOUBLE AS price_cad, period AS price_period"
RUN = f"""WITH s AS (SELECT * FROM ({JUDGED} SELECT {ROW} FROM judged WHERE seq % 3 = 0)),
    b AS (SELECT * FROM (WITH {folded(BOTH, FACTS)}, {PRICES}, {PLACES}, {APPLIANCES}, {DWELLINGS}, {verdicts(2000, NEEDED, "judged")} SELECT {ROW} FROM judged))"""
SQL["run_table"] = f"""{RUN} SELECT platform, external_id, coalesce(b.verdict, s.verdict) AS verdict, CASE WHEN b.verdict IS NULL THEN s.reasons ELSE b.reasons END AS reasons,
        CASE WHEN b.price_cad IS NULL THEN s.price_cad ELSE b.price_cad END AS price_cad, CASE WHEN b.price_cad IS NULL THEN s.price_period ELSE b.price_period END AS price_period,
        CASE WHEN s.verdict IS NULL THEN '2026-08-01' ELSE '2026-07-01' END AS first_seen_at, CASE WHEN b.verdict IS NULL THEN '2026-07-01' ELSE '2026-08-01' END AS last_seen_at
    FROM s FULL JOIN b USING (platform, external_id)"""
COUNTED = " ".join(f", count(*) FILTER (WHERE b.verdict = '{v}') AS {v}" for v in ("match", "maybe", "reject"))
SQL["run_document"] = f"""{RUN}, c AS (
        SELECT b.platform, count(*) AS seen, count(*) FILTER (WHERE s.verdict IS NULL) AS new {COUNTED} FROM b LEFT JOIN s ON s.platform = b.platform AND s.external_id = b.external_id GROUP BY 1
    ), r AS ({synthetic.RESPONSES}), e AS (
        SELECT base, min({{'page': page, 'status': status, 'url': url}}) AS stop FROM r
        WHERE status NOT IN (200, 403, 429, 503) OR (status = 200 AND n_listings = 0) GROUP BY base
    ), w AS (SELECT arg_max('http ' || stop.status || ' on ' || stop.url, base) AS why FROM e WHERE stop.status <> 200), d AS (
        SELECT platform, seen, new, seen - new AS updated, match, maybe, reject, CASE WHEN platform = 'kijiji' THEN (SELECT why FROM w) ELSE 'unknown: no log' END AS why FROM c
    )
    SELECT 'summary of ' || platform AS what, platform || ': ' || seen || ' seen | ' || new || ' new | ' || updated || ' updated | ' || match || ' match | ' || maybe || ' maybe | '
        || reject || ' reject' || coalesce(' | STOPPED EARLY (' || why || ')', '') AS said FROM d
    UNION ALL SELECT 'failure of craigslist', 'moved'
    UNION ALL SELECT 'failure of facebook', 'no log'
    UNION ALL SELECT 'report', '{{"ran_at":"2026-08-01T12:00:00Z","results":[' || string_agg('{{"platform":"' || platform || '","seen":' || seen || ',"new":' || new || ',"updated":' || updated
        || ',"by_verdict":{{"match":' || match || ',"maybe":' || maybe || ',"reject":' || reject || '}},"stopped_early":' || coalesce('"' || why || '"', 'null') || '}}', ',' ORDER BY platform) || ']}}' FROM d"""

RUN_NUMBER = "CASE WHEN run_day < DATE '2024-01-11' THEN 0 WHEN run_day < DATE '2024-01-21' THEN 1 ELSE 2 END"
NUMBERED = f"r AS (SELECT *, {RUN_NUMBER} AS run FROM ({synthetic.RUNS}))"
SQL["table_runs"] = f"""WITH {NUMBERED}
    SELECT platform, external_id, arg_max(verdict, [run, seq]) AS verdict, (arg_max(price_cad, [run, seq]) FILTER (WHERE price_cad IS NOT NULL))::DOUBLE AS price_cad,
        CASE WHEN count(price_cad) > 0 THEN 'month' END AS price_period, '2026-08-0' || (min(run) + 1) AS first_seen_at, '2026-08-0' || (max(run) + 1) AS last_seen_at
    FROM r GROUP BY platform, external_id"""
SQL["table_newest"] = f"""SELECT * FROM ({SQL["table_runs"]}) WHERE verdict = 'maybe' ORDER BY last_seen_at DESC, platform, external_id LIMIT 50"""
SQL["table_counters"] = f"""WITH {NUMBERED}, f AS (SELECT platform, external_id, min(run) AS run FROM r GROUP BY ALL),
    n AS (SELECT platform, run, count(*) AS new FROM f GROUP BY ALL)
    SELECT run, platform, count(*) AS seen, coalesce(any_value(new), 0) AS new, count(*) - coalesce(any_value(new), 0) AS updated,
        count(*) FILTER (WHERE verdict = 'match') AS match, count(*) FILTER (WHERE verdict = 'maybe') AS maybe, count(*) FILTER (WHERE verdict = 'reject') AS reject
    FROM r LEFT JOIN n USING (platform, run) GROUP BY run, platform"""
LANDED = f"""
    SELECT landing, 'facebook' AS platform, id AS external_id, href AS url, title, CASE WHEN worth_opening AND c_name IS NOT NULL THEN 'Laveuse incluse. ' || c_name END AS description,
        price_text, location_text, NULL::DOUBLE AS latitude, NULL::DOUBLE AS longitude, NULL::VARCHAR AS facts
    FROM (WITH {cards("page_id % 3")}, {PRICES}, {PLACES}, {OPENED} SELECT opened.*, c_name FROM opened LEFT JOIN customer ON c_custkey::VARCHAR = id)
    UNION ALL SELECT page_id % 3, platform, external_id, url, title, NULL, price_text, location_text, latitude, longitude, {ATTRIBUTES}
    FROM ({SQL["page_listings"].replace("PARTITION BY o_orderkey % 5000", "PARTITION BY o_orderkey % 3, o_orderkey % 5000")})"""
SQL["streamed_table"] = f"""WITH b AS (SELECT * FROM (WITH {folded(LANDED, FACTS)}, {PRICES}, {PLACES}, {APPLIANCES}, {DWELLINGS}, {verdicts(2000, NEEDED, "judged")}
        SELECT landing, url, title, {ROW} FROM judged))
    SELECT platform, external_id, arg_max({{'u': url}}, landing).u AS url, arg_max({{'t': title}}, landing).t AS title, arg_max(verdict, landing) AS verdict,
        arg_max(reasons, landing) AS reasons, arg_max(price_cad, landing) FILTER (WHERE price_cad IS NOT NULL) AS price_cad,
        arg_max(price_period, landing) FILTER (WHERE price_cad IS NOT NULL) AS price_period
    FROM b GROUP BY platform, external_id"""
SQL["replay_from_raw"] = f"""WITH {folded(BOTH, FACTS)}, {PRICES}, {PLACES}, {APPLIANCES}, {DWELLINGS}, {verdicts(2000, NEEDED, "judged")}, {verdicts(2500, ("fridge", "stove"), "loose")}
    SELECT platform, j.verdict AS before, l.verdict AS after, count(*) AS n, 0 AS n_differ FROM judged j JOIN loose l USING (platform, external_id) GROUP BY ALL"""
SQL["appended_history"] = SQL["price_history"]
SQL["streamed_cutoff"] = SQL["kept_pages"]
