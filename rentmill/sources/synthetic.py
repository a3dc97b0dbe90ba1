"""Listings, pages, cards, responses and runs derived from the supplied tables, which hold no ads.

The SQL is portable: Spark and the oracle engine run the same text, so both start from identical rows. Work grows with
``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import spread

NBSP, NARROW = "\u00a0", "\u202f"


def choose(expression: str, values: list[str]) -> str:
    """CASE over ``expression`` modulo the number of values, each an SQL expression."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expression} % {len(values)} {arms} END"


def text(*values: str) -> list[str]:
    return [f"'{v}'" if v is not None else "CAST(NULL AS VARCHAR(9))" for v in values]


RENT = "(300 + o_orderkey * 37 % 2400)"
PLAIN = f"CAST({RENT} AS VARCHAR(9))"
THOUSANDS = f"CAST(CAST(floor({RENT} / 1000) AS BIGINT) AS VARCHAR(9))"
REST = f"lpad(CAST({RENT} % 1000 AS VARCHAR(9)), 3, '0')"
PRICES = choose("o_orderkey", [
    f"{PLAIN} || ' $'", f"'$' || {PLAIN}", f"'$' || {THOUSANDS} || ',' || {REST}", f"{THOUSANDS} || ' ' || {REST} || ' $/mois'",
    f"{THOUSANDS} || '{NBSP}' || {REST} || '{NARROW}$ par mois'", f"{PLAIN} || ',50 $'", f"{PLAIN} || '.00 CAD'",
    f"'CA$' || {THOUSANDS} || ',' || {REST}", f"CAST({RENT} % 700 AS VARCHAR(9)) || ' $ / semaine'",
    f"CAST({RENT} % 150 AS VARCHAR(9)) || ' $ la nuitée'", "'Prix sur demande'", "'À discuter'",
    f"'Loyer : ' || {PLAIN}", "CAST(NULL AS VARCHAR(9))", f"'rent ' || {PLAIN} || ' monthly, was ' || {PLAIN} || ' dollars weekly'", "'0 $'",
])
TITLES = choose("o_orderkey", text(
    "Beau 4 1/2 à Gatineau", "Chambre à louer dans un 5½", "Condo 3½ — rénové", "Studio meublé", "Maison de ville 2 chambres à coucher",
    "3 pièces, coin tranquille 950 $", "Belle occasion !",
))
DESCRIPTIONS = choose("o_orderkey", text(
    "Laveuse-sécheuse incluses, réfrigérateur et cuisinière fournis.", "Frigo et cuisinière inclus. Espace pour laveuse-sécheuse.",
    "Laveuse et sécheuse non incluses; électros inclus", "Washer, dryer, fridge and stove. 2 bedrooms.",
    "Sans laveuse ni sécheuse, frigo, poêle", "Buanderie: laveuse et sécheuse communes dans l’immeuble. Réfrigérateur, four",
    "Dishwasher, washer hook-up, appliances included", None, "", "Tout inclus… LAVEUSE/SÉCHEUSE, lave-vaisselle, frigidaire, cuisinières",
    "No washer. Branchement pour sécheuse | poêle et frigo · logement au sous-sol 2 cac",
))
PLACES = choose("o_orderkey", text(
    "Gatineau, QC J8Y 3X5", "Ottawa, ON", "Hull (QC)", "K1A-0B1", "Aylmer", "Montréal, Québec", None, "Kanata", "Chelsea, QC",
    "G1R4S9 Ville", "V6B 1A1 Vancouver", "quelque part", "Val-des-Monts",
))
DEGREES = "CAST({base} AS DOUBLE) + CAST(o_custkey % 100 AS DOUBLE) / CAST({scale} AS DOUBLE)"
LISTINGS = f"""
    SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'kijiji' ELSE 'facebook' END AS platform,
           CAST(o_orderkey AS VARCHAR(20)) AS external_id, {TITLES} AS title, {DESCRIPTIONS} AS description,
           {PRICES} AS price_text, {PLACES} AS location_text,
           CASE WHEN o_custkey % 3 = 0 THEN {DEGREES.format(base=45.2, scale=120)} END AS latitude,
           CASE WHEN o_custkey % 3 = 0 THEN {DEGREES.format(base=-76.1, scale=110)} END AS longitude
    FROM orders
"""
#: A search's pages: 40 orders of a customer group a search, one page each, with all statuses that matter.
RESPONSES = """
    SELECT 'https://example.org/b-rentals/c' || CAST(o_custkey AS VARCHAR(20)) AS base, page, 'https://example.org/p' || CAST(o_orderkey AS VARCHAR(20)) AS url,
           CAST(CASE o_orderkey % 12 WHEN 3 THEN 404 WHEN 5 THEN 429 WHEN 7 THEN 503 ELSE 200 END AS BIGINT) AS status,
           CAST(CASE WHEN o_orderkey % 9 = 4 THEN 0 ELSE o_orderkey % 30 + 1 END AS BIGINT) AS n_listings
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders) AS o
"""
#: Observations of listings: a user is a listing, an event type a platform, a day a run.
RUNS = """
    SELECT event_id AS seq, event_type AS platform, CAST(user_id AS VARCHAR(20)) AS external_id, CAST(ts AS DATE) AS run_day,
           CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(round(value * 10, 0) AS DECIMAL(10,2)) END AS price_cad,
           CASE event_id % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'maybe' ELSE 'reject' END AS verdict
    FROM events
"""
NODE = """'{"id":' || CAST(o_orderkey % 5000 AS VARCHAR(20)) || ',"title":"Logement ' || CAST(o_custkey AS VARCHAR(20)) || '","price":' ||
    CASE o_orderkey % 4 WHEN 0 THEN CAST(100000 + o_orderkey % 90000 AS VARCHAR(20)) WHEN 1 THEN '"1 450 $"'
         WHEN 2 THEN '{"amount":' || CAST(o_orderkey % 3000 AS VARCHAR(20)) || '}' ELSE '{"label":"950 $ / mois","amount":95000}' END ||
    ',"location":' || CASE o_orderkey % 3 WHEN 0 THEN '"Gatineau, QC"'
         WHEN 1 THEN '{"name":"Hull","postalCode":"J8X 1A1","coordinates":{"latitude":45.5,"longitude":-75.75}}' ELSE 'null' END ||
    ',"seoUrl":"/v-' || CAST(o_orderkey AS VARCHAR(20)) || '","sellerName":"Vendeur ' || CAST(o_custkey AS VARCHAR(20)) ||
    '","attributes":[{"name":"Laveuse","value":"Oui"},{"name":"Four","value":"' || CAST(o_custkey % 7 AS VARCHAR(20)) || '"}]}'"""
PAGES = f"""
    SELECT o_orderkey AS page_id, '<html><script type="a" id="__NEXT_DATA__" x>{{"props":{{"a":[' || {NODE} || '],"n":1}}}}</script></html>' AS html
    FROM orders
"""
#: Pages with nested and repeated nodes, object-shaped attributes, dates and descriptions. Of the two nodes with the
#: page's own id the first is visited last; the related node's id is that of the customer, on all of their pages.
NESTED = """
    SELECT o_orderkey AS page_id, '<SCRIPT id="__NEXT_DATA__">{"props":{"list":[{"wrap":[{"adId":"a' || CAST(o_orderkey AS VARCHAR(20)) ||
           '","name":"Premier","priceLabel":' || CASE o_orderkey % 3 WHEN 0 THEN '"700 $"' WHEN 1 THEN '12500' ELSE '1250.5' END ||
           ',"postalCode":"J8Y 3X5","address":{"label":"Hull","lat":45.5,"lng":-75.75},"sortingDate":"' ||
           CASE o_orderkey % 4 WHEN 0 THEN '2026-08-01T12:00:00Z' WHEN 1 THEN '2026-08-02 10:00:00' WHEN 2 THEN 'yesterday' ELSE '' END ||
           '","snippet":"Laveuse ' || CAST(o_custkey AS VARCHAR(20)) || '","details":{"Frigo":"Oui","Niveau":' || CAST(o_orderkey % 5 AS VARCHAR(20)) || '},"sellerName":"Vendeur ' || CAST(o_custkey AS VARCHAR(20)) || '"}]}' ||
           ',{"adId":"a' || CAST(o_orderkey AS VARCHAR(20)) || '","name":"Second","price":1,"posterName":"Vendeur","related":{"deep":[[{"listingId":"c' ||
           CAST(o_custkey AS VARCHAR(20)) || '","title":"Voisin ' || CAST(o_orderkey AS VARCHAR(20)) || '","url":"' ||
           CASE WHEN o_orderkey % 2 = 0 THEN '/v/1' ELSE 'https://example.org/v' END || '","location":null,"body":"","userName":{"name":"Vendeur"}}]]}}]}}</SCRIPT>' AS html
    FROM orders
"""
CARDS = f"""
    SELECT o_orderkey AS ord, CAST(floor(o_orderkey / 64) AS BIGINT) AS page_id,
           'https://example.org/marketplace/item/' || CAST(o_custkey AS VARCHAR(20)) || '/?ref=' || CAST(o_orderkey AS VARCHAR(20)) AS href,
           CASE WHEN o_orderkey % 5 = 0 THEN 'Publié il y a 3 jours\n' ELSE '' END || coalesce({PRICES}, 'Gratuit') || '\n' || {TITLES} ||
           coalesce('\n' || {PLACES}, '') AS text
    FROM orders
""".replace("\\n", "\n")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the SQL texts above over the tables in ``sf_dir``."""
    name, key = next((t, k) for t, k in (("events", "event_id"), ("orders", "o_orderkey")) if f"FROM {t}" in sql)
    spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key).createOrReplaceTempView(f"rentmill_{name}")
    return spark.sql(sql.replace(f"FROM {name}", f"FROM rentmill_{name}"))
