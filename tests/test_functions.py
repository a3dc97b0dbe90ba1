"""Parsers, literal rows against expected rows."""

from __future__ import annotations

import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession, functions as F

from rentmill.functions import lexicons
from rentmill.functions.appliances import detect_appliances
from rentmill.functions.dwelling import parse_dwelling
from rentmill.functions.geo import haversine_km, locate
from rentmill.functions.price import parse_price
from rentmill.functions.text import attribute_text, fold, joined

NBSP, HALF = "\u00a0", "½"


def expected_fold(value: str) -> str:
    text = unicodedata.normalize("NFKC", value)
    for chars, to in ((lexicons.APOSTROPHES, "'"), (lexicons.DASHES, "-"), (lexicons.FRACTION_SLASH, "/")):
        for c in chars:
            text = text.replace(c, to)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
    return " ".join(text.split())


def test_fold(spark: SparkSession) -> None:
    texts = ["Gâtineau — 4½,  LAVEUSE/SÉCHEUSE incluses", f"1{NBSP}450 $", "l’unité", "", "ﬁn™ … ²", "ΟΔΟΣ Σ", "a\x1cb\x85c d", "x´y"]
    texts += [f"a{chr(i)}b" for i in [*range(1, 0x2000), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFEF)] if chr(i) != "Σ" and unicodedata.category(chr(i)) != "Cn"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", fold(F.col("t")).alias("f")).collect()
    wrong = [(r.t, r.f, expected_fold(r.t)) for r in rows if r.f != expected_fold(r.t)]
    assert not wrong, wrong[:5]
    assert spark.createDataFrame([(None,)], "t string").select(fold(F.col("t"))).first()[0] == ""


def test_fold_styled_letters(spark: SparkSession) -> None:
    """Mathematical and enclosed letters, squares such as m2, and compatibility ideographs."""
    texts = ["\U0001d5f9\U0001d5ee\U0001d603\U0001d5f2\U0001d602\U0001d600\U0001d5f2 \U0001d7cf\U0001d7d2\U0001d7d3\U0001d7ce $", "80 \u33a1", "\U0001f130\U0001f131"]
    points = [*range(0x3000, 0x3400), *range(0xF900, 0xFB50), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x2F800, 0x2FA20)]
    texts += [f"a{chr(i)}b" for i in points if unicodedata.category(chr(i)) != "Cn"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", fold(F.col("t")).alias("f")).collect()
    wrong = [(r.t, r.f, expected_fold(r.t)) for r in rows if r.f != expected_fold(r.t)]
    assert not wrong, wrong[:5]


def test_attribute_text_and_corpus(spark: SparkSession) -> None:
    row = spark.createDataFrame([({"b": "É", "a": None},)], "m map<string,string>")
    assert row.select(attribute_text(F.col("m"))).first()[0] == "a None b É"
    texts = spark.createDataFrame([("A", None, "", "B")], "a string, b string, c string, d string")
    assert texts.select(joined([F.col(c) for c in "abcd"], " . ")).first()[0] == "a . b"


PRICES = [
    (("1450$",), "1450", "unknown", "1450"), ((f"1{NBSP}450 $",), "1450", "unknown", "1450"), (("1,450$",), "1450", "unknown", "1450"),
    (("1 450,00 $",), "1450", "unknown", "1450"), (("$1,450.00",), "1450", "unknown", "1450"), (("1450 CAD",), "1450", "unknown", "1450"),
    (("CA$1,450",), "1450", "unknown", "1450"), (("1450 dollars",), "1450", "unknown", "1450"), (("$1450/month",), "1450", "month", "1450"),
    (("650 $/semaine",), "650", "week", "2816.67"), (("95 $ par nuit",), "95", "day", "2889.58"), (("Prix sur demande",), None, None, None),
    (("Beau 3 1/2 rénové",), None, None, None), (("Appelez au 819-555-0123",), None, None, None),
    (("Stationnement 75 $, chauffage 50 $/mois, loyer 1 395 $/mois",), "1395", "month", "1395"),
    (("1 500 $", "titre", "chauffage 50 $ en sus"), "1500", "unknown", "1500"), ((None, "", "Loyer 1 250 $/mois"), "1250", "month", "1250"),
    (("0 $",), None, None, None), (("Loyer: 1425 par mois",), "1425", "month", "1425"), (("à discuter", "900 $"), None, None, None),
    (("unit 12 450 $",), "12450", "unknown", "12450"), (("0 $", "700 $"), "700", "unknown", "700"),
]


def test_prices(spark: SparkSession) -> None:
    table = spark.createDataFrame([(i, *(list(s) + [None] * 3)[:3]) for i, (s, *_) in enumerate(PRICES)], "i int, a string, b string, c string")
    got = {r.i: r.p for r in table.select("i", parse_price([F.col(c) for c in "abc"]).alias("p")).collect()}
    for i, (sources, amount, period, monthly) in enumerate(PRICES):
        if amount is None:
            assert got[i] is None, sources
        else:
            assert (got[i].amount, got[i].period, got[i].monthly) == (Decimal(amount), period, Decimal(monthly)), sources


PLACES = [
    ("Gatineau, QC J8Y 3X5", "QC", "gatineau", "J8Y", "postal:J8Y"), ("Ottawa", "ON", "ottawa", None, "city:ottawa"), ("Hull (QC)", "QC", "hull", None, "token:qc"),
    ("K1A-0B1 Gatineau", "ON", "gatineau", "K1A", "postal:K1A"), ("V6B1A1", "other", None, "V6B", "postal:V6B"), ("Montréal, Québec", "QC", None, None, "token:qc"),
    ("Gatineau, Ontario", "ON", "gatineau", None, "token:on"), ("Aylmer", "QC", "aylmer", None, "city:aylmer"), (None, None, None, None, "none"),
    ("J8Y seul", None, None, None, "none"), ("j8y--3x5", None, None, None, "none"), ("minutes de Gatineau, Kanata", "ON", "kanata", None, "city:kanata"),
]


def test_places(spark: SparkSession) -> None:
    table = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PLACES)], "i int, t string")
    null = F.lit(None).cast("double")
    got = {r.i: r.p for r in table.select("i", locate(F.col("t"), null, null, (45.4765, -75.7013)).alias("p")).collect()}
    for i, (text, *expected) in enumerate(PLACES):
        assert [got[i].province, got[i].city, got[i].postal_prefix, got[i].evidence] == expected, text
    km = spark.range(1).select(haversine_km(F.lit(45.4765), F.lit(-75.7013), F.lit(46.8139), F.lit(-71.2080))).first()[0]
    assert km == pytest.approx(376.6, abs=1.5)


APPLIANCES = [
    ("4 1/2 avec laveuse-sécheuse incluses", {"washer": "present", "dryer": "present", "fridge": "unknown"}),
    ("branchement laveuse-sécheuse au sous-sol", {"washer": "absent", "dryer": "absent"}), ("washer/dryer hookup available", {"washer": "absent", "dryer": "absent"}),
    ("laveuse et sécheuse partagées", {"washer": "absent", "dryer": "absent"}), ("laveuse non incluse", {"washer": "absent"}), ("aucune laveuse", {"washer": "absent"}),
    ("Logement sans laveuse ni sécheuse", {"washer": "absent", "dryer": "absent"}), ("Logement sans balcon, avec laveuse et sécheuse", {"washer": "present", "dryer": "present"}),
    ("Frigo et cuisinière inclus. Espace pour laveuse-sécheuse.", {"fridge": "present", "stove": "present", "washer": "absent", "dryer": "absent"}),
    ("Pas de lave-vaisselle. Laveuse et sécheuse incluses.", {"dishwasher": "absent", "washer": "present"}),
    ("Laveuse-sécheuse incluses dans l'unité. Branchement supplémentaire au sous-sol.", {"washer": "present", "dryer": "present"}),
    ("Condo with dishwasher and fridge", {"dishwasher": "present", "washer": "unknown", "fridge": "present"}), ("Draps et serviettes fournis", {"stove": "unknown"}),
    ("Électroménagers inclus", {"fridge": "present", "stove": "present", "washer": "unknown"}), ("3 1/2 tout inclus", {"washer": "unknown", "fridge": "unknown"}),
    ("laveuses et sécheuses fournies", {"washer": "present", "dryer": "present"}), ("espace laveuse-sécheuse", {"washer": "present", "dryer": "absent"}),
    ("fourni laveuse", {"washer": "absent"}), ("", {"washer": "unknown"}),
]


def test_appliances(spark: SparkSession) -> None:
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(APPLIANCES)], "i int, t string").withColumn("f", fold(F.col("t")))
    got = {r.i: r.asDict() for r in table.select("i", *(c.alias(n) for n, c in detect_appliances(F.col("f")).items())).collect()}
    for i, (text, expected) in enumerate(APPLIANCES):
        assert {n: got[i][n].status for n in expected} == expected, text
    assert got[0]["washer"].evidence == "laveuse" and got[1]["washer"].evidence == "hookup:branchement"
    assert got[13]["stove"].evidence == "bundle:electromenagers inclus"


DWELLINGS = [
    ("Beau 4 1/2 rénové", False, 4.5, 2.0, None, "rooms:4.5"), (f"1{HALF} meublé", False, 1.5, 0.0, None, "rooms:1.5"),
    ("Grand 4-1/2 disponible", False, 4.5, 2.0, None, "rooms:4.5"), ("Logement 1 450 $ par mois", False, None, None, "apartment", "unit:logement"),
    ("5 1/2 avec 3 chambres à coucher", False, 5.5, 3.0, None, "rooms:5.5"), ("2 bdrm", None, None, 2.0, None, None), ("Chambre à louer dans un 5 1/2", True, 5.5, 3.0, None, "room:chambre a louer"),
    ("townhouse", False, None, None, "house", "unit:townhouse"), ("jumelé", False, None, None, "townhouse", "unit:jumele"), ("14 1/2", None, None, None, None, None), ("3 pcs", False, 3.0, 0.5, None, "rooms:3.0"),
    ("", None, None, None, None, None),
]


def test_dwellings(spark: SparkSession) -> None:
    table = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DWELLINGS)], "i int, t string").withColumn("f", fold(F.col("t")))
    got = {r.i: r.d for r in table.select("i", parse_dwelling(F.col("f")).alias("d")).collect()}
    for i, (text, *expected) in enumerate(DWELLINGS):
        d = got[i]
        assert [d.is_room, d.rooms, d.bedrooms, d.unit_type, d.evidence] == expected, text


def test_fold_of_every_character(spark: SparkSession) -> None:
    """All assigned characters but surrogates, each between letters, and syllables in words; nothing leaves the JVM."""
    points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and not 0x3400 <= i < 0x4DC0 and not 0x20000 <= i < 0x2F800 and not 0x30000 <= i < 0xE0000 and not i >= 0xF0000]
    texts = [f"a{chr(i)}b" for i in points if chr(i) != "Σ" and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    texts += ["세탁기 포함 Laveuse", "각힣가 \U0001d5f9", "ﷺ ﻻ", "кириллица Ё й"]
    folded = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", fold(F.col("t")).alias("f"))
    assert "Python" not in folded._jdf.queryExecution().executedPlan().toString()
    wrong = [(r.t, r.f, expected_fold(r.t)) for r in folded.collect() if r.f != expected_fold(r.t)]
    assert not wrong, (len(wrong), wrong[:5])


def test_usual_characters_are_spared_the_rare_ones() -> None:
    from rentmill.functions import text

    several = dict(text.tables()[2])
    assert not any(text.is_usual(c) for c in several if c not in text.FREQUENT) and len(text.usual_tables()[0]) < 200
    assert all(text.is_usual(c) for c in "abcÀÉçœ’‘“”—–…½€  ") and not text.is_usual("ﬁ")


def test_tasks_are_as_large_however_many_rows(spark: SparkSession) -> None:
    from rentmill.tables import spread

    for rows in (1_000, 20_000):
        dealt = spread(spark.range(0, rows, 1, 1), "id", 100)
        sizes = [len(part) for part in dealt.rdd.glom().collect()]
        assert sum(sizes) == rows and max(sizes) < 200
