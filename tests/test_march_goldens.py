"""The original's own baseline (March) round and area lists, read as plain
CSV input, against the golden values of FIXTURES.md section 3.

Point ``SOUK_MARCH_CSV``, ``SOUK_SETTLEMENTS_CSV`` and ``SOUK_DISTRICTS_CSV``
at the three shipped CSV files; without them the tests are skipped."""

import os

import pytest
from pyspark.sql import functions as F

from souk.functions import exprs as X
from souk.operators import dims as D
from souk.operators import impute as I
from souk.operators import means as M
from souk.operators import rounds as RD
from souk.sources import files

MARCH = os.environ.get("SOUK_MARCH_CSV", "")
SETTLEMENTS_CSV = os.environ.get("SOUK_SETTLEMENTS_CSV", "")
DISTRICTS_CSV = os.environ.get("SOUK_DISTRICTS_CSV", "")
pytestmark = pytest.mark.skipif(
    not all(p and os.path.exists(p) for p in (MARCH, SETTLEMENTS_CSV, DISTRICTS_CSV)),
    reason="shipped CSV inputs not given")

# (settlement, regions, district, rows, distinct markets, mean maize_g, median oil,
#  mean charcoal per unit, mean firewood per unit) -- FIXTURES.md section 3
SETTLEMENTS = [
    ("nakivale", "south west", "isingiro", 3, 3, 816.666667, 5600, 2000, 200),
    ("oruchinga", "south west", "isingiro", 3, 1, 800, 6000, 1000, 200),
    ("kyangwali", "south west", "hoima", 6, 3, 650, 6000, 1050, 366),
    ("kiryandongo", "south west", "kiryandongo", 5, 2, 1121.8, 6000, None, 333.333333),
    ("rwamwanja", "south west", "kamwenge", 2, 2, 925, 5625, 1000, 500),
    ("kyaka", "south west", "kyegegwa", 4, 4, 950, 5625, None, 213),
    ("palabek", "west nile", "lamwo", 3, 3, 1000, 5000, 666, 198),
    ("adjumani", "west nile", "adjumani", 3, 3, 1500, 6000, 775, 296),
    ("imvepi", "west nile", "arua", 2, 2, 1000, 7937, 250, 300),
    ("rhino camp", "west nile", "arua", 3, 3, 1389, 6250, 500, 158.119658),
    ("lobule", "west nile", "koboko", 4, 2, 1229.25, 5500, 525, 133.441558),
    ("palorinya", "west nile", "moyo", 4, 3, 1277, 5000, 5000, 500),
    ("bidibidi", "west nile", "yumbe", 16, 8, 1001.9375, 5000, 781.25, 587.5),
]
# (level, rows, distinct markets, settlements, mean maize_g, soap, firewood, charcoal)
LEVELS = [
    ("south west", 23, 15, 6, 869.956522, 3550, 304.925926, None),
    ("west nile", 35, 24, 7, 1138.911765, 2357.142857, 414.003577, 1169.228571),
    ("national", 58, 39, 13, 1030.385965, 2762.264151, 376.958337, None),
]


def approx(v):
    return None if v is None else pytest.approx(v, abs=1e-6)


@pytest.fixture(scope="module")
def march(spark):
    text = ["year", "month", "week", "settlement", "market"]
    raw = files.read_table(spark, MARCH)
    raw = files.read_table(spark, MARCH, numeric=[c for c in raw.columns if c not in text])
    rnd = files.read_round(raw)
    sl = files.read_table(spark, SETTLEMENTS_CSV, numeric=["OBJECTID", "Longitude", "Latitude"])
    dl = files.read_table(spark, DISTRICTS_CSV, numeric=["OBJECTID"])
    settlements = D.prepare_settlements(sl, centroid_district="adjumani")
    obs = RD.stack_and_enrich([rnd], D.settlement_lookup(settlements),
                              D.district_lookup(D.prepare_districts(dl)))
    return settlements, RD.item_prices(obs)


def test_centroid(spark, march):
    settlements, _ = march
    adj = settlements.where(F.col("settlement") == "adjumani").first()
    assert adj.longitude == pytest.approx(31.862365391, abs=1e-9)
    assert adj.latitude == pytest.approx(3.346334130, abs=1e-9)


def test_settlement_goldens(spark, march):
    _, ip = march
    means = {r.settlement: r for r in M.area_means(ip, "settlement").collect()}
    med = {r.settlement: r for r in I.settlement_medians(ip, ["March"]).collect()}
    counts = {r.settlement: r for r in ip.groupBy("settlement").agg(
        F.count(F.lit(1)).alias("rows"), X.count_distinct_na("market_final").alias("markets")).collect()}
    assert len(means) == 13
    for s, reg, dist, rows, mk, maize, oil, charcoal, firewood in SETTLEMENTS:
        m = means[s]
        assert (m.regions, m.district) == (reg, dist), s
        assert (counts[s].rows, counts[s].markets) == (rows, mk), s
        assert m.price_maize_g == approx(maize), s
        assert med[s].price_oil == approx(oil), s
        assert m.price_charcoal == approx(charcoal), s
        assert m.price_firewood == approx(firewood), s


def test_region_and_national_goldens(spark, march):
    _, ip = march
    reg = {r.regions: r for r in M.area_means(ip, "region").collect()}
    reg["national"] = M.area_means(ip, "national").first()
    counts = {r.regions: r for r in ip.groupBy("regions").agg(
        F.count(F.lit(1)).alias("rows"), X.count_distinct_na("market_final").alias("markets"),
        F.count_distinct("settlement").alias("settlements")).collect()}
    nat = ip.agg(F.count(F.lit(1)).alias("rows"), X.count_distinct_na("market_final").alias("markets"),
                 F.count_distinct("settlement").alias("settlements")).first()
    counts["national"] = nat
    for level, rows, mk, sett, maize, soap, firewood, charcoal in LEVELS:
        c, m = counts[level], reg[level]
        assert (c.rows, c.markets, c.settlements) == (rows, mk, sett), level
        assert m.price_maize_g == approx(maize), level
        assert m.price_soap == approx(soap), level
        assert m.price_firewood == approx(firewood), level
        assert m.price_charcoal == approx(charcoal), level


def test_beans_soap_milk_goldens(spark, march):
    _, ip = march
    means = {r.settlement: r for r in M.area_means(ip, "settlement").collect()}
    med = {r.settlement: r for r in I.settlement_medians(ip, ["March"]).collect()}
    n = {r.settlement: r.n for r in ip.groupBy("settlement").agg(F.count("price_beans").alias("n")).collect()}
    for s, bn, bmean, bmed, soap, milk, oil in [
            ("adjumani", 2, 3650, 3650, 3500, 2500, 6000),
            ("kyangwali", 6, 2966.666667, 3000, 4000, 2000, 6000),
            ("rhino camp", 2, 3583.5, 3583.5, 2000, 2500, 6250),
            ("bidibidi", 4, 3214, 3333, 2000, 1000, 5312.5)]:
        assert n[s] == bn, s
        assert means[s].price_beans == approx(bmean) and med[s].price_beans == approx(bmed), s
        assert means[s].price_soap == approx(soap) and means[s].price_milk == approx(milk), s
        assert means[s].price_oil == approx(oil), s


def test_basket_on_march(spark, march):
    from souk.operators import basket as B
    _, ip = march
    meb = {r.settlement: r for r in B.meb(ip, ["March"]).collect()}
    adj = meb["adjumani"]
    # soap median 3500 -> 3500 * 0.45 * 5 = 7875; hygiene = 6597 fixed + soap
    assert adj.meb_soap == 7875 and adj.meb_hygiene == 6597 + 7875
    assert adj.meb_other_hdd == 5961  # 71533 / 12 rounded half-even
    # March has no dodo/cassava/fish weights, so those unit prices -- and the
    # food and full totals -- stay NULL (nothing to fill them from)
    assert all(r.meb_food is None and r.meb_full is None for r in meb.values())
    assert "price_soap" not in B.meb(ip, ["March"]).columns
