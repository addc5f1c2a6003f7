"""A small round of our own, as people file it, from CSV to means, medians and basket, against plain Python."""

import csv
import io
import math
import statistics

import pytest

from souk import config
from souk.operators import basket as B
from souk.operators import dims as D
from souk.operators import impute as I
from souk.operators import means as M
from souk.operators import rounds as RD
from souk.sources import files

PRICED = [i for i, _, _ in config.BASKET_ITEMS]
WEIGHED = set(config.UNIT_PRICED_ITEMS)


def made_rows():
    """Three settlements of two districts; gaps, a sentinel, a zero weight, null tokens and trailing blanks."""
    rows = []
    for k, (settlement, market) in enumerate([("lake", "north"), ("lake", "north "), ("lake", "NA"), ("rhino", "east"), ("rhino", "west"),
                                              ("hill", "top"), ("hill", "top"), ("hill", " ")]):
        row = {"month": "10" if k != 7 else "13", "settlement": settlement, "market": market}
        for n, item in enumerate(PRICED):
            value = 100 * (n + 1) + 37 * k + (k * k) % 11
            row[f"price_{item}"] = "" if (n + k) % 5 == 0 else "99" if (n, k) == (3, 1) else str(value)
            if item in WEIGHED:
                row[f"weight_{item}"] = "0" if (item, k) == ("fish", 3) else "NA" if (n + k) % 7 == 0 else str(1 + (n + k) % 3)
        rows.append(row)
    return rows


SETTLEMENTS = "NAME0,DISTRICT,OBJECTID,NAME,TYPE,Longitude,Latitude\nlake,water,1,Uganda,settlement,30.5,1.5\n" \
              "rhino camp,plain,2,Uganda,settlement,31.5,3.5\nhill,water,3,Uganda,settlement,32.5,2.5\n"
DISTRICTS = "OBJECTID,F15Regions,DName2019\n1,ACHOLI,WATER\n2,CENTRAL,PLAIN\n"


def number(row, column):
    v = row[column]
    return None if v in config.NULL_TOKENS or float(v) == config.SENTINEL_MISSING else float(v)


def price(row, item):
    p = number(row, f"price_{item}")
    if item not in WEIGHED:
        return p
    w = number(row, f"weight_{item}")
    if p is None or w is None:
        return None
    return p / w if w else math.inf


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("round")
    rows, text = made_rows(), io.StringIO()
    writer = csv.DictWriter(text, rows[0].keys())
    writer.writeheader()
    writer.writerows(rows)
    for name, content in (("round", text.getvalue()), ("settlements", SETTLEMENTS), ("districts", DISTRICTS)):
        (folder / f"{name}.csv").write_text(content)
    numbers = [c for c in rows[0] if c.startswith(("price_", "weight_"))]
    this = files.read_round(files.read_table(spark, str(folder / "round.csv"), numeric=numbers))
    settlements = D.prepare_settlements(files.read_table(spark, str(folder / "settlements.csv"), numeric=["OBJECTID", "Longitude", "Latitude"]),
                                        centroid_district="water")
    districts = D.prepare_districts(files.read_table(spark, str(folder / "districts.csv"), numeric=["OBJECTID"]))
    obs = RD.stack_and_enrich([this], D.settlement_lookup(settlements), D.district_lookup(districts))
    kept = [dict(r, settlement=r["settlement"].replace("rhino", "rhino camp")) for r in rows if r["month"] == "10"]
    return settlements, RD.item_prices(obs), kept


PLACES = {"lake": ("water", "west nile"), "hill": ("water", "west nile"), "rhino camp": ("plain", "south west")}


def grouped(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def mean(values):
    values = [v for v in values if v is not None]
    return None if not values or any(map(math.isinf, values)) else statistics.mean(values)


def test_geography(filed):
    settlements, items, rows = filed
    centre = settlements.where("settlement = 'water'").first()
    assert (centre.longitude, centre.latitude) == (31.5, 2.0)
    got = {r.settlement: (r.district, r.regions) for r in items.collect()}
    assert got == PLACES and items.count() == len(rows) == 7


@pytest.mark.parametrize("level,key", [("settlement", lambda r: r["settlement"]), ("region", lambda r: PLACES[r["settlement"]][1]),
                                       ("district", lambda r: PLACES[r["settlement"]][0]), ("national", lambda r: None)])
def test_means(filed, level, key):
    _, items, rows = filed
    column = {"settlement": "settlement", "region": "regions", "district": "district"}.get(level)
    got = {r[column] if column else None: r for r in M.area_means(items, level).collect()}
    want = grouped(rows, key)
    assert got.keys() == want.keys()
    for area, own in want.items():
        for item in PRICED:
            expected = mean([price(r, item) for r in own])
            assert got[area][f"price_{item}"] == (None if expected is None else pytest.approx(expected, rel=1e-11)), (area, item)


def test_medians_and_basket(filed):
    _, items, rows = filed
    medians = {r.settlement: r for r in I.settlement_medians(items, ["October"]).collect()}
    basket = {r.settlement: r for r in B.meb(items, ["October"]).collect()}
    measures = [i for i in PRICED if f"price_{i}" not in {e.lower() for e in config.MEDIAN_EXCLUDED}]
    table = {}
    for s, own in grouped(rows, lambda r: r["settlement"]).items():
        for item in measures:
            v = [x for x in (price(r, item) for r in own) if x is not None]
            table[s, item] = statistics.median(v) if v else None
            assert medians[s][f"price_{item}"] == (None if not v else pytest.approx(table[s, item])), (s, item)
    for level in (lambda s: s, lambda s: PLACES[s][0], lambda s: PLACES[s][1], lambda s: PLACES[s][1]):
        for item in measures:
            for area, places in grouped(list(PLACES), level).items():
                have = [table[s, item] for s in places if table[s, item] is not None]
                for s in places:
                    if table[s, item] is None and have:
                        table[s, item] = sum(have) / len(have)
    for s in PLACES:
        for item, factors, _ in config.BASKET_ITEMS:
            if item not in measures:
                continue
            v = table[s, item]
            cost = None if v is None else v * math.prod(factors) * config.HOUSEHOLD_SIZE
            got = basket[s][f"meb_{item}"]
            assert got == cost or got == pytest.approx(cost, abs=0.5000001), (s, item)
