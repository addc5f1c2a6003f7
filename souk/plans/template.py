"""The report template of the bound workflow, by rule from the configuration."""

from __future__ import annotations

from souk import config
from souk.operators.report import NUMBER, TEXT, Cell

PRICES = [f"price_{i}" for i in config.BIND_ITEMS]
MEB = ([f"meb_{i}" for i in config.BIND_ITEMS] + ["meb_hygiene"] + [f"meb_{k}" for k, _ in config.BASKET_FIXED_OTHER]
       + ["meb_other_hdd", "meb_energy", "meb_food", "meb_full"])
REGIONS = (config.REGION_DEFAULT, config.REGION_OTHER)


def settlements() -> list[str]:
    return [f"nation_{i}/{s}" for i in range(config.BIND_NATIONS) for s in config.BIND_SEGMENTS]


def changes(measures: list[str]) -> list[str]:
    return [f"{m.removeprefix('price_')}_perct_{r}" for r in ("march", "last_round") for m in measures]


def _baskets(prefix: str) -> list[str]:
    return [prefix + m if m in ("meb_food", "meb_full") else m for m in MEB]


def cells() -> list[Cell]:
    """Prices, changes, baskets, counts, ranks, top answers and area scalars, in the report's order."""
    numbers: list[str] = []
    tags = [r.replace(" ", "") for r in REGIONS]
    numbers += [f"national_{p}" for p in PRICES]
    numbers += [f"{t}_{p}" for t in tags for p in PRICES]
    numbers += [f"{s}_{p}" for s in settlements() for p in PRICES]
    numbers += [f"national_{c}" for c in changes(PRICES) + changes(["national_meb_food", "national_meb_full"])]
    numbers += [f"{t}_{c}" for t in tags for c in changes(PRICES) + changes(["regional_meb_food", "regional_meb_full"])]
    numbers += [f"{s}_{c}" for s in settlements() for c in changes(PRICES) + changes(["meb_food", "meb_full"])]
    numbers += [f"{s}_{m}" for s in settlements() for m in MEB]
    numbers += [f"{t}_{m}" for t in tags for m in _baskets("regional_")]
    numbers += [f"national_{m}" for m in _baskets("national_")]
    out = [(n, NUMBER, n) for n in numbers]
    out.append(("national_regions", TEXT, "national_regions"))
    levels = ("national", *REGIONS)
    out += [(n, NUMBER, n) for v in ("num_market_assessed", "num_assessed") for n in (f"{v}_{lv}" for lv in levels)]
    areas = len(settlements())
    out += [(n, TEXT, n) for n in (f"expansive_rank_{r}" for r in (1, 2, 3, areas - 2, areas - 1, areas))]
    for variables, k in ((config.BIND_TOP3_VARS, 3), (config.BIND_TOP2_VARS, 2)):
        for n in (f"{a}_{v}_{r}" for a in config.REPORT_AREAS for v in variables for r in range(1, k + 1)):
            out += [(f"numbers_{n}", NUMBER, f"numbers_{n}"), (f"dependent_var_value_{n}", TEXT, f"dependent_var_value_{n}")]
    out += [(n, NUMBER, n) for n in (f"{a}_{v}" for a in config.REPORT_AREAS for v in config.BIND_NUMERIC)]
    for n in (f"{a}_{k.replace('.', '_')}" for a in config.REPORT_AREAS for k in config.BIND_AREA_KEYS
              if k.split(".")[0] in config.BIND_SHARE_VARS):
        out += [(f"numbers_{n}", NUMBER, f"numbers_{n}"), (f"dependent_var_value_{n}", TEXT, f"dependent_var_value_{n}")]
    return out
