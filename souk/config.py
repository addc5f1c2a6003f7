"""Defaults of the workflow, gathered in one place.

Every function in the library takes these as arguments; this module only
holds the defaults.  Two groups: the values of the original survey workflow
(fixed values, they must stay as they are for equal results) and the binding
of that workflow onto the TPC-H-like test tables (see README).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values of the original workflow (must equal it for right results).
# ---------------------------------------------------------------------------

MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

# Null tokens of the CSV inputs.
NULL_TOKENS = ("", " ", "NA")

# Sentinel for "no answer" in numeric columns, and the text meaning 1.
SENTINEL_MISSING = 99
TEXT_ONE = "yes"

# Round tags: this round 4, last round 3, anything else 1.
ORDER_THIS, ORDER_LAST, ORDER_OTHER = 4, 3, 1

# Region rule: sub-regions that make up "west nile"; everything else is
# "south west".
REGION_DEFAULT = "south west"
REGION_OTHER = "west nile"
WEST_NILE_SUBREGIONS = ("Acholi", "West nile")

# Items priced per unit of weight (price / weight).
UNIT_PRICED_ITEMS = ("dodo", "cassava", "fish", "firewood", "charcoal")

# Items left out of the settlement median (the basket input).
MEDIAN_EXCLUDED = (
    "price_maize_g", "price_underwear", "price_charcoal", "price_pads",
    "price_DAP", "price_NKP", "price_malathion", "price_millet_f",
)

# Basket (minimum expenditure basket) quantities per person; a household is
# 5 people.  (item, quantity factors applied left to right, group); firewood
# is 1.1 per day over 30 days.
HOUSEHOLD_SIZE = 5
BASKET_ITEMS = (
    ("maize_f", (8.7,), "food"),
    ("beans", (5.4,), "food"),
    ("sorghum", (1.5,), "food"),
    ("oil", (0.75,), "food"),
    ("salt", (0.15,), "food"),
    ("milk", (0.3,), "food"),
    ("dodo", (3,), "food"),
    ("fish", (0.6,), "food"),
    ("cassava", (0.6,), "food"),
    ("soap", (0.45,), "hygiene"),
    ("firewood", (1.1, 30), "energy"),
)
# The food total adds its lines in this order.
FOOD_TOTAL_ORDER = ("maize_f", "beans", "sorghum", "oil", "milk", "cassava", "salt",
                    "dodo", "fish")
# Fixed monthly costs.
BASKET_FIXED_HYGIENE = (
    ("reusable_pads", 4667), ("jerry_can", 1090), ("bucket", 632), ("hand_washing", 208),
)
BASKET_FIXED_OTHER = (
    ("clothing", 3806), ("water", 3750), ("livelihoods", 37705), ("education", 28667),
    ("transport", 11001), ("health", 2669), ("communication", 4256),
)
BASKET_LIGHTING = 5000
# Yearly one-off household items, spread over 12 months.
BASKET_YEARLY = (
    ("blanket", 45000), ("pans", 13125), ("plates", 4885), ("spoon", 3538),
    ("cups", 3985), ("mingle", 1000),
)

# Top answers: three for these select-multiple/select-one questions, two for
# the price-reason questions; areas reported.
TOP3_VARS = (
    "payment_type", "safety_reason_less_secure", "safety_reason_more_secure",
    "item_scarcity_reason", "price_increase_item", "price_decrease_item", "challenge",
)
_REASON_ITEMS = ("cereal", "cassava", "beans", "vegetables", "milk", "fish", "oil",
                 "salt", "wash", "energy")
TOP2_INCREASE_VARS = tuple(f"{i}_increase_reason" for i in _REASON_ITEMS)
TOP2_DECREASE_VARS = tuple(f"{i}_decrease_reason" for i in _REASON_ITEMS)
REPORT_AREAS = ("uganda", "south west", "west nile")
MEAN_VARS = ("agents_number", "customer_number")
SHARE_VARS = ("mobile_accepted", "vendor_number", "vendors_change", "safety",
              "item_scarcity", "stock_runout")

# Report cell prefixes per region, and the labels of the national rows.
NATIONAL_LABEL = "national"
NATIONWIDE_LABEL = "nationwide"

# Exported table names: the means-and-change set and the basket set.
PRICE_TABLE_NAMES = (
    "Market mean price", "Settlement mean price", "District Mean", "Region mean",
    "National level mean", "Percent change Settlement", "Percent change Region",
    "Percent change National", "Rank settlements",
)
BASKET_TABLE_NAMES = (
    "Settlement MEB", "Regional MEB", "National MEB", "Percent change MEB Settlment",
    "Percent change MEB Regional", "Percent change MEB National",
)

# ---------------------------------------------------------------------------
# Binding of the workflow onto the TPC-H-like test tables.
# ---------------------------------------------------------------------------

THIS_ROUND, LAST_ROUND, BASELINE_ROUND = "October", "September", "March"
ROUND_MONTHS = (3, 9, 10)
BIND_ITEMS = ("economy", "large", "medium", "promo", "small", "standard")
BIND_UNIT_ITEMS = ("economy", "large")
BIND_WEST_NILE = ("Africa", "Middle east")
# Basket quantities per person of the bound items (all food).
BIND_BASKET_ITEMS = (
    ("economy", (8.7,), "food"),
    ("large", (5.4,), "food"),
    ("medium", (1.5,), "food"),
    ("promo", (0.75,), "food"),
    ("small", (0.15,), "food"),
    ("standard", (0.3,), "food"),
)
BIND_FOOD_TOTAL_ORDER = BIND_ITEMS
BIND_CENTROID_DISTRICT = "nation_0"
BIND_TOP3_VARS = ("event_types", "o_orderpriority")
BIND_TOP2_VARS = ("o_orderstatus", "home_region")
BIND_SELECT_ONE = ("o_orderpriority", "o_orderstatus", "home_region")
BIND_NUMERIC = ("o_totalprice", "customer_number")
BIND_SHARE_VARS = ("o_orderstatus", "mobile_accepted")
#: Columns of the area-by-variable table: ``<question>.<answer>``, ``NA`` for a numeric question.
BIND_AREA_KEYS = (
    "customer_number.NA", "o_totalprice.NA",
    "event_types.click", "event_types.error", "event_types.purchase", "event_types.signup", "event_types.view",
    "home_region.0", "home_region.1", "home_region.2", "home_region.3", "home_region.4",
    "mobile_accepted.no", "mobile_accepted.yes",
    "o_orderpriority.1-URGENT", "o_orderpriority.2-HIGH", "o_orderpriority.3-MEDIUM",
    "o_orderpriority.4-NOT SPECIFIED", "o_orderpriority.5-LOW",
    "o_orderstatus.F", "o_orderstatus.O", "o_orderstatus.P",
)
BIND_FLAG_WORD = "purchase"
BIND_NATIONS = 25
BIND_SEGMENTS = ("automobile", "building", "furniture", "household", "machinery")
#: The analysis plan: question, type, grouping variable, repeat variable.
BIND_PLAN = (
    ("o_orderpriority", "categorical", "country", None),
    ("o_orderpriority", "categorical", "regions", None),
    ("o_orderpriority", "categorical", "regions", "o_orderstatus"),
    ("o_orderstatus", "categorical", "home_region", None),
    ("home_region", "categorical", "country", "o_orderpriority"),
    ("home_nation", "categorical", "country", None),
    ("event_types", "categorical", "country", None),
    ("event_types", "categorical", "regions", "mobile_accepted"),
    ("mobile_accepted", "categorical", "regions", None),
    ("o_totalprice", "numerical", "home_region", None),
    ("o_totalprice", "numerical", "regions", "o_orderstatus"),
    ("customer_number", "numerical", "country", None),
    ("customer_number", "numerical", "no_such_column", None),
)
#: The questionnaire: question, type and choice list.
BIND_QUESTIONS = (
    ("o_orderpriority", "select_one priorities"), ("o_orderstatus", "select_one statuses"),
    ("home_region", "select_one region_names"), ("home_nation", "select_one nation_names"),
    ("event_types", "select_multiple event_names"), ("mobile_accepted", "select_one yes_no"),
    ("o_totalprice", "decimal"), ("customer_number", "integer"),
)
