"""Fixed values of the index: routes, lead times, scenarios, bounds and reasons."""

#: Directed routes of the basket in order, with their passengers of the reference year. Fixed values.
ROUTES = [
    ("BOM", "DEL", 3241735.0), ("DEL", "BOM", 3231661.0), ("BLR", "DEL", 2449074.0), ("DEL", "BLR", 2429999.0),
    ("BOM", "BLR", 1979840.0), ("BLR", "BOM", 1926177.0), ("HYD", "DEL", 1550490.0), ("DEL", "HYD", 1545290.0),
    ("DEL", "CCU", 1454237.0), ("DEL", "PNQ", 1434645.0), ("PNQ", "DEL", 1429688.0), ("CCU", "DEL", 1412124.0),
    ("DEL", "AMD", 1200490.0), ("AMD", "DEL", 1170859.0), ("BOM", "CCU", 1142570.0), ("BLR", "HYD", 1130293.0),
    ("HYD", "BLR", 1121180.0), ("MAA", "DEL", 1111036.0), ("DEL", "MAA", 1110509.0), ("CCU", "BOM", 1096188.0),
    ("BLR", "CCU", 1094428.0), ("CCU", "BLR", 1077187.0), ("DEL", "GAU", 792215.0), ("GAU", "DEL", 776421.0),
]

#: Advance-purchase windows in days. Fixed values.
LEAD_TIMES = (1, 7, 15, 30, 45)

#: Weights of the lead times in each scenario. Fixed values.
SCENARIOS = {
    "near_term_heavy": {1: 0.35, 7: 0.30, 15: 0.20, 30: 0.10, 45: 0.05},
    "uniform": {1: 0.20, 7: 0.20, 15: 0.20, 30: 0.20, 45: 0.20},
    "advance_heavy": {1: 0.05, 7: 0.10, 15: 0.20, 30: 0.30, 45: 0.35},
}
HEADLINE = "uniform"
BASE_VALUE = 100.0

#: Reasons for a missing price: signals of the market, and failures of the collection. Fixed values.
MARKET_SIGNALS = ("sold_out", "no_service")
FAILURES = ("blocked", "robots_disallowed", "rate_limited", "timeout", "parse_error")

#: Plausible fares in the contracts and marts, in the general harvesters, and in result rows of pages. Fixed values.
CONTRACT_FARES = (800, 150_000)
HARVEST_FARES = (1_000, 200_000)
ROW_FARES = (1_200, 90_000)

ITEM_KEY = ["source", "origin", "destination", "lead_time_days", "carrier"]
STRATUM_KEY = ["origin", "destination", "lead_time_days"]

#: Imputation tiers, from the nearest donors to none. Fixed values.
TIER_OBSERVED = "observed"
TIER_ROUTE = "imputed_route_movement"
TIER_LEAD = "imputed_leadtime_movement"
TIER_ALL = "imputed_all_items_movement"
TIER_NONE = "no_donor"
