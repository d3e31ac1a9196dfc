"""Small fixtures shared by the tests, and a brute-force model of matching in plain Python."""

from __future__ import annotations

import random

from venuematch import schemas
from venuematch.config import LOCATION_ALIASES
from venuematch.operators.normalize import with_match_keys

RAW_NAMES = ["name", "address", "location", "cuisines", "rate", "approx_cost(for two people)"]


def listings(spark, rows):
    """Raw rows given as dicts of source columns, numbered in order."""
    data = [(i, *[row.get(name) for name in RAW_NAMES]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, f"row_index BIGINT, {schemas.RAW}")


def catalog(spark, rows):
    """Clean rows given as tuples in catalog column order, with their place in the list as position."""
    placed = [(*row, at) for at, row in enumerate(rows)]
    return with_match_keys(spark.createDataFrame(placed, f"{schemas.CATALOG}, position BIGINT"))


# One venue for each case that the matching tests need: two cuisines of one kind, a place text that contains a city's
# name, no rating, no price.
VENUES = [
    ("1", "Salt Harbour", "Indiranagar", "Bangalore", "italian, pizza", 4.4, 1100, "medium"),
    ("2", "Old Clay Oven", "Jayanagar", "Bangalore", "north indian", 4.1, 350, "low"),
    ("3", "Paper Lantern", "Hauz Khas", "Delhi", "thai", 4.6, 2200, "high"),
    ("4", "Cactus Yard", "Bangalore Road", "Delhi", "tex-mex, cafe", 3.3, 640, "medium"),
    ("5", "Unlit Window", "Indiranagar", "Bangalore", "italian", None, 950, "medium"),
    ("6", "Seven Gates", "Ulsoor", "Bangalore", "italian", 4.7, None, "unknown"),
]


def preferences(spark, rows):
    return spark.createDataFrame(rows, schemas.PREFERENCES)


def random_catalog(seed: int, n: int):
    pick = random.Random(seed)
    cities = ["Bangalore", "Delhi", "Mumbai", "Pune"]
    places = ["Indiranagar", "HAL Indiranagar", "Delhi Gate", "Mumbai Naka", "N", "Old Town", "nagar", "É Quai"]
    cuisines = ["italian", "north indian, chinese", "indian", "tex-mex", "café, thai", "chinese, italian"]
    rows = []
    for i in range(n):
        # A third of all rows share one city, place and cuisine.
        hot = pick.random() < 0.34
        rows.append((
            f"{i:05d}",
            f"Venue {pick.randrange(40)}",
            "Indiranagar" if hot else pick.choice(places),
            "Bangalore" if hot else pick.choice(cities),
            "north indian, chinese" if hot else pick.choice(cuisines),
            pick.choice([None, 0.0, 2.5, 3.75, 4.0, 4.0, 4.31, 5.0]),
            500,
            pick.choice(["low", "medium", "high", "unknown"]),
        ))
    return rows


def random_preferences(seed: int, n: int):
    pick = random.Random(seed)
    targets = ["bengaluru", " Delhi ", "nagar", "N", "indiranagar", "mumbai", "atlantis", "É quai", "ba", "a", "old town"]
    needles = ["any", "*", "indian", "italian", "e, ital", "n", "ch", "sushi", "CAFÉ", "x-m"]
    return [
        (i, pick.choice(targets), pick.choice(["low", "medium", "high"]), pick.choice(needles),
         pick.choice([0.0, 0.5, 3.75, 4.0, 4.3, 5.0]), None)
        for i in range(n)
    ]


def brute_force(rows, pref, top_n):
    """Funnel counts and ordered ids for one preference."""
    _, location, budget, cuisine, floor, _ = pref
    stripped = location.strip()
    target = LOCATION_ALIASES.get(stripped.lower(), stripped.title()).lower()
    needle = cuisine.strip().lower()
    here = [r for r in rows if r[3].lower() == target or target in r[2].lower()]
    served = here if needle in ("any", "*", "all") else [r for r in here if needle in r[4].lower()]
    rated = served if floor <= 0 else [r for r in served if r[5] is not None and r[5] >= floor]
    paid = [r for r in rated if r[7] != "unknown" and r[7] == budget]
    order = sorted(paid, key=lambda r: (-(r[5] if r[5] is not None else -1.0), r[1].lower(), r[0]))
    return (len(rows), len(here), len(served), len(rated), len(paid)), [r[0] for r in order[:top_n]]
