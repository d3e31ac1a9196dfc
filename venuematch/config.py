"""Settings and the fixed values every transform shares."""

from __future__ import annotations

import logging
from dataclasses import dataclass

logger = logging.getLogger(__name__)

# Fixed values -----------------------------------------------------------------

RAW_COLUMNS = {
    "name": "name",
    "address": "address",
    "location": "location",
    "cuisines": "cuisines",
    "rate": "rate",
    "cost": "approx_cost(for two people)",
}

CATALOG_COLUMNS = [
    "id",
    "name",
    "location",
    "city",
    "cuisine",
    "rating",
    "cost_for_two",
    "budget_band",
]

KNOWN_CITIES = [
    "New Delhi",
    "Bangalore",
    "Bengaluru",
    "Mumbai",
    "Hyderabad",
    "Chennai",
    "Kolkata",
    "Pune",
    "Gurgaon",
    "Gurugram",
    "Noida",
]

LOCATION_ALIASES = {
    "bengaluru": "Bangalore",
    "bangalore": "Bangalore",
    "new delhi": "Delhi",
    "delhi": "Delhi",
    "gurugram": "Gurgaon",
    "gurgaon": "Gurgaon",
    "bombay": "Mumbai",
    "mumbai": "Mumbai",
}

DEFAULT_CITY = "Bangalore"
DEFAULT_FACET = "Indiranagar"
UNKNOWN = "unknown"
BUDGETS = ["low", "medium", "high"]
ANY_CUISINE_TOKENS = ["any", "*", "all"]
MAX_COST = 100_000
MAX_FREE_TEXT = 500
SUCCESS_RATE_FLOOR = 0.9
MISSING_RANK = 9999
SNAPSHOT_VERSION = 1

# The characters str.strip() removes in Python.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

MSG_NOT_LOADED = "Restaurant data is not loaded."
MSG_EMPTY_DEFAULT = "No restaurants found. Try a different location or lower your minimum rating."
MSG_EMPTY_BUDGET = "No restaurants in your budget range. Try a different budget level."
MSG_EMPTY_LOCATION = "No restaurants found in '%s'. This dataset is primarily Bangalore-based."
MSG_UNKNOWN_ID = "Hallucinated candidate ID '%s' dropped."
MSG_DEFAULT_EXPLANATION = "Recommended based on your preferences."

# error type -> (message, was the ranker called); a null message means "use the ranker's own text".
ERROR_ENVELOPES = {
    "LLMConfigurationError": (None, False),
    "LLMTimeoutError": ("Recommendations temporarily unavailable. Please try again.", True),
    "LLMRateLimitError": ("Service is busy. Please try again in a moment.", True),
    "LLMParseError": ("We couldn't generate recommendations right now. Please try again.", True),
    "LLMAPIError": ("Recommendations temporarily unavailable. Please try again.", True),
    "Exception": ("Something went wrong. Please try again.", False),
}

CAUSE_TITLES = {
    "location": "No Restaurants in %s",
    "cuisine": "No %s Restaurants in %s",
    "rating": "Rating Too High for This Combination",
    "budget": "No Restaurants in This Budget Range",
    "other": "No Restaurants Found",
}

CAUSE_EXPLANATIONS = {
    "location": 'We don\'t have any restaurant data for "%s" in our database. '
    "This location may not be covered in our current Bangalore dataset.",
    "cuisine": "We found %d restaurant%s in %s, but none of them serve %s cuisine. "
    "This cuisine type may not be available in this neighborhood.",
    "rating": "We found %d %srestaurant%s in %s, but none have a rating of %s or above.",
    "budget": 'We found %d %srestaurant%s in %s rated %s+, but none fall in the "%s" budget range.',
    "other": "No venues in our dataset match your current filter combination.",
}

BUDGET_LABELS = {"low": "under ₹500", "medium": "₹500–₹1500", "high": "above ₹1500"}

CAUSE_SUGGESTIONS = {
    "location": [
        "Try a nearby popular area like Indiranagar, Koramangala, or Whitefield.",
        "Double-check the location spelling or select from the dropdown.",
    ],
    "cuisine": [
        'Set Cuisine Type to "Any" to see all %d restaurants in %s.',
        "Try nearby locations that may have %s restaurants.",
    ],
    "rating": [
        "Lower your minimum rating to 3.5 or below — the available restaurants here may be rated slightly lower.",
        "Check nearby areas like Koramangala or Indiranagar for higher-rated %soptions.",
    ],
    "budget": [
        "Try a different budget level — the matching restaurants may be in a %s price bracket.",
        "Lower your minimum rating to expand the pool of candidates within your budget.",
    ],
    "other": [
        "Lower your minimum rating filter (e.g. to 3.5 or 3.0).",
        'Change Cuisine Type to "Any" to expand the candidate pool.',
        "Try a different budget level.",
    ],
}

# End of fixed values ----------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Tunable thresholds. Pass one explicitly to change a default."""

    top_n: int = 30
    top_k: int = 5
    budget_low_max: int = 500
    budget_medium_max: int = 1500

    def __post_init__(self) -> None:
        if self.top_n <= 0 or self.top_k <= 0:
            raise ValueError("top_n and top_k must be positive")

    def effective_top_n(self, top_n: int | None) -> int:
        """A missing or non-positive cap falls back to the configured one; the latter is logged."""
        if top_n is not None and top_n <= 0:
            logger.warning("a cap of %s is not positive; %d is used", top_n, self.top_n)
        return self.top_n if top_n is None or top_n <= 0 else top_n


DEFAULTS = Settings()
