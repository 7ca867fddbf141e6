"""Standardisers that turn raw source labels into canonical values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clamp01, coded_id, col, norm, number_or_percent, strip, title_case

# Utilisation assumed for a product when the source gives none.
DEFAULT_UTILISATION = {
    "RCF": 0.45,
    "Term Loan": 1.0,
    "Guarantee": 0.20,
    "Trade Finance": 0.25,
    "Overdraft": 0.35,
}
OTHER_UTILISATION = 0.50

# Agency and internal rating spellings.
RATING_LABELS = {"A": ["a", "a2"], "BBB": ["bbb", "baa2"], "BB": ["bb", "ba2"], "B": ["b", "b2"]}

# Substring found in a lost reason -> canonical reason, first hit wins.
LOST_REASON_TOKENS = [
    ("price", "price"),
    ("expensive", "price"),
    ("alternative", "alternative_funding"),
    ("cancel", "project_cancelled"),
    ("credit", "credit_declined"),
    ("structure", "structure"),
    ("no longer", "no_longer_needed"),
]
NOT_COMMERCIAL = ["credit_declined", "project_cancelled", "no_longer_needed"]

# Substring found in a product label -> product, first hit wins.
PRODUCT_TOKENS = [
    ("term", "Term Loan"),
    ("guarant", "Guarantee"),
    ("trade", "Trade Finance"),
    ("overdraft", "Overdraft"),
    ("rcf", "RCF"),
    ("revolving", "RCF"),
]

FINAL_QUOTE_STATUSES = ["approved", "submitted"]
KNOWN_ACTIVE_STAGES = ["prospecting", "origination", "credit review", "negotiation"]
CLOSED_STAGES = ["closed won", "closed lost", "withdrawn"]


def first_token(text: Column, tokens: list[tuple[str, str]], otherwise: Column) -> Column:
    chain = None
    for token, label in tokens:
        hit = text.contains(token)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(otherwise)


def customer_id(c) -> Column:
    return coded_id(c, "CUST", 6)


def deal_id(c) -> Column:
    return coded_id(c, "DEAL", 7)


def facility_id(c) -> Column:
    return coded_id(c, "FAC", 8)


def segment(c) -> Column:
    clean = norm(c)
    return (
        F.when(clean.isin("large corp", "large corporate", "lc"), "Large Corporate")
        .when(clean.isin("mid market", "mm"), "Mid Market")
        .when(clean.contains("sponsor"), "Financial Sponsor")
        .otherwise(title_case(strip(c)))
    )


def currency(c) -> Column:
    clean = F.upper(strip(c))
    return F.when(clean.isin("€", "EUR"), "EUR").otherwise(clean)


def deal_status(stage) -> Column:
    """Closed stages by name; everything else, also null, counts as active."""
    clean = norm(stage)
    return F.when(clean.isin(CLOSED_STAGES), F.replace(clean, F.lit(" "), F.lit("_"))).otherwise("active")


def unknown_stage(stage) -> Column:
    """True for a stage that is active only because nothing recognised it."""
    return ~F.coalesce(norm(stage).isin(KNOWN_ACTIVE_STAGES + CLOSED_STAGES), F.lit(False))


def deal_outcome(stage) -> Column:
    clean = norm(stage)
    return F.when(clean == "closed won", "won").when(clean == "closed lost", "lost")


def lost_reason(c) -> Column:
    clean = norm(c)
    other = F.replace(clean, F.lit(" "), F.lit("_"))
    return F.when(col(c).isNotNull(), first_token(clean, LOST_REASON_TOKENS, other))


def commercial_relevance(reason, outcome, status) -> Column:
    """False only for a deal that is neither active nor won and was lost for a non-commercial reason."""
    open_or_won = (col(status) == "active") | col(outcome).eqNullSafe("won")
    return F.coalesce(open_or_won, F.lit(False)) | ~F.coalesce(col(reason).isin(NOT_COMMERCIAL), F.lit(False))


def product(c) -> Column:
    return first_token(norm(c), PRODUCT_TOKENS, strip(c))


def utilisation_default(product_type) -> Column:
    chain = None
    for name, share in DEFAULT_UTILISATION.items():
        hit = col(product_type) == name
        chain = F.when(hit, share) if chain is None else chain.when(hit, share)
    return chain.otherwise(OTHER_UTILISATION)


def utilisation_share(share, product_type) -> Column:
    """A parsed share limited to [0, 1], or the product's default."""
    return F.coalesce(clamp01(col(share)), utilisation_default(product_type))


def utilisation(c, product_type) -> Column:
    return utilisation_share(number_or_percent(c), product_type)


def rating(c) -> Column:
    clean = norm(c)
    chain = None
    for label, spellings in RATING_LABELS.items():
        hit = clean.isin(spellings)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(F.upper(strip(c)))


def replace_value(c, old: str, new: str) -> Column:
    return F.when(col(c) == old, new).otherwise(col(c))


def is_active_customer(status) -> Column:
    return F.coalesce(F.lower(col(status)) == "active", F.lit(False))


def flag(c) -> Column:
    """Boolean with a missing value read as false."""
    return F.coalesce(col(c).cast("boolean"), F.lit(False))


def final_quote_eligible(status) -> Column:
    return F.coalesce(col(status).isin(FINAL_QUOTE_STATUSES), F.lit(False))


def final_quote_warning(is_final, status) -> Column:
    return col(is_final) & ~final_quote_eligible(status)
