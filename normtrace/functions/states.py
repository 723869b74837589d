"""Functions on canonical state names of the form ``Entity:State``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that make a state a failed or a reached one. Seven negative endings also
# end with a positive one (``NotAccepted`` ends with ``Accepted``), so such states are both.
NEGATIVE_ENDINGS = [
    "Rejected", "Failed", "NotAccepted", "NotSelected", "NotProvided", "NotSubmitted",
    "NotCreated", "NotVerified", "NotSent", "Error", "VerificationFailed", "CreationFailed",
    "RegistrationFailed",
]
POSITIVE_ENDINGS = [
    "Accepted", "Selected", "Provided", "Submitted", "Created", "Verified", "Sent", "Requested",
    "Entered", "Generated", "Registered",
]

# Rank of each entity in the account-opening process, and the rank of any other.
ENTITY_RANKS = {
    "Request": 0,
    "Country": 1,
    "PersonalInformation": 2,
    "BusinessDetails": 3,
    "CreditCardDetails": 4,
    "VerificationEmail": 5,
    "Verification": 6,
    "Account": 7,
    "Password": 8,
    "ErrorNotification": 9,
}
DEFAULT_RANK = 50


def entity(state_id: Column) -> Column:
    """Text before the first colon; the whole name when it has none."""
    return F.split_part(state_id, F.lit(":"), F.lit(1))


def suffix(state_id: Column) -> Column:
    """The second colon-separated piece; empty when there is no colon."""
    return F.split_part(state_id, F.lit(":"), F.lit(2))


def _ends_with_any(text: Column, endings: list[str]) -> Column:
    return text.rlike("(?:" + "|".join(endings) + r")\z")


def is_negative(state_id: Column) -> Column:
    return _ends_with_any(suffix(state_id), NEGATIVE_ENDINGS)


def is_positive(state_id: Column) -> Column:
    return _ends_with_any(suffix(state_id), POSITIVE_ENDINGS)
