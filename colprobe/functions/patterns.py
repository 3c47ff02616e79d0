"""Personal-data patterns and the cheap tests that guard them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven pattern names and expressions, in reporting order.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(\+\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[- ]?){3}\d{4}\b",
    "singapore_nric": r"\b[STFG]\d{7}[A-Z]\b",
    "address": r"\b\d+\s+[A-Za-z]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd)\b",
    "date_of_birth": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}

# A match is impossible without these; a substring or digit-run test costs far less
# than a backtracking search over a long text, so it runs first. The test common to all
# patterns is evaluated once per cell.
_REQUIRED_BY_ALL = "[0-9@]"
_REQUIRED_TEXT = {"email": "@", "ip_address": "."}
_REQUIRED_RUN = {
    "phone": "[0-9]{3}",
    "credit_card": "[0-9]{4}",
    "singapore_nric": "[STFG][0-9]{7}",
    "address": r"[0-9]\s",
    "date_of_birth": "[0-9][/-][0-9]",
    "ip_address": r"[0-9]\.[0-9]",
}


def matches(text: Column, pattern: str) -> Column:
    """Whether the text holds at least one match; NULL counts as no match."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def holds_personal_data(text: str, name: str) -> str:
    """SQL test for a match of a named pattern, behind its cheap guards."""
    tests = [f"rlike({text}, r'{_REQUIRED_BY_ALL}')"]
    if name in _REQUIRED_TEXT:
        tests.append(f"contains({text}, '{_REQUIRED_TEXT[name]}')")
    if name in _REQUIRED_RUN:
        tests.append(f"rlike({text}, r'{_REQUIRED_RUN[name]}')")
    tests.append(f"rlike({text}, r'{PATTERNS[name]}')")
    return " AND ".join(tests)
