"""Column names as text: enrichment, normal form, naming styles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words looked for in a name, and the phrase that is appended when one occurs.
ENRICHMENTS = [
    (["id"], " identifier primary key"),
    (["date", "time", "created", "updated"], " timestamp datetime"),
    (["name", "title"], " text label"),
    (["customer", "user", "client"], " person account profile"),
]

# The terms of a concept group.
CONCEPT_TERMS = {
    "identifiers": ["id", "identifier", "primary key", "unique key"],
    "timestamps": ["date", "time", "timestamp", "created", "updated"],
    "names": ["name", "title", "label", "text"],
    "users": ["customer", "user", "client", "person", "account"],
    "financial": ["price", "amount", "cost", "money", "payment"],
    "quantities": ["quantity", "count", "number", "amount"],
    "status": ["status", "active", "enabled", "state"],
    "ratings": ["rating", "score", "review", "feedback"],
}

# The phrases a column is classified by; on equal similarity the earlier concept wins.
CONCEPT_TEMPLATES = {
    "identifier": [
        "unique identifier", "primary key", "id field", "reference number", "key column", "unique code",
        "identifier field",
    ],
    "timestamp": [
        "date field", "time column", "timestamp data", "datetime field", "creation date", "update time",
        "temporal data",
    ],
    "name": ["name field", "title column", "label text", "description field", "text identifier", "display name"],
    "user": [
        "user data", "customer information", "client field", "person data", "account holder",
        "profile information",
    ],
    "financial": [
        "money amount", "price data", "cost field", "financial value", "payment information", "currency amount",
    ],
    "quantity": [
        "count field", "quantity data", "number amount", "volume data", "measurement value", "numeric quantity",
    ],
    "status": [
        "status field", "state data", "condition flag", "active indicator", "enabled flag", "boolean status",
    ],
    "contact": [
        "email address", "phone number", "contact information", "address field", "communication data",
        "location information",
    ],
}
OTHER = "other"


def enrich(name: Column) -> Column:
    """Underscores become spaces; phrases are added for the words a name contains (also inside words)."""
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    lowered = F.lower(spaced)
    parts = [spaced]
    for words, phrase in ENRICHMENTS:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(lowered, F.lit(word))
        parts.append(F.when(found, phrase).otherwise(""))
    return F.concat(*parts)


def normal_form(text: Column) -> Column:
    """Words in lower case, one space apart; camelCase and underscores separate words."""
    split = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(F.replace(split, F.lit("_"), F.lit(" "))), "[ \t\r\n]+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often a lambda in the body uses it."""
    return F.transform(F.array(value), body)[0]


def has_underscore(name: Column) -> Column:
    return F.contains(name, F.lit("_"))


def has_upper(name: Column) -> Column:
    return name.rlike(r"\p{Lu}")


def is_plain_lower(name: Column) -> Column:
    """Lower case with at least one letter, and no underscore."""
    return (F.lower(name) == name) & name.rlike(r"\p{Ll}") & ~has_underscore(name)


def styles(name: Column) -> Column:
    """Which naming styles a name shows; a name may show several or none."""
    return F.array_compact(
        F.array(
            F.when(has_underscore(name), "underscore"),
            F.when(has_upper(name), "camelcase"),
            F.when(is_plain_lower(name), "lowercase"),
        )
    )
