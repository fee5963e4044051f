"""Personal-data detection and redaction, and the prompt guard."""

from __future__ import annotations

import re
from pyspark.sql import Column, functions as F

# Size limit, word lists and entity types of the guard configuration.
MAX_PROMPT_LENGTH = 4096
BLOCKED_KEYWORDS = (
    "hack", "exploit", "vulnerability", "attack", "confidential", "secret", "private key", "password",
)
SENSITIVE_COMMANDS = ("DELETE", "DROP", "TRUNCATE", "ALTER", "rm -rf", "mkfs")

# One pattern per entity type, in the order in which redaction applies them (the longer,
# more specific shapes first). The types NAME, LICENSE_PLATE, PASSPORT_NUMBER and DRIVER_ID
# have no reliable shape and need a model, so they are not covered. Patterns use neither look-around
# nor word boundaries, so every regular-expression engine reads them alike.
PII_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "AWS_ACCESS_KEY": r"(AKIA|ASIA)[A-Z0-9]{16}",
    "MAC_ADDRESS": r"[0-9A-Fa-f]{2}([:-][0-9A-Fa-f]{2}){5}",
    "IP_ADDRESS": r"[0-9]{1,3}(\.[0-9]{1,3}){3}",
    "BANK_ACCOUNT_NUMBER": r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){3,7}",
    "CREDIT_DEBIT_NUMBER": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}",
    "CREDIT_CARD_NUMBER": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}",
    "SSN": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "PHONE": r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}",
    "PASSWORD": r"(?i:password|passwd|pwd)[ ]*[:=][ ]*[^ \n]+",
    "PIN": r"(?i:pin)[ ]*[:=]?[ ]*[0-9]{4,6}",
}

# Longer shapes that only contain an entity's shape; they are left as they are.
PII_DECOYS = {
    "MAC_ADDRESS": r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){6,}",
    "IP_ADDRESS": r"[0-9]+(?:\.[0-9]+){4,}",
    "CREDIT_DEBIT_NUMBER": r"[0-9]{4}(?:[ -]?[0-9]{4}){4,}[0-9]*",
    "CREDIT_CARD_NUMBER": r"[0-9]{4}(?:[ -]?[0-9]{4}){4,}[0-9]*",
    "SSN": r"[0-9]{4,}-[0-9]{2}-[0-9]{4,}|[0-9]{3}-[0-9]{2}-[0-9]{5,}",
    "PHONE": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}",
    "PIN": r"[A-Za-z0-9_](?i:pin)[ ]*[:=]?[ ]*[0-9]{4,}|(?i:pin)[ ]*[:=]?[ ]*[0-9]{7,}",
}

# A cheap condition every match implies; a text without it is not searched with the full pattern.
PII_HINTS = {
    "EMAIL": lambda c: c.contains("@"),
    "AWS_ACCESS_KEY": lambda c: c.contains("AKIA") | c.contains("ASIA"),
    "MAC_ADDRESS": lambda c: c.rlike("[0-9A-Fa-f][:-][0-9A-Fa-f]{2}[:-]"),
    "IP_ADDRESS": lambda c: c.rlike(r"[0-9]\.[0-9]"),
    "BANK_ACCOUNT_NUMBER": lambda c: c.rlike("[A-Z][0-9]{2}"),
    "CREDIT_DEBIT_NUMBER": lambda c: c.rlike("[0-9]{4}"),
    "CREDIT_CARD_NUMBER": lambda c: c.rlike("[0-9]{4}"),
    "SSN": lambda c: c.rlike("[0-9]-[0-9]{2}-[0-9]"),
    "PHONE": lambda c: c.rlike("[ .-][0-9]{3,4}[ .-][0-9]{4}"),
    "PASSWORD": lambda c: c.rlike("(?i)passw|pwd"),
    "PIN": lambda c: c.rlike("(?i)pin"),
}


def steps(entity: str) -> list[tuple[str, str]]:
    """Replacements (pattern, text with \\1 for the first group) that put ``[TYPE]`` in the place of an entity.

    A decoy is matched along with the entity, so that no part of it is taken, and then gets its own text back.
    """
    decoy, label = PII_DECOYS.get(entity), f"[{entity}]"
    if decoy is None:
        return [(PII_PATTERNS[entity], label)]
    return [(f"({decoy})|{PII_PATTERNS[entity]}", r"\1" + label), (f"({decoy})\\[{entity}\\]", r"\1")]


def _replaced(t: Column, entity: str) -> Column:
    for pattern, text in steps(entity):
        t = F.regexp_replace(t, pattern, text.replace("\\1", "$1"))
    return t


def pii_count(c: Column, entity: str) -> Column:
    label = F.lit(rf"\[{entity}\]")
    found = (F.regexp_count(_replaced(c, entity), label) - F.regexp_count(c, label)).cast("bigint")
    return F.when(PII_HINTS[entity](c), found).otherwise(F.when(c.isNotNull(), F.lit(0).cast("bigint")))


def pii_counts(c: Column, entities=tuple(PII_PATTERNS)) -> dict[str, Column]:
    """Occurrences per entity type, each type searched in the whole original text."""
    return {e: pii_count(c, e) for e in entities}


def redact(c: Column, entities=tuple(PII_PATTERNS)) -> Column:
    """Replace every match by ``[TYPE]``, type after type. Of two names of one shape the first is used."""
    for e in entities:
        # The one-element array names the text so far, so that it is computed once.
        c = F.transform(F.array(c), _replacer(e))[0]
    return c


def _replacer(entity: str):
    return lambda t: F.when(PII_HINTS[entity](t), _replaced(t, entity)).otherwise(t)


def _any_word(words) -> str:
    return r"(?i)(^|[^A-Za-z0-9_])(" + "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in words) \
        + r")($|[^A-Za-z0-9_])"


KEYWORD_PATTERN = _any_word(BLOCKED_KEYWORDS)
COMMAND_PATTERN = _any_word(SENSITIVE_COMMANDS)


def guard_reason(c: Column, max_length: int = MAX_PROMPT_LENGTH) -> Column:
    """Why a prompt is refused, or null when it is accepted."""
    return (
        F.when(F.length(c) > max_length, "too_long")
        .when(c.rlike(KEYWORD_PATTERN), "blocked_keyword")
        .when(c.rlike(COMMAND_PATTERN), "sensitive_command")
    )


def guard(c: Column, max_length: int = MAX_PROMPT_LENGTH) -> dict[str, Column]:
    reason = guard_reason(c, max_length)
    return {"is_valid": reason.isNull(), "reason": reason}


def interaction_record(document: Column, prompt: Column, response: Column, error: Column | None = None) -> Column:
    """Audit struct of one interaction: lengths of the redacted texts, whether anything was redacted, error type."""
    safe_prompt, safe_response = redact(prompt), redact(response)
    return F.struct(
        F.when(error.isNull(), "successful_interaction").otherwise("error").alias("event")
        if error is not None else F.lit("successful_interaction").alias("event"),
        document.alias("document"),
        F.length(safe_prompt).cast("bigint").alias("prompt_length"),
        F.length(safe_response).cast("bigint").alias("response_length"),
        ((safe_prompt != prompt) | (safe_response != response)).alias("pii_redacted"),
        (error if error is not None else F.lit(None).cast("string")).alias("error_type"),
    )
