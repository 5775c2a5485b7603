"""Screening of passages for keys and instruction text, as JVM expressions. It reports, it never removes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notefold.functions.text import WHITE

SECRET, INSTRUCTION = "possible-secret", "possible-instruction-text"
HIDDEN = "[hidden: looks like a key]"

# The public formats of keys.
SECRETS: dict[str, str] = {
    "private-key-block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)",
    "api-key": r"\bsk-[A-Za-z0-9_-]{20,}",
    "github-token": r"\b(?:ghp_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,})",
    "aws-access-key-id": r"\bAKIA[0-9A-Z]{16}\b",
    "slack-token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}",
    "json-web-token": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
# Text that tries to steer a reader: a verb, up to so many words, and what came before it.
BEFORE, FILLERS = ("previous", "prior", "above", "earlier"), 3


def _steering(verb: str, *then: str) -> str:
    return rf"(?i)\b{verb}(?:\s+[a-z]+){{0,{FILLERS}}}?" + "".join(rf"\s+{word}" for word in then) + r"\b"


RULES: dict[str, tuple[str, str]] = {k: (SECRET, p) for k, p in SECRETS.items()} | {
    "ignore-previous-instructions": (INSTRUCTION, _steering("ignore", f"(?:{'|'.join(BEFORE)})", "instructions?")),
    "disregard-the-above": (INSTRUCTION, _steering("disregard", f"(?:{'|'.join(BEFORE)})")),
}


# What a text must hold for a rule to be tried at all: a search for fixed text is far cheaper than a pattern.
_NEEDLES = {"private-key-block": "PRIVATE KEY-----", "api-key": "sk-", "github-token": "g", "aws-access-key-id": "AKIA", "slack-token": "xox", "json-web-token": "eyJ"}


def _java(pattern: str) -> str:
    """Word edges by ASCII words and white space as in JavaScript, which Java's own classes aren't.

    The rules have an edge only before their first and after their last letter.
    """
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + "(?![A-Za-z0-9_])"
    return pattern.replace(r"\b", "(?<![A-Za-z0-9_])").replace(r"[\s\S]", r"(?s:.)").replace(r"\s", f"[{WHITE}]")


def _hit(c: Column, rule: str) -> Column:
    found = c.rlike(_java(RULES[rule][1]))
    return F.contains(c, F.lit(_NEEDLES[rule])) & found if rule in _NEEDLES else found


def screen_rules(c: Column | str) -> Column:
    """The rules that a text breaks, in the order of the rules; null text breaks none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_compact(F.array(*[F.when(_hit(c, rule), F.lit(rule)) for rule in RULES]))


def flags_of(rules: Column | str) -> Column:
    """The distinct flags of broken rules, secrets first."""
    rules = F.col(rules) if isinstance(rules, str) else rules
    instruct = [r for r, (flag, _) in RULES.items() if flag == INSTRUCTION]
    return F.array_distinct(F.transform(rules, lambda r: F.when(r.isin(*instruct), INSTRUCTION).otherwise(SECRET)))


def screen_flags(c: Column | str) -> Column:
    """The distinct flags of a text; null text has none."""
    return flags_of(screen_rules(c))


def mask_secrets(c: Column | str) -> Column:
    """Everything that looks like a key replaced; keys that overlap are masked one after the other."""
    c = F.col(c) if isinstance(c, str) else c
    for rule, (flag, pattern) in RULES.items():
        if flag == SECRET:
            c = F.when(F.contains(c, F.lit(_NEEDLES[rule])), F.regexp_replace(c, _java(pattern), HIDDEN)).otherwise(c)
    return c
