"""Categories of secrets and personal data, and text helpers over prioritised alternations.

The table's order is the priority of categories that begin at one place; all match without regard to case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The categories in order of priority, each with its pattern.
PATTERNS: dict[str, str] = {
    "AWS_KEY": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    "GOOGLE_API_KEY": r"\bAIza[0-9A-Za-z_\-]{35}\b",
    "AZURE_KEY": r"\b[0-9a-fA-F]{32}\b",
    "STRIPE_KEY": r"\b(sk|pk)_(test|live)_[0-9a-zA-Z]{24,}\b",
    "GITHUB_TOKEN": r"\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b",
    "GENERIC_API_KEY": r"\b[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]\s*[:=]\s*['\"]?[A-Za-z0-9\-_.~+]{16,}['\"]?",
    "DB_URI": r"\b(postgres|mysql|mongodb|redis|amqp|ftp|sftp|oracle|sqlserver)://[^\s:@/]+:[^\s@/]+@[^\s]+",
    "PRIVATE_KEY": r"-----BEGIN[\s\S]+?(RSA|EC|OPENSSH|PGP|PRIVATE)\s+KEY-----[\s\S]+?-----END[\s\S]+?KEY-----",
    "JWT": r"\b[A-Za-z0-9\-_=]+\.[A-Za-z0-9\-_=]+\.[A-Za-z0-9\-_=+/]*\b",
    "EMAIL": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "PHONE_NUMBER": r"\b(\+\d{1,3}\s?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b",
    "CREDIT_CARD": r"\b(4\d{12}(\d{3})?|5[1-5]\d{14}|3[47]\d{13}|6011\d{12}|3(0[0-5]|(6|8)\d)\d{11})\b",
    "IBAN": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "AADHAAR_IN": r"\b\d{4}\s\d{4}\s\d{4}\b",
    "PAN_IN": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "PASSPORT": r"\b([A-Z]{1}-\d{7}|[A-Z]{2}\d{7}|[A-Z]\d{8})\b",
    "SSN_US": r"\b\d{3}-\d{2}-\d{4}\b",
    "IPV4": r"\b(\d{1,3}\.){3}\d{1,3}\b",
    "IPV6": r"([0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}",
    "MAC_ADDRESS": r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b",
    "UUID": r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    "HIGH_ENTROPY_STRING": r"['\"]([A-Za-z0-9/+=_]{20,})['\"]",
}
CATEGORIES = list(PATTERNS)

#: Code points that no text holds (Unicode keeps them for such use): they mark matches inside a text.
OPEN, NEXT, CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"

BOUNDARY = r"\b"
#: Java's word boundary knows all letters; this one knows ASCII only, as SQL engines do.
ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ungrouped(pattern: str) -> str:
    """The pattern with its groups not captured."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def fused(patterns: dict[str, str] = PATTERNS) -> str:
    """One alternation, a numbered group for each category."""
    return "(?i)" + "|".join(f"({ungrouped(p)})" for p in patterns.values())


#: Categories that can begin, or end, with another character than a letter, digit or underscore.
ANY_FIRST, ANY_LAST = {"JWT", "EMAIL", "PHONE_NUMBER"}, {"JWT", "GOOGLE_API_KEY"}


def java(name: str, pattern: str) -> str:
    """A category's pattern with ASCII edges: where it begins or ends with a word character one look is enough."""
    if pattern.startswith(r"\b") and name not in ANY_FIRST:
        pattern = r"(?<![A-Za-z0-9_])" + pattern[2:]
    if pattern.endswith(r"\b") and name not in ANY_LAST:
        pattern = pattern[:-2] + r"(?![A-Za-z0-9_])"
    return pattern.replace(r"\b", ASCII_EDGE)


WORD = "[A-Za-z0-9_]"
#: Categories that can begin at the end of a word, inside one, and between two characters that belong to none.
AT_END, INSIDE, APART = ["PRIVATE_KEY", "JWT", "EMAIL", "PHONE_NUMBER", "HIGH_ENTROPY_STRING"], ["IPV6"], ["PRIVATE_KEY", "HIGH_ENTROPY_STRING"]
#: A word that begins no match: up to 19 letters, with nothing after it that an address, a key or a token goes on with.
PLAIN = r"(?!apikey)[a-z]{1,19}+(?![a-z0-9_.@=%+:-])"


def anchored(patterns: dict[str, str] = PATTERNS) -> tuple[str, list[str]]:
    """fused() for Java with an anchor before the categories, and the category of each group.

    What a place can begin depends on whether it is the start or end of a word, inside one or outside all: the four cases
    exclude each other, so within each the categories keep their order, and those that can't begin there aren't tried. Of
    a text's words most are plain, and are passed by after one look.
    """

    def of(names: list[str]) -> tuple[str, list[str]]:
        names = [n for n in patterns if n in names]
        return "|".join(f"({ungrouped(java(n, patterns[n].removeprefix(BOUNDARY)))})" for n in names), names

    (start, a), (inside, b), (end, c), (apart, d) = of([n for n in patterns if n not in APART]), of(INSIDE), of(AT_END), of(APART)
    word, other = rf"(?={WORD})(?:(?<!{WORD})(?!{PLAIN})(?:{start})|(?<={WORD})(?:{inside}))", rf"(?=[-=.%+('\"])(?:(?<={WORD})(?:{end})|(?<!{WORD})(?:{apart}))"
    return f"(?i)(?:{word}|{other})", a + b + c + d


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def marked(text: Column, pattern: str, groups: int) -> Column:
    """array<string>: what precedes the first match, then for each match its groups, a close mark and what follows.

    One pass of the regular expression writes the groups of every match between marks; the marks part the text.
    """
    groups_out = NEXT.join(f"${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}{groups_out}{CLOSE}")), OPEN, -1)


def matched(part: Column) -> tuple[Column, Column]:
    """Of one part that marked() returned: the groups, and what follows the match."""
    inner = F.substring_index(part, CLOSE, 1)
    return F.split(inner, NEXT, -1), F.substring(part, F.length(inner) + 2, F.length(part))


def relabelled(text: Column, pattern: str, groups: int, label) -> Column:
    """text with each match replaced by label(groups)."""
    def one(part: Column) -> Column:
        found, tail = matched(part)
        return F.concat(let(found, label), tail)

    return let(marked(text, pattern, groups), lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), "")))
