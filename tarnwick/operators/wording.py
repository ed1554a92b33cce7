"""Fixed values that decide how texts are read: characters, signs of computable rules and words that need a judgement."""

import re

# Typographic variants and what they are read as. Dashes keep their length; spaces become a space,
# invisible characters nothing, ligatures their letters.
CHARACTERS = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u2032": "'",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"', "\u2033": '"',
    "\u2010": "-", "\u2011": "-", "\u2012": "\u2013", "\u2015": "\u2014", "\u2212": "-",
}
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\t"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
#: In this order, before the rest; a form feed is a paragraph's end after it.
BREAKS = (("\u2026", "..."), ("\u2028", "\n"), ("\u2029", "\n\n"), ("\r\n", "\n"), ("\r", "\n"))
#: White space, beside the space itself, that may still stand at a line's ends.
MARGIN = " \x0b\x1c\x1d\x1e\x1f\x85"

# Signs that a rule can be computed, each found counted with its weight, and the pattern of numbers, of
# which at most four count.
MONEY = r"(?:£|\$|€|GBP|USD|EUR)\s?[\d,]+(?:\.\d+)?"
PERCENT = r"\d+(?:\.\d+)?\s?%"
MULTIPLIER = r"\b\d+(?:\.\d+)?\s+times\b"
DURATION = r"\b\d+\s+(?:day|days|month|months|year|years|week|weeks|hour|hours|minute|minutes|business day|business days)\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"
THRESHOLDS = (
    "in excess of", "exceeds?", "exceeding", "not less than", "no less than", "at least", "more than", "less than", "up to",
    "not exceed", "must not exceed", "greater of", "lesser of", "maximum of", "minimum of", "or more but less than", "or above",
    "or below", r"within \d+", r"after \d+", "for a period of", "for a continuous period of", "on or before", "measured from",
    "from the date", "for more than", "or above but", "but not less than", "but within",
)
COMPUTED = (
    "calculated", "divided by", "multiplied by", "multiplied", "plus", "minus", "rate of", "reduced by", "increased by",
    "pro-rated", "rounded", "expressed as a percentage", "accrues at", "aggregate of", "sum of", "less the",
)
ENTITLED = (
    "is entitled to", "entitlement", "is payable", "is not payable", "are retained", "is retained", "forfeits?", "accrues?",
    "may carry forward", "is reimbursable", "may be reimbursed", "will be reimbursed", "will be paid", "is paid", "may recover",
    "may terminate", "may be recovered", "no recovery", "is waived", "is forfeited", "is applied", "is capped",
    "must not exceed", "is reduced", "is increased", "takes precedence", "must not be deleted", "will delete", "is deleted",
)
JUDGED = (
    r"reasonabl\w+", "ought reasonably", "good reason", "judgement", "judgment", r"material\b", "materially", r"appropriate\w*",
    "satisfactory", r"discretion\w*", "in the opinion of", "as it sees fit", "genuine pre-estimate", "adequate", "practicable",
    "expected to", "no less than the degree of care", "properly incurred", "good faith", "reasonably anticipated", r"final\b",
    "determined by the",
)
PROSE = (
    "purpose of this", "headings are for convenience", "is governed by the law", "exclusive jurisdiction", "no variation",
    "acknowledges? that", "is discretionary", "does not create any partnership", "is not intended to describe",
    "remains? responsible for their own", "sole financial remedy", "reserves all rights", "is accountable for", "no licence",
    "as is", "gives no warranty", "submit to the",
)
#: At a text's begin, in its own case.
DEFINES = r'^"?[A-Z][\w\s\-]{2,60}"?\s+(?:means|includes)\b'

# The tokens of lexical search, on lower-case text.
TOKEN = r"[a-z][a-z'-]*|\p{Nd}+(?:[.,]\p{Nd}+)*%?"

# HTML elements that begin and end a block, whose text is dropped, and that are page furniture.
BLOCKS = set(
    "p div section article li tr td th blockquote pre dd dt figcaption header footer main table ul ol dl h1 h2 h3 h4 h5 h6 br hr".split()
)
DROPPED = {"script", "style", "head", "noscript", "svg", "template"}
FURNITURE = {"nav", "footer", "aside"}


def any_of(phrases: tuple[str, ...]) -> str:
    """The pattern of whole phrases, the first listed first."""
    return rf"\b(?:{'|'.join(phrases)})\b"


#: Pattern (letters in either case) and weight of each sign.
SIGNS = ((MONEY, 2), (PERCENT, 2), (MULTIPLIER, 2), (DURATION, 1), (any_of(THRESHOLDS), 2), (any_of(COMPUTED), 2), (any_of(ENTITLED), 2))


def stems(phrases: tuple[str, ...]) -> list[str]:
    """The plain begin of each phrase, without a last letter that can be missing: what a text must hold to have it."""
    return sorted({re.match(r"(?:[a-z -](?!\?))+", p)[0] for p in phrases})


#: What a lower-case text must hold one of to match the pattern.
HINTS = {
    MONEY: ["£", "$", "€", "gbp", "usd", "eur"],
    PERCENT: ["%"],
    MULTIPLIER: ["times"],
    DURATION: ["day", "month", "year", "week", "hour", "minute"],
} | {any_of(p): stems(p) for p in (THRESHOLDS, COMPUTED, ENTITLED, JUDGED, PROSE)}
