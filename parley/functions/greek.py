"""A Greek stemmer as column expressions.

A word is brought to a plain form (lower case, no accents or diaereses, one
form of sigma); then a cascade of suffix classes runs over it, in the order of
how the endings are built up from the inside out, last ones first: comparison,
noun and adjective plurals with a longer stem, verb endings, nominal endings.
A step removes the longest ending of its class that leaves at least ``LEAST``
letters, so each is one regular expression with a shortest-possible prefix.
Words of up to three letters keep their plain form.

Endings are listed in plain form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain form.
MARKED = "άέήίόύώϊϋΐΰς"
PLAIN = "αεηιουωιυιυσ"

# Endings of modern Greek by class.
COMPARISON = (
    "οτεροσ", "οτερη", "οτερο", "οτεροι", "οτερεσ", "οτερα", "οτερου", "οτερησ", "οτερων", "οτερουσ",
    "υτεροσ", "υτερη", "υτερο", "υτεροι", "υτερεσ", "υτερα", "εστεροσ", "εστερη", "εστερο", "εστεροι", "εστερεσ", "εστερα",
    "οτατοσ", "οτατη", "οτατο", "οτατοι", "οτατεσ", "οτατα", "υτατοσ", "υτατη", "υτατο", "εστατοσ", "εστατη", "εστατο",
)
LONG_STEMS = ("αδεσ", "αδων", "εδεσ", "εδων", "ουδεσ", "ουδων", "ματα", "ματων", "ματοσ", "μα", "ιμο", "ιματα", "ιματοσ")
VERBS = (
    "ομασταν", "οσασταν", "ομαστε", "ομουν", "οσουν", "ονταν", "οταν", "ουνται", "ονται", "εστε", "εσαι", "εται", "ομαι",
    "ουσαμε", "ουσατε", "ουσαν", "ουσεσ", "ουσα", "ουσε", "αγαμε", "αγατε", "αγαν", "αγα", "αγεσ", "αγε",
    "ηθηκαμε", "ηθηκατε", "ηθηκαν", "ηθηκα", "ηθηκεσ", "ηθηκε", "θηκαμε", "θηκατε", "θηκαν", "θηκα", "θηκεσ", "θηκε",
    "ησαμε", "ησατε", "ησαν", "ησα", "ησεσ", "ησε", "ησουμε", "ησετε", "ησουν", "ησω", "ησεισ", "ησει",
    "ουμε", "ομε", "αμε", "ατε", "ετε", "ειτε", "ουν", "ανε", "οντασ", "ωντασ", "μενοσ", "μενη", "μενο", "μενοι", "μενεσ", "μενα",
)
NOMINAL = (
    "ιουσ", "ουσ", "εων", "εωσ", "ιων", "ιου", "ιοσ", "ιοι", "ιεσ", "ιασ", "εισ", "οσ", "ον", "ου", "οι", "ων", "ησ", "ην", "εσ", "ασ", "αν", "ισ", "υσ", "ει",
    "ια", "ιο", "α", "η", "ο", "ω", "ε", "ι", "υ",
)
STEPS = ((COMPARISON, 3), (LONG_STEMS, 3), (VERBS, 2), (NOMINAL, 2))
SHORT = 3


def patterns() -> list[str]:
    """One pattern per step; its first group is what stays."""
    return [f"^(.{{{least},}}?)(?:{'|'.join(endings)})$" for endings, least in STEPS]


def plain(token: Column) -> Column:
    return F.translate(F.lower(token), MARKED, PLAIN)


def stem(token: Column | str) -> Column:
    """The stem of one token."""
    word = plain(F.col(token) if isinstance(token, str) else token)
    out = word
    for pattern in patterns():
        out = F.regexp_replace(out, pattern, "$1")
    return F.when(F.length(word) <= SHORT, word).otherwise(out)


def stem_tokens(tokens: Column | str) -> Column:
    """The same on a token array, inside the row."""
    return F.transform(tokens, stem)
