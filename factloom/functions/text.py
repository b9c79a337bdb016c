"""Text expressions: tokens, names, costs and sentences. All are built-in functions on the JVM; those with
a lambda function are interpreted, so callers work them out once a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a name's normal form leaves out.
NAME_STOPWORDS = ("inc", "llc", "ltd", "corp", "co", "the")
#: What lies between tokens: neither of the Unicode property Alphabetic nor a number. Accents that stand apart
#: from their letters and vowel killers are not alphabetic; vowel signs and circled letters are.
_APART = r"[^\p{IsAlphabetic}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of alphabetic characters and numbers. Null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _APART), lambda t: t != "")


def term_count(words: Column, term: str) -> Column:
    """How often a term stands among the tokens."""
    return F.size(F.filter(words, lambda t: t == F.lit(term)))


def normalize_name(name: Column) -> Column:
    """Lower-case words without punctuation and without legal forms, one space between them."""
    return F.array_join(F.filter(tokens(name), lambda t: ~t.isin(*NAME_STOPWORDS)), " ")


def name_tokens(normal: Column) -> Column:
    """The distinct words of a normal form."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != ""))


def name_similarity(a: Column, b: Column) -> Column:
    """0 if either normal form is empty, 1 if they are equal, else the Jaccard similarity of their words."""
    x, y = name_tokens(a), name_tokens(b)
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(jaccard)


def token_cost(text: Column) -> Column:
    """Words between white space, 1 at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")))


def verbalize(subject: Column, predicate: Column, obj: Column) -> Column:
    """A fact as a sentence."""
    return F.concat_ws(" ", subject, predicate, obj)


def display_name(name: Column, node_id: Column, kind: str = "node") -> Column:
    """The name, or ``node#<id>`` (``rel#<id>``) where there is none."""
    return F.coalesce(name, F.concat(F.lit(f"{kind}#"), node_id.cast("string")))
