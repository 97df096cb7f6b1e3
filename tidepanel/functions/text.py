"""Text joins, slugs, tokens and keywords."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# Written out rather than \b, whose meaning for non-ASCII letters depends on the Java release.
WORD = r"[\p{L}\p{N}_]"
TOKEN = r"[\p{L}\p{N}_]+"
# Java looks behind by 16-bit units unless the pattern holds a literal beyond them; this one is a letter.
WORD_BEHIND = "[\\p{L}\\p{N}_\U00010400]"


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def title_and_body(title: Column, body: Column) -> Column:
    return F.concat(or_empty(title), F.lit("\n"), or_empty(body))


def slug(tag: Column, fallback: Column) -> Column:
    """Lower-case file tag: runs outside a-z 0-9 _ - become one dash, outer dashes go.

    A blank tag, or one that slugs to nothing, falls back to the lower-cased key.
    """
    raw = F.lower(F.trim(F.when(F.length(tag) > 0, tag).otherwise(fallback)))
    cleaned = F.trim(F.regexp_replace(raw, r"[^a-z0-9_-]+", "-"), F.lit("-"))
    return F.when(F.length(cleaned) > 0, cleaned).otherwise(F.lower(fallback))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def runs(text: Column) -> Column:
    """Lower-cased text as alternating runs of word and of other characters; joined they are it."""
    return F.regexp_extract_all(
        F.lower(text), F.lit(rf"({TOKEN}|[^\p{{L}}\p{{N}}_]+)"), F.lit(1)
    )


def run_grams(pieces: Column, n: int) -> Column:
    """Every n consecutive runs, joined, that are bounded as a whole word is.

    At an outer word character the neighbour is no word character, or the text ends; at any other
    outer character a word character follows. As runs are maximal, that only rules out a non-word run
    at either end of the text.
    """
    size = F.size(pieces)

    def spare(at: Column) -> Column:
        return F.when(F.get(pieces, at).rlike(f"^{WORD}"), F.lit(0)).otherwise(F.lit(1))

    first, last = spare(F.lit(0)) + 1, size - n + 1 - spare(size - 1)
    starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(pieces, i, F.lit(n)), ""))


def _word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def _literal(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else rf"\x{{{ord(c):x}}}" for c in text)


def _trie(terms: list[str]) -> str:
    """Pattern of a prefix tree over sorted distinct terms, the longest way down first.

    A term that ends here must be bounded: no word character after a word character, else one.
    """
    ways = []
    if terms[0] == "":
        terms = terms[1:]
    for _, group in groupby(terms, key=lambda t: t[0]):
        same = list(group)
        shared = os.path.commonprefix([same[0], same[-1]])
        below = _trie([t[len(shared):] for t in same]) if len(same) > 1 else ""
        if same[0] == shared:
            end = rf"(?!{WORD})" if _word(shared[-1]) else rf"(?={WORD})"
            below = f"(?:{below}|{end})" if below else end
        ways.append(_literal(shared) + below)
    return f"(?:{'|'.join(ways)})"


def term_pattern(terms: Iterable[str]) -> str:
    """Pattern whose group 1 is the longest of the lower-case terms at each place where one begins as a word does."""
    words, others = [], []
    for term in sorted(set(terms)):
        (words if _word(term[0]) else others).append(term)
    ways = [edge + _trie(group) for edge, group in ((f"(?<!{WORD_BEHIND})", words), (f"(?<={WORD_BEHIND})", others)) if group]
    return f"(?=({'|'.join(ways)}))"


def begun_terms(term: str, terms: Iterable[str]) -> list[str]:
    """The terms found wherever ``term`` is: those that it begins with, up to an edge between words and others."""
    return [t for t in terms if term.startswith(t) and (t == term or _word(t[-1]) != _word(term[len(t)]))]


def keyword_hits(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Names of the keys that a text names: whole words, case-insensitive, any number of keys and terms.

    One pass over the text walks a prefix tree of all terms from every place where a word, or what stands
    between two, begins. It yields the longest term of the place; the shorter ones there are its
    beginnings and come with it. NULL for a NULL text.
    """
    names: dict[str, list[str]] = {}
    for name, terms in keywords.items():
        for term in filter(None, terms):
            names.setdefault(term.lower(), []).append(name)
    if not names:
        raise ValueError("no keyword given")
    beginnings: dict[str, list[str]] = {}
    for term in names:
        beginnings.setdefault(term[0], []).append(term)
    owners = F.create_map(*[
        x for term in names
        for x in (F.lit(term), F.array(*[
            F.lit(name) for name in dict.fromkeys(n for t in begun_terms(term, beginnings[term[0]]) for n in names[t])
        ]))
    ])
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(term_pattern(names)), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(found, lambda t: F.element_at(owners, t))))
