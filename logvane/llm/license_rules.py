"""License detection by ordered signature rules, in DataFrame expressions only.

A text becomes lower-case words parted by single spaces. A rule is a regular
expression over those words with a label, a priority and a weight. Rules only
run on texts that hold one of the rule's keywords: literals derived from its
expression, one of which is in every match, so no hit is lost. Of the hits
left, one inside another of the same or a better priority is suppressed.

The base phrases are searched in every text and always keep their labels.

Defined cases: a null or empty text has no words, no hits, null positions,
empty label strings and score 0. Repeated rows are judged one by one. Hits with
equal extent keep the better priority, then the alphabetically first label.
Very long texts are scanned whole: the hits of one text are sorted and swept
once, so a text made of nothing but license lines stays cheap. Columns of the
input that carry the name of a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _parser
except ImportError:  # Python 3.10
    import sre_parse as _parser

# ---- fixed values: phrases whose every place is counted, and their labels
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# ---- signatures: (label, how the words of its name may read)
_ANY_VERSION = "( version)?( ?v)?"


def _versioned(label: str, name: str, versions: list[str]) -> list[tuple[str, str]]:
    """One signature for each version of a license: its dots read as spaces, a final zero may be missing."""
    found = []
    for version in versions:
        words = version.replace(".", " ")
        words = words.removesuffix(" 0") + "( 0)?" if words.endswith(" 0") else words
        found.append((f"{label}-{version}", f"{name}( license| licence)?{_ANY_VERSION} ?{words}"))
    return found


def _commons() -> list[tuple[str, str]]:
    """Creative Commons: every allowed set of conditions, short and long names, every version."""
    long = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(ative)?s?", "sa": "share ?alike"}
    found = []
    for parts in (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        label = "cc-" + "-".join(parts)
        for name in ("cc " + " ".join(parts), "creative commons " + " ".join(long[p] for p in parts)):
            found.append((label, name))
            for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
                found.append((f"{label}-{version}", f"{name}( license)?{_ANY_VERSION} ?{version.replace('.', ' ')}"))
    return found


def _gnu() -> list[tuple[str, str]]:
    """The GNU family with its versions, each also as "only" and "or later"."""
    kinds = [
        ("gpl", "(gnu )?general public licen[sc]e", ["1", "2", "3"]), ("gpl", "(gnu )?gpl", ["1", "2", "3"]),
        ("lgpl", "(gnu )?lesser general public licen[sc]e", ["2", "2.1", "3"]),
        ("lgpl", "(gnu )?library general public licen[sc]e", ["2", "2.1"]),
        ("lgpl", "(gnu )?lgpl", ["2", "2.1", "3"]),
        ("agpl", "(gnu )?affero general public licen[sc]e", ["1", "3"]), ("agpl", "(gnu )?agpl", ["1", "3"]),
        ("gfdl", "(gnu )?free documentation licen[sc]e", ["1.1", "1.2", "1.3"]),
        ("gfdl", "(gnu )?gfdl", ["1.1", "1.2", "1.3"]),
    ]
    found = []
    for label, name, versions in kinds:
        found.append((label, name))
        for version in versions:
            digits = version.replace(".", " ")
            read = f"{name}{_ANY_VERSION} ?{digits}( 0)?"
            found.append((f"{label}-{version}", read))
            found.append((f"{label}-{version}-only", f"{read} only"))
            found.append((f"{label}-{version}-or-later", f"{read}( or( at your option)?( any)? later( version)?)"))
    return found


SIGNATURES = [
    *_versioned("apache", "apache( software)?", ["1.0", "1.1", "2.0"]),
    ("apache", "apache( software)? licen[sc]e"),
    ("mit", "mit licen[sc]e"), ("mit", "expat( licen[sc]e)?"), ("mit-0", "mit (no attribution|0)( licen[sc]e)?"),
    ("x11", "x11 licen[sc]e"), ("isc", "isc licen[sc]e"), ("zlib", "zlib( libpng)? licen[sc]e"),
    ("bsd", "bsd( style)? licen[sc]e"), ("bsd-0-clause", "(0|zero) clause bsd( licen[sc]e)?"),
    ("bsd-1-clause", "((1|one) clause bsd|bsd (1|one) clause)( licen[sc]e)?"),
    ("bsd-2-clause", "((2|two) clause bsd|bsd (2|two) clause|simplified bsd|freebsd)( licen[sc]e)?"),
    ("bsd-3-clause", "((3|three) clause bsd|bsd (3|three) clause|(new|modified|revised) bsd)( licen[sc]e)?"),
    ("bsd-4-clause", "((4|four) clause bsd|bsd (4|four) clause|(original|old) bsd)( licen[sc]e)?"),
    *_gnu(), *_commons(),
    ("cc0-1.0", "cc0( 1 0)?( universal)?"), ("cc0-1.0", "creative commons zero( v1 0)?"),
    *_versioned("mpl", "mozilla public", ["1.0", "1.1", "2.0"]), *_versioned("mpl", "mpl", ["1.0", "1.1", "2.0"]),
    *_versioned("epl", "eclipse public", ["1.0", "2.0"]), *_versioned("epl", "epl", ["1.0", "2.0"]),
    *_versioned("eupl", "eupl", ["1.0", "1.1", "1.2"]),
    *_versioned("eupl", "european union public", ["1.0", "1.1", "1.2"]),
    *_versioned("cddl", "cddl", ["1.0", "1.1"]),
    *_versioned("cddl", "common development and distribution", ["1.0", "1.1"]),
    *_versioned("artistic", "artistic", ["1.0", "2.0"]), *_versioned("ofl", "(sil )?ofl", ["1.0", "1.1"]),
    *_versioned("ofl", "(sil )?open font", ["1.0", "1.1"]), *_versioned("php", "php", ["3.0", "3.01"]),
    *_versioned("psf", "python( software foundation)?", ["2.0", "3.0"]),
    *_versioned("zpl", "zope public", ["1.1", "2.0", "2.1"]),
    *_versioned("afl", "academic free", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    *_versioned("osl", "open software", ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    *_versioned("cecill", "cecill", ["1.0", "1.1", "2.0", "2.1"]),
    *_versioned("odbl", "open( data commons)?( open)? database", ["1.0"]), *_versioned("odbl", "odbl", ["1.0"]),
    *_versioned("pddl", "(odc )?pddl", ["1.0"]), *_versioned("lppl", "lppl", ["1.0", "1.1", "1.2", "1.3"]),
    *_versioned("rpl", "reciprocal public", ["1.1", "1.5"]), *_versioned("cpl", "common public", ["1.0"]),
    *_versioned("ibm-pl", "ibm public", ["1.0"]), *_versioned("upl", "universal permissive", ["1.0"]),
    *_versioned("blueoak", "blue oak model", ["1.0.0"]), *_versioned("bsl", "business source", ["1.0", "1.1"]),
    *_versioned("sspl", "server side public", ["1"]), *_versioned("elastic", "elastic", ["1.0", "2.0"]),
    ("boost-1.0", "boost software licen[sc]e( version)?( 1 0)?"), ("ms-pl", "microsoft public licen[sc]e"),
    ("ms-rl", "microsoft reciprocal licen[sc]e"), ("ncsa", "(university of illinois )?ncsa( open source)? licen[sc]e"),
    ("postgresql", "postgresql licen[sc]e"), ("openssl", "openssl licen[sc]e"),
    ("w3c", "w3c software( notice and)? licen[sc]e"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"),
    ("beerware", "beerware licen[sc]e"), ("json", "json licen[sc]e"), ("vim", "vim licen[sc]e"),
    ("qpl-1.0", "q public licen[sc]e( version)?( 1 0)?"), ("ruby", "ruby licen[sc]e"),
]
#: passages of license texts, as (label, words)
PASSAGES = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose"),
    ("zlib-text", "this software is provided as is without any express or implied warranty"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("public-domain", "(released into|dedicated to|placed in|in) the public domain"),
    ("proprietary", "proprietary and confidential"),
    ("no-license", "all rights reserved"),
]
#: how a signature may stand in a text: (priority, weight, words before it); a smaller priority number is better
FORMS = [
    (0, 1.0, "spdx license identifier "),
    (1, 0.95, "(licen[sc]ed|released|distributed|available|published|provided|covered)( for use)? (under|by|through)"
              "( the terms( and conditions)? of)?( the| a| an)? "),
    (2, 0.6, ""),
]
#: most strings that are kept while a pattern is spelled out, and most literals of one rule
_MOST_SPELLED, _MOST_LITERALS = 64, 8


def _spelled(pattern: Iterable) -> set[str] | None:
    """All strings that a parsed pattern can read; None if they are too many."""
    found = {""}
    for part in pattern:
        nxt = _readings(*part)
        if nxt is None or len(found) * len(nxt) > _MOST_SPELLED:
            return None
        found = {a + b for a in found for b in nxt}
    return found


def _readings(kind, value) -> set[str] | None:
    """All strings that one part of a parsed pattern can read; None for parts that are not spelled out."""
    if kind is _parser.LITERAL:
        return {chr(value)}
    if kind is _parser.IN and all(k is _parser.LITERAL for k, _ in value):
        return {chr(v) for _, v in value}
    if kind is _parser.SUBPATTERN:
        return _spelled(value[-1])
    if kind is _parser.BRANCH:
        sides = [_spelled(side) for side in value[1]]
        return None if None in sides else set().union(*sides)
    if kind is _parser.MAX_REPEAT and value[:2] == (0, 1):
        once = _spelled(value[2])
        return None if once is None else once | {""}
    if kind is _parser.ASSERT and value[0] == 1:  # what follows a match is in the text as well
        return _spelled(value[1])
    return None


def literals(pattern: str) -> tuple[str, ...]:
    """Strings one of which stands in every text that the pattern is found in.

    They are beginnings of what the pattern reads: the longest whose number
    stays small. One that contains another is left out.
    """
    best, found = {""}, {""}
    for part in _parser.parse(pattern):
        nxt = _readings(*part)
        if nxt is None or len(found) * len(nxt) > _MOST_SPELLED:
            break
        found = {a + b for a in found for b in nxt}
        least = {x for x in found if not any(y != x and y in x for y in found)}
        if len(least) <= _MOST_LITERALS and min(map(len, least)) > min(map(len, best)):
            best = least
    return tuple(sorted(best))


def _any_of(strings: Iterable[str]) -> str:
    """A regular expression that finds any of some strings of letters, digits and spaces, common beginnings shared."""
    ends: dict[str, set[str]] = {}
    for x in strings:
        if not x:
            return ""
        ends.setdefault(x[0], set()).add(x[1:])
    sides = [first + _any_of(rest) for first, rest in sorted(ends.items())]
    return sides[0] if len(sides) == 1 else f"(?:{'|'.join(sides)})"


# every way to stand in a text ends with a space, so the literals of a name hold for all of them
RULES = [
    (label, literals(f" {name}(?= )"), f" {lead}{name}(?= )", priority, weight)
    for label, name in SIGNATURES for priority, weight, lead in FORMS
] + [(label, literals(f" {words}(?= )"), f" {words}(?= )", 0, 0.9) for label, words in PASSAGES]
#: without one of these no rule can hold
KEYWORDS = sorted({k for rule in RULES for k in rule[1]})
GATE = _any_of(KEYWORDS)

RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_hits"]
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_string(text: Column) -> Column:
    """`` w0 w1 ... ``: every word between single spaces; one space if there is no word.

    Lower-casing beyond A-Z cannot move a word boundary: no such character
    turns into a separator.
    """
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), _SEPARATORS, " ")))


def _spaces(words: Column) -> Column:
    return F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))


def _literal_rules() -> Column:
    """The rules as one constant, which the optimizer folds."""
    return F.expr("array(" + ", ".join(
        f"named_struct('label', '{label}', 'keywords', split('{','.join(keywords)}', ','), 'pattern', '{pattern}', "
        f"'priority', {priority}, 'weight', {weight}D)"
        for label, keywords, pattern, priority, weight in RULES
    ) + ")")


def _places(words: Column, rule: Column) -> Column:
    """``start, back, priority, label, weight`` of every hit of a rule; ``back`` is the negated end."""
    between = F.split(words, rule["pattern"], -1)
    found = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    lengths = F.transform(F.arrays_zip(
        F.transform(between, _spaces).alias("gap"), F.transform(found, _spaces).alias("size")
    ), lambda x: F.struct(x["gap"].alias("gap"), F.coalesce(x["size"], F.lit(0)).alias("size")))
    empty = F.expr("cast(array() as array<struct<start:int,back:int,priority:int,label:string,weight:double>>)")
    return F.aggregate(
        F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), empty.alias("hits")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["hits"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("start"), (-(acc["at"] + x["gap"] + x["size"])).alias("back"),
                rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight"),
            ))).alias("hits"),
        ),
        lambda acc: acc["hits"],
    )


def _sweep(hits: Column) -> Column:
    """Labels, best weight and number of the hits that no earlier hit of the same or a better priority contains.

    Hits are sorted by start, longer ones first, so a container always comes
    before what it contains. ``reach`` is the furthest end so far by priority.
    """
    levels = sorted({rule[3] for rule in RULES})
    start = F.struct(
        F.array(*[F.lit(-1) for _ in levels]).alias("reach"), F.expr("cast(array() as array<string>)").alias("labels"),
        F.lit(0.0).alias("weight"), F.lit(0).alias("n"),
    )

    def step(acc: Column, hit: Column) -> Column:
        end = -hit["back"]
        inside = F.exists(F.slice(acc["reach"], F.lit(1), hit["priority"] + 1), lambda r: r >= end)
        reach = F.transform(acc["reach"], lambda r, i: F.when(i == hit["priority"], F.greatest(r, end)).otherwise(r))
        return F.struct(
            reach.alias("reach"),
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(hit["label"]))).alias("labels"),
            F.when(inside, acc["weight"]).otherwise(F.greatest(acc["weight"], hit["weight"])).alias("weight"),
            (acc["n"] + F.when(inside, 0).otherwise(1)).alias("n"),
        )

    return F.aggregate(F.array_sort(hits), start, step)


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """The input with ``n_words, n_base, first_word, last_word, base_labels, labels, score, n_hits``."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in RESULT]
    words, present, hits = F.col("_lic_words"), F.col("_lic_present"), F.col("_lic_hits")
    out = df.select(*kept, word_string(F.col(f"`{text}`")).alias("_lic_words"))
    base = [
        F.when(F.contains(words, F.lit(f" {phrase} ")), F.split(words, f" {phrase}(?= )", -1)).alias(f"_lic_base{i}")
        for i, (phrase, _) in enumerate(BASE_PHRASES)
    ]
    present_now = F.when(words.rlike(GATE), F.filter(F.split(F.lit(",".join(KEYWORDS)), ","), lambda k: F.contains(words, k)))
    out = out.select("*", (_spaces(words) - 1).alias("n_words"), *base, present_now.alias("_lic_present"))
    all_hits = F.when(F.size(present) > 0, F.flatten(F.transform(
        F.filter(_literal_rules(), lambda r: F.arrays_overlap(present, r["keywords"])), lambda r: _places(words, r)
    )))
    out = out.select("*", all_hits.alias("_lic_all")).select("*", F.when(F.size("_lic_all") > 0, _sweep(F.col("_lic_all"))).alias("_lic_hits"))
    firsts, lasts, counts, labels = [], [], [], []
    for i, (phrase, label) in enumerate(BASE_PHRASES):
        pieces, size = F.col(f"_lic_base{i}"), len(phrase.split())
        firsts.append(_spaces(pieces[0]))
        lasts.append(F.col("n_words") - (_spaces(F.element_at(pieces, -1)) - 1) - size)
        counts.append(F.coalesce(F.size(pieces) - 1, F.lit(0)))
        labels.append(F.when(pieces.isNotNull(), F.lit(label)))
    base_labels = F.array_compact(F.array(*labels))
    own = F.coalesce(hits["labels"], F.expr("cast(array() as array<string>)"))
    any_base = reduce(lambda a, b: a | b, [F.col(f"_lic_base{i}").isNotNull() for i in range(len(BASE_PHRASES))])
    return out.select(
        *kept, F.col("n_words").cast("long"), reduce(lambda a, b: a + b, counts).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"),
        F.when(any_base, F.lit(1.0)).otherwise(F.coalesce(hits["weight"], F.lit(0.0))).alias("score"),
        F.coalesce(hits["n"], F.lit(0)).cast("long").alias("n_hits"),
    )
