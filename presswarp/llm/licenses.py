"""License scans, native: ordered signature rules, each a regular expression gated by a keyword.

A text is lower-cased (A-Z only) and reduced to its words, joined by single spaces. Keywords that the reduced text contains
choose the rules to try; the rules' matches are intervals with a priority (a rule's place in the order). Taken in order of
priority, an interval is dropped if it lies inside one that stands or overlaps one partly; one that contains others takes their
place. So an interval dropped for its priority never takes down what it covered. Everything is one projection: no shuffle, no
Python.

Defined results: null and empty texts have no words and no detections; repeated rows are scanned one by one; an empty table
gives an empty result; other columns are passed through by ``scan_licenses`` and never read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed by the contract: phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


class Rule(NamedTuple):
    keyword: str  # must occur in the reduced text
    regex: str  # over the reduced text
    label: str
    strength: float  # how sure a match makes us


def _versioned(name: str, label: str, versions: tuple[str, ...], keyword: str, plain: bool = True) -> list[Rule]:
    """A family's rules, the most specific first: licensed under it with a version, named with a version, named."""
    rules = []
    for v in versions:
        digits = v.replace(".", " ")
        zero = digits.removesuffix(" 0")
        number = f"(?:v|version |v )?{digits}" if digits == zero else f"(?:v|version |v )?{zero}(?: 0)?"
        later = " or (?:at your option )?(?:any )?later(?: version)?"
        tag = f"{label}-{v}"
        rules += [
            Rule(keyword, f"licen[sc]ed under (?:the )?(?:terms of )?(?:the )?{name} {number}{later}", f"{tag}-or-later", 1.0),
            Rule(keyword, f"licen[sc]ed under (?:the )?(?:terms of )?(?:the )?{name} {number}", tag, 1.0),
            Rule(keyword, f"{name} {number}{later}", f"{tag}-or-later", 0.95),
            Rule(keyword, f"{name} {number}", tag, 0.9),
        ]
    if plain:
        rules += [Rule(keyword, f"licen[sc]ed under (?:the )?(?:terms of )?(?:the )?{name}", label, 0.95), Rule(keyword, name, label, 0.7)]
    return rules


def license_rules() -> list[Rule]:
    """The rules in order of priority. Families are written by hand; their versions are spelled out by ``_versioned``."""
    r: list[Rule] = []
    # machine-readable tags
    for tag, label in (
        ("mit", "mit"), ("apache 2 0", "apache-2.0"), ("bsd 2 clause", "bsd-2-clause"), ("bsd 3 clause", "bsd-3-clause"), ("isc", "isc"), ("0bsd", "0bsd"),
        ("gpl 2 0 only", "gpl-2.0"), ("gpl 2 0 or later", "gpl-2.0-or-later"), ("gpl 3 0 only", "gpl-3.0"), ("gpl 3 0 or later", "gpl-3.0-or-later"),
        ("lgpl 2 1 only", "lgpl-2.1"), ("lgpl 2 1 or later", "lgpl-2.1-or-later"), ("lgpl 3 0 only", "lgpl-3.0"), ("lgpl 3 0 or later", "lgpl-3.0-or-later"),
        ("agpl 3 0 only", "agpl-3.0"), ("agpl 3 0 or later", "agpl-3.0-or-later"), ("mpl 2 0", "mpl-2.0"), ("epl 2 0", "epl-2.0"), ("epl 1 0", "epl-1.0"),
        ("unlicense", "unlicense"), ("cc0 1 0", "cc0-1.0"), ("wtfpl", "wtfpl"), ("zlib", "zlib"), ("bsl 1 0", "bsl-1.0"), ("artistic 2 0", "artistic-2.0"),
    ):
        r.append(Rule("spdx license identifier", f"spdx license identifier {tag}", label, 1.0))
    # the whole grant texts, by sentences that are theirs alone
    r += [
        Rule("permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", "mit", 1.0),
        Rule("redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", "bsd", 1.0),
        Rule("redistribution and use", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors", "bsd-3-clause", 0.95),
        Rule("permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee", "isc", 1.0),
        Rule("free and unencumbered", "this is free and unencumbered software released into the public domain", "unlicense", 1.0),
        Rule("altered source versions", "altered source versions must be plainly marked as such", "zlib", 0.95),
        Rule("boost software license", "boost software license(?: version 1 0)?", "bsl-1.0", 0.95),
        Rule("do what the f", "do what the f[^ ]* you want to public license", "wtfpl", 1.0),
        Rule("all rights reserved", "all rights reserved", "all-rights-reserved", 0.6),
        Rule("public domain", "(?:released|dedicated|placed) (?:in|in ?to|to) the public domain", "public-domain", 0.9),
        Rule("public domain", "public domain", "public-domain", 0.5),
    ]
    # families with versions
    r += _versioned("gnu affero general public license", "agpl", ("1.0", "3.0"), "affero general public license")
    r += _versioned("(?:gnu )?affero gpl", "agpl", ("1.0", "3.0"), "affero gpl")
    r += _versioned("gnu lesser general public license", "lgpl", ("2.1", "3.0"), "lesser general public license")
    r += _versioned("gnu library general public license", "lgpl", ("2.0",), "library general public license")
    r += _versioned("gnu general public license", "gpl", ("1.0", "2.0", "3.0"), "gnu general public license")
    r += _versioned("gnu free documentation license", "gfdl", ("1.1", "1.2", "1.3"), "free documentation license")
    r += _versioned("(?:gnu )?agpl", "agpl", ("3.0",), " agpl")
    r += _versioned("(?:gnu )?lgpl", "lgpl", ("2.1", "3.0"), " lgpl")
    r += _versioned("(?:gnu )?gpl", "gpl", ("2.0", "3.0"), " gpl")
    r += _versioned("apache license", "apache", ("1.0", "1.1", "2.0"), "apache license")
    r += _versioned("apache software license", "apache", ("1.0", "1.1", "2.0"), "apache software license")
    r += _versioned("mozilla public license", "mpl", ("1.0", "1.1", "2.0"), "mozilla public license")
    r += _versioned("eclipse public license", "epl", ("1.0", "2.0"), "eclipse public license")
    r += _versioned("eclipse distribution license", "edl", ("1.0",), "eclipse distribution license")
    r += _versioned("common development and distribution license", "cddl", ("1.0", "1.1"), "common development and distribution")
    r += _versioned("european union public licen[sc]e", "eupl", ("1.1", "1.2"), "european union public")
    r += _versioned("artistic license", "artistic", ("1.0", "2.0"), "artistic license")
    r += _versioned("academic free license", "afl", ("2.1", "3.0"), "academic free license")
    r += _versioned("open software license", "osl", ("2.1", "3.0"), "open software license")
    r += _versioned("server side public license", "sspl", ("1.0",), "server side public license")
    r += _versioned("business source license", "busl", ("1.1",), "business source license")
    r += _versioned("elastic license", "elastic", ("2.0",), "elastic license")
    r += _versioned("open database license", "odbl", ("1.0",), "open database license")
    r += _versioned("open font license", "ofl", ("1.0", "1.1"), "open font license")
    r += _versioned("python software foundation license", "psf", ("2.0",), "python software foundation")
    r += _versioned("cecill(?: [abc])?(?: free software)? licen[sc]e", "cecill", ("2.0", "2.1"), "cecill")
    # creative commons, by name and by short name, longest first
    parts = (("attribution noncommercial noderiv(?:ative)?s", "by nc nd"), ("attribution non ?commercial sharealike", "by nc sa"), ("attribution non ?commercial", "by nc"), ("attribution noderiv(?:ative)?s", "by nd"), ("attribution share ?alike", "by sa"), ("attribution", "by"))
    for words, short in parts:
        label = "cc-" + short.replace(" ", "-")
        for v in ("4.0", "3.0", "2.5", "2.0", "1.0"):
            digits = v.replace(".", " ")
            r.append(Rule("creative commons", f"creative commons {words}(?: international| unported| generic)? {digits}(?: international| unported| generic)?", f"{label}-{v}", 1.0))
            r.append(Rule("cc by", f"cc {short} {digits}", f"{label}-{v}", 0.9))
        r.append(Rule("creative commons", f"creative commons {words}", label, 0.9))
        r.append(Rule("cc by", f"cc {short}", label, 0.7))
    r += [
        Rule("creativecommons org", "creativecommons org licenses (?:by(?: nc)?(?: nd| sa)?) \\d \\d", "cc", 0.95),
        Rule("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0-1.0", 0.9),
        Rule("creative commons", "creative commons(?: zero| cc0)", "cc0-1.0", 0.9),
        Rule("creative commons", "creative commons(?: license)?", "cc", 0.5),
    ]
    # names without versions
    for name, label in (("mit license", "mit"), ("expat license", "mit"), ("x11 license", "x11"), ("isc license", "isc"), ("zlib license", "zlib"), ("bsd license", "bsd"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("beerware", "beerware")):
        r.append(Rule(name, f"licen[sc]ed under (?:the )?(?:terms of )?(?:the )?{name}", label, 1.0))
        r.append(Rule(name, name, label, 0.7))
    for n, words in ((2, "simplified|freebsd"), (3, "new|revised|modified"), (4, "original")):
        r.append(Rule(" bsd ", f"bsd {n} clause(?: license)?", f"bsd-{n}-clause", 0.9))
        r.append(Rule(" bsd ", f"{n} clause bsd(?: license)?", f"bsd-{n}-clause", 0.9))
        r.append(Rule(" bsd ", f"(?:{words}) bsd license", f"bsd-{n}-clause", 0.9))
    # grants and reservations in general words
    for words, label, strength in (
        ("no part of this (?:[^ ]+ ){1,3}may be reproduced", "all-rights-reserved", 0.9), ("may not be reproduced", "all-rights-reserved", 0.7), ("without (?:the )?prior written permission", "all-rights-reserved", 0.6),
        ("used with permission", "permission", 0.5), ("proprietary and confidential", "proprietary", 0.9), ("for internal use only", "proprietary", 0.6),
        ("dual licen[sc]ed", "dual", 0.5), ("royalty free license", "royalty-free", 0.6), ("perpetual license", "perpetual", 0.5), ("commercial license", "commercial", 0.6),
        ("end user license agreement", "eula", 0.8), ("licen[sc]ed under", "named-elsewhere", 0.3), ("see (?:the )?license file", "named-elsewhere", 0.4), ("copyright (?:c )?(?:19|20)\\d\\d", "copyright", 0.4),
    ):
        r.append(Rule({"no": "may be reproduced", "may": "may not be reproduced", "without": "prior written permission", "see": "license file", "copyright": "copyright ", "dual": "dual licen", "licen[sc]ed": "ed under"}.get(words.split(" ")[0], words), words, label, strength))
    return r


def reduced(text: Column) -> Column:
    """The words with single spaces before, between and after; one space for a text without words."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), NOT_A_WORD, " ")


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def n_words(flat: Column) -> Column:
    return (spaces(flat) - 1).cast("bigint")


def word_at(flat: Column, position: Column) -> Column:
    """Number of the word that begins at the (1-based) position."""
    return (spaces(F.substring(flat, F.lit(1), position)) - 1).cast("bigint")


def base_scan(flat: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels, over the contract's phrases."""
    total, firsts, lasts, labels = F.lit(0), [], [], []
    turned = F.reverse(flat)
    for phrase, label in BASE:
        whole = f" {phrase} "
        there = F.contains(flat, F.lit(whole))
        total = total + F.when(there, F.regexp_count(flat, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0)
        firsts.append(F.when(there, word_at(flat, F.instr(flat, whole))))
        back = F.length(flat) - F.instr(turned, whole[::-1]) - len(whole) + 2
        lasts.append(F.when(there, word_at(flat, back.cast("int"))))
        labels.append(F.when(there, F.lit(label)))
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
    return {"n_base": total.cast("bigint"), "first_word": F.least(*firsts), "last_word": F.greatest(*lasts), "base": found}


def rule_table() -> Column:
    return F.array(*[F.struct(F.lit(k).alias("place"), F.lit(x.keyword).alias("keyword"), F.lit(f"(?<= )(?:{x.regex})(?= )").alias("regex"), F.lit(x.label).alias("label"), F.lit(x.strength).alias("strength")) for k, x in enumerate(license_rules())])


def bound(value: Column, f) -> Column:
    """f of the value, which is evaluated once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, join) -> Column:
    """The running sums (or maxima: join is associative) of an array of whole numbers. Blocks of about the root of its length are
    summed one by one and moved by what stands before them, so the copies that ``aggregate`` makes stay few."""

    def plain(numbers: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            now = F.when(s["last"].isNull(), x).otherwise(join(s["last"], x))
            return F.struct(now.alias("last"), F.concat(s["out"], F.array(now)).alias("out"))

        return F.aggregate(numbers, start, step)["out"]

    def blocks(numbers: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(numbers))), F.lit(1)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / width).cast("int")), lambda b: plain(F.slice(numbers, b * width + 1, width)))
        return F.when(F.size(numbers) > 0, bound(cut, moved)).otherwise(F.array().cast("array<int>"))

    def moved(own: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("int")), plain(F.transform(own, lambda o: F.element_at(o, -1))))
        return F.flatten(F.zip_with(own, F.slice(before, F.lit(1), F.size(own)), lambda o, at: F.when(at.isNull(), o).otherwise(F.transform(o, lambda x: join(at, x)))))

    return bound(values, blocks)


def matches(flat: Column, rule: Column) -> Column:
    """The rule's matches as (start, minus_stop, place, label, strength), positions from 0 in the reduced text."""
    hits = F.transform(F.regexp_extract_all(flat, rule["regex"], F.lit(0)), F.length)

    def placed(x: Column) -> Column:
        gaps = F.slice(F.transform(F.split(flat, rule["regex"]), F.length), F.lit(1), F.size(x))
        stops = running(F.zip_with(gaps, x, lambda gap, hit: gap + hit), lambda a, b: a + b)
        return F.zip_with(stops, x, lambda stop, hit: F.struct((stop - hit).alias("start"), (-stop).alias("minus_stop"), rule["place"].alias("place"), rule["label"].alias("label"), rule["strength"].alias("strength")))

    return bound(hits, placed)


_KEPT = "array<struct<start:int,minus_stop:int,place:int,label:string,strength:double>>"


def _contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (a["minus_stop"] <= b["minus_stop"])


def _settled(cluster: Column) -> Column:
    """The detections that stand among those of a cluster: see the module's text."""

    def step(kept: Column, d: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["start"] < -d["minus_stop"]) & (d["start"] < -k["minus_stop"]) & (_contains(k, d) | ~_contains(d, k)))
        return F.when(clash, kept).otherwise(F.concat(F.filter(kept, lambda k: ~_contains(d, k)), F.array(d)))

    by_place = F.array_sort(F.transform(cluster, lambda d: F.struct(d["place"].alias("place"), d["start"].alias("start"), d.alias("d"))))
    return F.array_sort(F.aggregate(F.transform(by_place, lambda x: x["d"]), F.array().cast(_KEPT), step))


def suppressed(detections: Column) -> Column:
    """Kept detections, by start. Detections that touch one another, directly or through others, are a cluster, settled by itself:
    the work grows with the square of a cluster, and with the power 1.5 of what a text has."""

    def clusters(d: Column) -> Column:
        def cut(reach: Column) -> Column:
            # a cluster begins where all before have ended
            opens = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: (i == 0) | (F.get(d, i)["start"] >= F.get(reach, i - 1)))

            def settle(o: Column) -> Column:
                ends = F.concat(F.slice(o, F.lit(2), F.size(o)), F.array(F.size(d)))
                # not slice(d, ...), which copies all of d each time
                own = lambda a, b: F.transform(F.sequence(a, b - 1), lambda i: F.get(d, i))
                each = F.zip_with(o, ends, lambda a, b: F.when(b - a == 1, own(a, b)).otherwise(_settled(own(a, b))))
                return F.flatten(each)

            return bound(opens, settle)

        return F.when(F.size(d) > 0, bound(running(F.transform(d, lambda x: -x["minus_stop"]), F.greatest), cut)).otherwise(F.array().cast(_KEPT))

    return bound(F.array_sort(detections), clusters)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``flat`` (the reduced text) and ``detections``: array of (start, stop, place, label, strength), suppressed. Columns of
    these names are replaced."""
    docs = docs.drop("flat", "detections")
    gate_name = free_name("keywords", docs.columns)
    flat = docs.withColumn("flat", reduced(F.col(text)))
    keywords = list(dict.fromkeys(x.keyword for x in license_rules()))
    gated = flat.withColumn(gate_name, F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("flat"), k)))
    rules = F.filter(rule_table(), lambda r: F.array_contains(F.col(gate_name), r["keyword"]))
    hits = F.flatten(F.transform(rules, lambda r: matches(F.col("flat"), r)))
    kept = F.when(F.size(gate_name) > 0, suppressed(hits)).otherwise(F.array().cast(_KEPT))
    out = gated.withColumn("detections", kept).drop(gate_name)
    return out.withColumn("detections", F.transform("detections", lambda d: F.struct(d["start"].alias("start"), (-d["minus_stop"]).alias("stop"), d["place"].alias("place"), d["label"].alias("label"), d["strength"].alias("strength"))))


def license_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's columns for each document."""
    scanned = scan_licenses(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    base = base_scan(F.col("flat"))
    rows = scanned.select("doc_id", n_words(F.col("flat")).alias("n_words"), *[c.alias(k) for k, c in base.items()], "detections")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    score = F.coalesce(F.array_max(F.transform("detections", lambda d: d["strength"])), F.lit(0.0))
    score = F.greatest(score, F.when(F.col("n_base") > 0, F.lit(0.7)).otherwise(F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.size("detections").alias("n_detections"))
