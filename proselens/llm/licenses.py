"""License scans: ordered signature rules with a keyword gate, priorities and suppression of contained intervals.

A text is first put into words (A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``), each with a blank on
either side, so that a rule is a regular expression over whole words that needs no look-around and means the same in
Spark and in DuckDB.  Rules are written by hand, each with
its own words: sentences that only one license has (``SIGNATURES``), and license families (label, names, version words)
in the contexts that a name can stand in (license statements, identifier lines, links, notices), each with a priority
and a confidence.  They amount to some hundreds of expressions.

1. A gate over the raw text: one expression for all keywords.  Texts without a keyword leave here, with word counts only.
2. Each rule needs words of its own (a family's name, say); only rules whose words are in the text are matched.
3. Every match is an interval of words with the rule's priority.  A match that lies within a match of another rule with
   higher priority (or equal priority and earlier rule) is suppressed: one sweep over the matches in the order of their
   starts, in which only those that have not ended are compared.  Base phrases are matched beside that and stay.

The matches of a rule are marked in the text by one pass, and their places are running sums of the pieces between the
marks, so a text costs its length for each rule whose words it has, however many matches there are.

All of it is one projection over built-in functions: no shuffle, no Python on the executors; rows stay where they are.

Defined cases: a null text counts as empty; an empty text has no words and score 0; repeated rows are scanned each;
very long texts are scanned whole; an empty table gives an empty result; other columns are kept, but for those that are
named as the results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.functions.text import let, running

from .common import fresh, table

#: A word as the contract writes it, for lower-cased text, and the same set of characters (with A-Z, before they are
#: lower-cased) as Java matches it some twenty times faster.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTER = r"0-9A-Za-z\x{80}-\x{10FFFF}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public license families: label, names in words, version words that can follow a name.
FAMILIES = [
    ("agpl", ["gnu affero general public license", "affero general public license", "agpl"], ["1", "3"]),
    ("apache", ["apache license", "apache software license"], ["1 0", "1 1", "2 0"]),
    ("artistic", ["artistic license"], ["1 0", "2 0"]),
    ("boost", ["boost software license", "bsl"], ["1 0"]),
    ("bsd", ["bsd license", "berkeley software distribution license"], ["2 clause", "3 clause", "4 clause"]),
    ("cc0", ["creative commons zero", "cc0"], ["1 0"]),
    ("cc-by-nc-nd", ["creative commons attribution noncommercial noderivatives", "cc by nc nd"], ["2 0", "3 0", "4 0"]),
    ("cc-by-nc-sa", ["creative commons attribution noncommercial sharealike", "cc by nc sa"], ["2 0", "3 0", "4 0"]),
    ("cc-by-nc", ["creative commons attribution noncommercial", "cc by nc"], ["2 0", "3 0", "4 0"]),
    ("cc-by-nd", ["creative commons attribution noderivatives", "cc by nd"], ["2 0", "3 0", "4 0"]),
    ("cc-by-sa", ["creative commons attribution sharealike", "cc by sa"], ["2 0", "3 0", "4 0"]),
    ("cc-by", ["creative commons attribution", "cc by"], ["2 0", "3 0", "4 0"]),
    ("cddl", ["common development and distribution license", "cddl"], ["1 0", "1 1"]),
    ("epl", ["eclipse public license", "epl"], ["1 0", "2 0"]),
    ("eupl", ["european union public licence", "eupl"], ["1 1", "1 2"]),
    ("gfdl", ["gnu free documentation license", "gfdl"], ["1 1", "1 2", "1 3"]),
    ("gpl", ["gnu general public license", "general public license", "gpl"], ["1", "2", "3", "2 0", "3 0"]),
    ("isc", ["isc license"], []),
    ("lgpl", ["gnu lesser general public license", "lesser general public license", "library general public license", "lgpl"], ["2", "2 1", "3"]),
    ("mit", ["mit license", "expat license"], []),
    ("mpl", ["mozilla public license", "mpl"], ["1 0", "1 1", "2 0"]),
    ("odbl", ["open database license", "odbl"], ["1 0"]),
    ("ofl", ["sil open font license", "open font license", "ofl"], ["1 0", "1 1"]),
    ("unlicense", ["unlicense"], []),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], ["2"]),
    ("zlib", ["zlib license", "zlib libpng license"], []),
]

# Contexts of a name: words before it, words after its version, priority, confidence, whether a version
# has to (True), may (None) or must not (False) follow.  [a|b]: one of these or nothing; <a|b>: one of these.
CONTEXTS = [
    ("spdx license identifier", "", 90, 0.99, None),
    ("<licensed|distributed|released> under [the|a|an]", "", 70, 0.95, None),
    ("under the terms of [the|a|an]", "", 70, 0.95, None),
    ("<available|provided> under [the|a|an]", "", 66, 0.9, None),
    ("subject to [the|a|an]", "", 60, 0.85, None),
    ("", "or [any] later", 58, 0.85, True),
    ("", "", 50, 0.8, True),
    ("", "", 30, 0.6, False),
]

# Notices without a family's name: label, words, gate word, priority, confidence.
NOTICES = [
    ("reserved", "all rights reserved", "reserved", 40, 0.7),
    ("public-domain", "<in_the|into_the|to_the> public domain", "public", 40, 0.7),
    ("copyright", "copyright [c] [0-9]{4}", "copyright", 20, 0.3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby", 80, 0.97),
    ("bsd", "redistribution and use in source and binary forms", "redistribution", 80, 0.97),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission", 80, 0.97),
    ("apache", "you may not use this file except in compliance with the license", "compliance", 80, 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 80, 0.97),
    ("proprietary", "<proprietary_and_confidential|confidential_and_proprietary>", "proprietary", 45, 0.7),
    ("proprietary", "unauthorized <copying|reproduction|distribution>", "unauthorized", 35, 0.5),
]


# Sentences of license texts and usual notices: label, words, a word that the text must have.
SIGNATURES = [
    ("agpl", "your modified version must prominently offer all users interacting with it remotely", "remotely"),
    ("agpl", "remote network interaction use with the gnu general public license", "remote"),
    ("apache", "grant of copyright license subject to the terms and conditions of this license each contributor", "contributor"),
    ("apache", "grant of patent license subject to the terms and conditions of this license each contributor", "patent"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license", "writing"),
    ("apache", "you may obtain a copy of the license at", "obtain"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "intent"),
    ("artistic", "the copyright holder maintains some semblance of artistic control", "semblance"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "organization"),
    ("boost", "must be included in all copies of the software in whole or in part and all derivative works", "derivative"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions"),
    ("bsd", "neither the name of <the|any> [copyright] [holder|holders|organization|university] nor the names of its contributors", "neither"),
    ("bsd", "all advertising materials mentioning features or use of this software must display", "advertising"),
    ("cc0", "has waived all copyright and related or neighboring rights", "waived"),
    ("cc0", "to the extent possible under law the person who associated cc0", "associated"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format", "redistribute"),
    ("cc-by", "you must give appropriate credit provide a link to the license", "credit"),
    ("cc-by-nc", "you may not use the material for commercial purposes", "commercial"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", "remix"),
    ("cc-by-sa", "you must distribute your contributions under the same license as the original", "contributions"),
    ("cddl", "covered software is provided under this license on an as is basis", "covered"),
    ("cddl", "common development and distribution license the license you may not use this file", "development"),
    ("ecl", "educational community license", "educational"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse", "eclipse"),
    ("epl", "each contributor hereby grants recipient a non exclusive worldwide royalty free copyright license", "recipient"),
    ("eupl", "licensed under the eupl", "eupl"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "documentation"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", "invariant"),
    ("gpl", "this program is free software you can redistribute it and or modify it", "redistribute"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "hope"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "received"),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it", "freedom"),
    ("gpl", "as a special exception you may use this file as part of a free software library without restriction", "exception"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee", "fee"),
    ("json", "the software shall be used for good not evil", "evil"),
    ("lgpl", "this library is free software you can redistribute it and or modify it", "library"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", "lesser"),
    ("lgpl", "when we speak of free software of this kind we are referring to freedom of use", "referring"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "shall"),
    ("mit", "the software is provided as is without warranty of any kind express or implied", "provided"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish", "merge"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("ms-pl", "microsoft public license", "microsoft"),
    ("ms-rl", "microsoft reciprocal license", "microsoft"),
    ("ncsa", "university of illinois ncsa open source license", "ncsa"),
    ("odbl", "this database is made available under the open database license", "database"),
    ("ofl", "this font software is licensed under the sil open font license", "font"),
    ("ofl", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", "font"),
    ("openssl", "this product includes software developed by the openssl project", "openssl"),
    ("php", "this product includes php software freely available from", "php"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", "documentation"),
    ("psf", "python software foundation license", "python"),
    ("ruby", "you may redistribute it and or modify it under either the terms of the", "either"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "compile"),
    ("unlicense", "for the benefit of the public at large and to the detriment of our heirs and successors", "heirs"),
    ("vim", "vim is charityware", "charityware"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used", "consortium"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "liable"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented", "misrepresented"),
    ("zlib", "the origin of this software must not be misrepresented", "origin"),
    ("zope", "zope public license", "zope"),
    ("proprietary", "this software is the confidential and proprietary information of", "confidential"),
    ("proprietary", "may not be reproduced or distributed without [the] [prior] written permission", "reproduced"),
    ("proprietary", "no part of this <publication|document|work> may be reproduced", "reproduced"),
    ("proprietary", "not for redistribution", "redistribution"),
    ("proprietary", "for internal use only", "internal"),
    ("proprietary", "licensed not sold", "sold"),
    ("public-domain", "dedicated to the public domain", "dedicated"),
    ("public-domain", "no rights reserved", "reserved"),
    ("public-domain", "no known copyright restrictions", "restrictions"),
    ("reserved", "some rights reserved", "reserved"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    needs: str
    priority: int
    confidence: float


def spaced(words: str) -> str:
    """Words in the notation above as an expression over the spaced form of a text."""
    out = []
    for token in words.split():
        mark = token[0] + token[-1]
        if mark in ("[]", "<>"):
            choice = "|".join("".join(f" {w} " for w in x.split("_")) for x in token[1:-1].split("|"))
            out.append(f"(?:{choice})" + "?" * (mark == "[]"))
        else:
            out.append(f" {token} ")
    return "".join(out)


def rules() -> list[Rule]:
    """All rules in order: the families' names in each context, then the signatures, then the notices."""
    made = []
    for before, after, priority, confidence, versioned in CONTEXTS:
        for label, names, versions in FAMILIES:
            if versioned and not versions:
                continue
            number = f"(?:{spaced('[version|v]')}(?:{'|'.join(spaced(v) for v in sorted(versions, key=len, reverse=True))}))" if versions and versioned is not False else ""
            for name in names:
                made.append(Rule(label, spaced(before) + spaced(name) + number + "?" * bool(number and versioned is None) + spaced(after), gate_word(name), spaced(name), priority, confidence))
    made += [Rule(label, spaced(words), word, spaced(word), 85, 0.97) for label, words, word in SIGNATURES]
    made += [Rule(label, spaced(words), word, spaced(word), priority, confidence) for label, words, word, priority, confidence in NOTICES]
    return made


def gate_word(name: str) -> str:
    """The word of a name that lets a text through the gate: the least common one."""
    words = name.split()
    return next((w for w in words if w in ("license", "licence", "creative")), words[0])


RULES = rules()
KEYWORDS = sorted({r.keyword for r in RULES} | {"cc", "license", "reserved"})
GATE = f"(?<![{_LETTER}])(?i:{'|'.join(KEYWORDS)})(?![{_LETTER}])"


def spaced_text(text: Column) -> Column:
    """The words of a text, lower-cased, each with a blank on either side; no words: the empty string."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[{_LETTER}]+"), 0)
    return F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))).otherwise("")


def _n_words(spaced_form: Column) -> Column:
    return ((F.length(spaced_form) - F.length(F.replace(spaced_form, F.lit(" "), F.lit("")))) / 2).cast("long")


MATCH = "struct<start:int,back:int,weight:int,rule:int>"
MADE = ["n_words", "n_base", "first_word", "last_word", "base", "found"]


def _standing(matches: Column) -> Column:
    """The numbers of the rules of the matches that no match of a rule that goes before them holds, in the order of their starts.

    ``matches``: array of (start, minus end, minus priority, rule), so that in its order a match comes after all that
    can hold it.  The sweep keeps the matches that have not ended, and puts out blocks.
    """
    none = F.array().cast("array<int>")
    begin = F.struct(F.array().cast(f"array<{MATCH}>").alias("open"), none.alias("block"), F.array().cast("array<array<int>>").alias("blocks"))

    def step(a: Column, x: Column) -> Column:
        def judged(open_: Column) -> Column:
            held = F.exists(open_, lambda y: (y["back"] <= x["back"]) & ((y["weight"] < x["weight"]) | ((y["weight"] == x["weight"]) & (y["rule"] < x["rule"]))))
            return let(held, lambda h: put(open_, h))

        def put(open_: Column, held: Column) -> Column:
            block = F.when(held, a["block"]).otherwise(F.array_append(a["block"], x["rule"]))
            full = F.size(a["block"]) >= 64
            return F.struct(
                F.when(held, open_).otherwise(F.array_append(open_, x)).alias("open"),
                F.when(full, F.when(held, none).otherwise(F.array(x["rule"]))).otherwise(block).alias("block"),
                F.when(full, F.array_append(a["blocks"], a["block"])).otherwise(a["blocks"]).alias("blocks"),
            )

        return let(F.filter(a["open"], lambda y: -y["back"] > x["start"]), judged)

    return F.aggregate(F.array_sort(matches), begin, step, lambda a: F.concat(F.flatten(a["blocks"]), a["block"]))


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as (the columns ``keep``, by default all; what the rules and the base phrases find).

    ``found``: the numbers of the rules whose matches stand, in the order of the text.  Columns of ``docs`` that are named
    as one of the results give way to it.
    """
    names = [c for c in keep or docs.columns if c not in MADE]
    s_, d_, n_ = fresh(docs, "spaced", "matched", "words")
    text = F.coalesce(F.col("text"), F.lit(""))
    gated = docs.select(*names, F.regexp_count(text, F.lit(f"[{_LETTER}]+")).cast("long").alias(n_), F.when(text.rlike(GATE), spaced_text(text)).otherwise("").alias(s_))
    table_of_rules = F.array(*(F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.needs).alias("needs"), F.lit(-r.priority).alias("weight"), F.lit(i).alias("rule")) for i, r in enumerate(RULES)))
    s = F.col(s_)

    def matches(r: Column) -> Column:
        """Matches are put between two marks by one pass; the text is split before each."""
        pieces = F.split(F.regexp_replace(s, r["pattern"], F.lit("\x01$0\x02")), "\x01")

        def placed(p: Column) -> Column:
            ends = running(F.transform(p, lambda x, k: F.length(x) - F.when(k > 0, 1).otherwise(0)))
            own = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.instr(x, "\x02") - 1)
            return F.zip_with(F.slice(ends, 1, F.size(own)), own, lambda at, n: F.struct(at.alias("start"), (-(at + n)).cast("int").alias("back"), r["weight"].alias("weight"), r["rule"].alias("rule")))

        return let(pieces, placed)

    candidates = F.filter(table_of_rules, lambda r: F.contains(s, r["needs"]))
    none = F.array().cast(f"array<{MATCH}>")
    matched = gated.withColumn(d_, F.when(s != "", F.flatten(F.transform(candidates, matches))).otherwise(none))

    phrases = list(BASE)
    pieces = {p: F.split(s, spaced(p)) for p in phrases}
    places = {p: F.when(s != "", F.size(pieces[p]) - 1).otherwise(0) for p in phrases}
    firsts = [F.when(places[p] > 0, _n_words(F.element_at(pieces[p], 1))) for p in phrases]
    lasts = [F.when(places[p] > 0, _n_words(s) - _n_words(F.element_at(pieces[p], -1)) - len(p.split())) for p in phrases]
    base = F.array_compact(F.array(*(F.when(places[p] > 0, F.lit(BASE[p])) for p in phrases)))
    return matched.select(
        *names,
        F.col(n_).alias("n_words"),
        sum((places[p] for p in phrases[1:]), places[phrases[0]]).cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"),
        _standing(F.col(d_)).alias("found"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License and rights notices in every whole text of ``documents``."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    label, sure = F.array(*(F.lit(r.label) for r in RULES)), F.array(*(F.lit(r.confidence) for r in RULES))
    rules = F.array_distinct("found")
    labels = F.array_sort(F.array_union("base", F.transform(rules, lambda i: F.get(label, i))))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(rules, lambda i: F.get(sure, i))), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    values = ", ".join(f"({i}, '{r.label}', '{r.pattern}', {r.priority}, {r.confidence}::double)" for i, r in enumerate(RULES))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in BASE.items())
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as w from t),
s as (select doc_id, len(w) as n, case when len(w) > 0 then ' ' || array_to_string(w, '  ') || ' ' else '' end as s from w),
b as (select doc_id, label, k, i from (select doc_id, n, w, p.label, p.k, string_split(p.words, ' ') as q, unnest(range(0, n - p.k + 1)) as i
      from s join w using (doc_id), (values {phrases}) as p(words, label, k) where n >= p.k) where w[i + 1:i + k] = q),
bb as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from b group by doc_id),
r(rule, label, pattern, priority, confidence) as (values {values}),
d0 as (select doc_id, r.*, regexp_extract_all(s, pattern) as m, string_split_regex(s, pattern) as g from s, r where regexp_matches(s, pattern)),
d1 as (select *, unnest(range(1, len(m) + 1)) as k from d0),
d as (select doc_id, rule, label, priority, confidence, m[k] as x,
      list_sum(list_transform(g[1:k], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda v: length(v))), 0) as a from d1),
f as (select x.doc_id, x.label, x.confidence from d x where not exists (select 1 from d y where y.doc_id = x.doc_id
      and y.a <= x.a and y.a + length(y.x) >= x.a + length(x.x) and (y.priority > x.priority or (y.priority = x.priority and y.rule < x.rule)))),
l as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from f union all select doc_id, label from b) group by doc_id),
c as (select doc_id, max(confidence) as score from f group by doc_id)
select s.doc_id, s.n::bigint as n_words, coalesce(bb.n_base, 0)::bigint as n_base, bb.first_word::bigint as first_word, bb.last_word::bigint as last_word,
       coalesce(bb.base_labels, '') as base_labels, coalesce(l.labels, '') as labels, coalesce(c.score, 0)::double as score
from s left join bb using (doc_id) left join l using (doc_id) left join c using (doc_id)
"""


ORACLE = _oracle()
