"""License scans: ordered signature rules with priorities.

Texts become words of lower-case letters, digits and whatever is not ASCII,
parted by one space. A document is scanned only if it holds a stem that every
rule's keyword holds; a rule's regular expression runs only if the document
holds its keyword. Overlapping detections are resolved by containment: one that
lies within another of the same or a higher priority is suppressed; of equal
intervals and priorities the earlier rule stays.

Column expressions only: no Python runs on the executors, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util

#: (label, words) of the phrases that always count, in the words of a text.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: label, keyword, what its name looks like in words. Order matters between equals.
NAMES = (
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license(?: (?:version|v) ?3| v3| 3 0| 3)"),
    ("agpl", "affero", "(?:gnu )?affero general public license"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl ?v?3(?: 0)?"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public license(?: version| v)? ?v?2 1"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public license(?: version| v)? ?v?3(?: 0)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public license"),
    ("lgpl-2.0", "library general", "(?:gnu )?library general public license(?: version| v)? ?v?2(?: 0)?"),
    ("lgpl", "library general", "(?:gnu )?library general public license"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?v?2 1"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?v?3(?: 0)?"),
    ("gpl-1.0", "general public", "(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?1(?: 0)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?2(?: 0)?"),
    ("gpl-3.0", "general public", "(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?3(?: 0)?"),
    ("gpl", "general public", "(?:gnu )?general public license"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?: version| v)? ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?: version| v)? ?v?3(?: 0)?"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation license(?: version)?(?: 1 [123])?"),
    ("apache-1.0", "apache", "apache(?: software)? license(?: version| v)? ?v?1 0"),
    ("apache-1.1", "apache", "apache(?: software)? license(?: version| v)? ?v?1 1"),
    ("apache-2.0", "apache", "apache(?: software)? license(?: version| v)? ?v?2(?: 0)?"),
    ("apache", "apache", "apache(?: software)? license"),
    ("mit", "mit", "(?:the )?mit(?: x11)? license"),
    ("mit-0", "mit", "mit no attribution(?: license)?"),
    ("x11", "x11", "x11 license"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd) license"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) license"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) license"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause|0bsd)(?: license)?"),
    ("bsd", "bsd", "bsd(?: style)? license"),
    ("isc", "isc", "isc license"),
    ("mpl-1.0", "mozilla", "mozilla public license(?: version| v)? ?v?1 0"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? ?v?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)? ?v?2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public license"),
    ("epl-1.0", "eclipse", "eclipse public license(?: version| v)? ?v?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? ?v?2(?: 0)?"),
    ("epl", "eclipse", "eclipse public license"),
    ("edl-1.0", "eclipse", "eclipse distribution license(?: version| v)? ?v?1(?: 0)?"),
    ("cddl-1.0", "common development", "common development and distribution license(?: version| v)? ?v?1(?: 0)?"),
    ("cddl-1.1", "common development", "common development and distribution license(?: version| v)? ?v?1 1"),
    ("cddl", "common development", "common development and distribution license"),
    ("cpl-1.0", "common public", "common public license(?: version)?(?: 1 0)?"),
    ("ipl-1.0", "ibm public", "ibm public license(?: version)?(?: 1 0)?"),
    ("eupl-1.1", "european union public", "european union public licen[cs]e(?: version| v)? ?v?1 1"),
    ("eupl-1.2", "european union public", "european union public licen[cs]e(?: version| v)? ?v?1 2"),
    ("eupl", "european union public", "european union public licen[cs]e"),
    ("bsl-1.0", "boost", "boost software license(?: version)?(?: 1 0)?"),
    ("busl-1.1", "business source", "business source license(?: version)?(?: 1 1)?"),
    ("sspl-1.0", "server side public", "server side public license(?: version)?(?: 1)?"),
    ("elastic-2.0", "elastic", "elastic license(?: version)?(?: 2 0)?"),
    ("afl-3.0", "academic free", "academic free license(?: version| v)?(?: ?v?3 0)?"),
    ("osl-3.0", "open software license", "open software license(?: version| v)?(?: ?v?3 0)?"),
    ("artistic-1.0", "artistic", "artistic license(?: version)? 1 0"),
    ("artistic-2.0", "artistic", "artistic license(?: version)? 2 0"),
    ("artistic", "artistic", "artistic license"),
    ("zlib", "zlib", "zlib(?: libpng)? license"),
    ("libpng", "libpng", "libpng license"),
    ("python-2.0", "python software foundation", "python software foundation license(?: version 2)?"),
    ("php-3.01", "php licen", "php license(?: version)?(?: 3 01)?"),
    ("ruby", "ruby licen", "ruby license"),
    ("postgresql", "postgresql", "postgresql license"),
    ("openssl", "openssl", "openssl license"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "do what the", "do what the f\\S* you want to public license"),
    ("beerware", "beerware", "beerware license"),
    ("json", "json licen", "json license"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license"),
    ("upl-1.0", "universal permissive", "universal permissive license(?: version| v)?(?: 1 0)?"),
    ("ms-pl", "microsoft public", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal license"),
    ("ofl-1.1", "open font", "(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("odbl-1.0", "open database", "open (?:data commons )?(?:open )?database license(?: v?1 0)?"),
    ("odc-by-1.0", "open data commons", "open data commons attribution license(?: v?1 0)?"),
    ("pddl-1.0", "public domain dedication", "(?:open data commons )?public domain dedication and license"),
    ("cecill-2.1", "cecill", "cecill(?: license)?(?: version)? 2 1"),
    ("cecill", "cecill", "cecill license"),
    ("mulan-psl-2.0", "mulan", "mulan permissive software license(?: version| v)?(?: ?v?2)?"),
    ("vim", "vim licen", "vim license"),
    ("w3c", "w3c", "w3c software(?: notice and)? license"),
    ("lppl-1.3c", "latex project", "latex project public license(?: version)?(?: 1 3c?)?"),
    ("qpl-1.0", "q public", "q public license(?: version)?(?: 1 0)?"),
    ("sleepycat", "sleepycat", "sleepycat license"),
    ("hpnd", "historical permission", "historical permission notice and disclaimer"),
    ("openrail-m", "openrail", "(?:bigscience )?openrail m(?: license)?"),
    ("rail-1.0", "rail licen", "(?:bigscience )?rail license(?: v?1 0)?"),
    ("llama-2", "llama 2", "llama 2 community license(?: agreement)?"),
    ("llama-3", "llama 3", "llama 3 community license(?: agreement)?"),
    ("ccdl", "community data", "community data license agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?"),
    ("ogl-uk-3.0", "open government", "open government licen[cs]e(?: version| v)?(?: ?v?3 0)?"),
    ("etalab-2.0", "licence ouverte", "(?:etalab )?licence ouverte(?: version)?(?: 2 0)?"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons zero", "creative commons zero(?: v?1 0)?(?: universal)?"),
    ("cc-pdm-1.0", "public domain mark", "public domain mark(?: 1 0)?"),
)
#: Notices without a license's name.
NOTICES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", "this software is provided", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("gpl", "free software foundation", "under the terms of the gnu general public license as published by the free software foundation"),
    ("public-domain", "public domain", "(?:dedicated to|released into|in) the public domain"),
)
CC_PARTS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Identifiers as tags name them, in words.
IDENTIFIERS = (
    "mit", "mit-0", "apache-1.0", "apache-1.1", "apache-2.0", "gpl-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause",
    "0bsd", "isc", "mpl-1.0", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0", "cddl-1.0", "cddl-1.1", "eupl-1.1", "eupl-1.2", "bsl-1.0", "busl-1.1", "sspl-1.0", "elastic-2.0", "afl-3.0", "osl-3.0",
    "artistic-1.0", "artistic-2.0", "zlib", "python-2.0", "php-3.01", "postgresql", "openssl", "unlicense", "wtfpl", "ncsa", "upl-1.0", "ms-pl", "ms-rl", "ofl-1.1", "odbl-1.0", "pddl-1.0", "cecill-2.1",
    "lppl-1.3c", "cc0-1.0", "x11", "vim", "w3c", "json", "beerware",
)
#: A notice that licensed texts open with too: it labels only texts in which nothing else is found.
RESERVED = ("proprietary", "all rights reserved", "all rights reserved")
TAG, GRANT, MENTION = 3, 2, 1
SCORES = {TAG: 1.0, GRANT: 0.9, MENTION: 0.6}
GRANTED = "(?:licen[cs]ed|released|distributed|available|published|provided|made available)(?: to you)? under(?: the terms of)?(?: the| a| an)? "
#: A document without any of these holds no rule's keyword.
STEMS = ("licen", "spdx", "creative", "cc by", "cc0", "gpl", "permission", "redistribution", "public domain", "all rights reserved", "this software is provided", "free software foundation", "historical", "bsd", "mit no", "cecill", "openrail")


def _tagged(words: str) -> str:
    """An identifier as a tag's first, or within the tag's next words after `or` or
    `and`. The words come before the look behind, which so runs only where they stand."""
    end = "(?: only| or later)?"
    return f"spdx license identifier {words}{end}|{words}(?<=spdx license identifier [a-z0-9 ]{{1,48}} (?:or|and) {words}){end}"


def rules() -> list:
    """(label, keyword, expression, priority), in order."""
    out = []
    for tag in IDENTIFIERS:
        words = tag.replace("-", " ").replace(".", " ")
        out.append((tag, "spdx", _tagged(words), TAG))
    for parts in CC_PARTS:
        label = "cc-" + parts.replace(" ", "-")
        spelled = " ".join(CC_WORDS[p] for p in parts.split())
        for v in CC_VERSIONS:
            name = f"{label}-{v.replace(' ', '.')}"
            out += [
                (name, "spdx", _tagged(f"cc {parts} {v}"), TAG),
                (name, "creativecommons", f"creativecommons org licenses {parts} {v}", TAG),
                (name, "cc by", f"{GRANTED}cc {parts} {v}(?: license)?", GRANT),
                (name, "cc by", f"cc {parts} {v}(?: license)?", MENTION),
                (name, "creative commons", f"creative commons {spelled} {v}(?: international| unported| generic)?(?: license)?", MENTION),
                (name, "creative commons", f"{GRANTED}creative commons {spelled} {v}(?: international| unported| generic)?(?: license)?", GRANT),
            ]
        out += [(label, "cc by", f"cc {parts}(?: license)?", MENTION), (label, "creative commons", f"creative commons {spelled}(?: license)?", MENTION)]
    for label, keyword, spelled in NAMES:
        name = spelled.replace("license", "licen[cs]e")
        out += [(label, keyword, f"{GRANTED}{name}", GRANT), (label, keyword, name, MENTION)]
    out += [(label, keyword, body, GRANT) for label, keyword, body in NOTICES]
    out.append((*RESERVED, MENTION))
    return out


OPEN, CLOSE = "\x01", "\x02"


def _places(text: str, body: str) -> str:
    """SQL: array of (s, e), first word and past the last, of an expression's matches in text (words with a space before and after each)."""
    marked = f"split(trim(regexp_replace({text}, concat('(?<= )(', {body}, ')(?= )'), '{OPEN}$1{CLOSE}')), ' ')"
    starts = f"filter(transform(m, (w, i) -> if(startswith(w, '{OPEN}'), i, null)), x -> x IS NOT NULL)"
    ends = f"filter(transform(m, (w, i) -> if(endswith(w, '{CLOSE}'), i + 1, null)), x -> x IS NOT NULL)"
    return f"element_at(transform(array({marked}), m -> arrays_zip({starts}, {ends})), 1)"


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words_of(text: Column) -> Column:
    """The words of a text, each with a space before, and one at the end; empty without words."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    return F.when(F.length(spaced) > 0, F.concat(F.lit(" "), spaced, F.lit(" "))).otherwise("")


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels,
    score and detections (replacing columns so named).

    detections: the kept detections as (first, past, label, priority), by place.
    Base phrases count wherever their words stand; their labels always stay. The
    score is that of the surest kept detection, or 0.6 for a base phrase alone.
    `proprietary` ("all rights reserved") is kept only where nothing else is.
    Null and empty texts: no words, no labels, null places, score 0. Every row is
    judged by itself, so ties, repeated rows, nulls elsewhere and empty tables
    need no rule.
    """
    docs, restored = util.shielded(docs)
    table = rules()
    literal = ", ".join(f"named_struct('l', {_literal(l)}, 'k', {_literal(k)}, 'r', {_literal(r)}, 'p', {p}, 'o', {o})" for o, (l, k, r, p) in enumerate(table))
    own = docs.withColumn("__w", words_of(docs[text_col]))
    n_words = F.greatest(F.octet_length("__w") - F.octet_length(F.replace("__w", F.lit(" "))) - 1, F.lit(0)).cast("long")
    lower = F.lower("__w")
    gate = None
    for stem in STEMS:
        has = F.contains(lower, F.lit(stem))
        gate = has if gate is None else gate | has
    own = own.withColumn("__gate", gate).withColumn("__l", F.when(F.col("__gate"), F.translate("__w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    base = ", ".join(f"transform({_places('__l', _literal(words))}, x -> named_struct('s', x['0'], 'l', '{label}'))" for label, words in BASE)
    own = own.withColumn("__base", F.expr(f"if(__gate, concat({base}), null)"))
    # detections by place: outer ones before those they contain, then by priority and rule order
    fired = f"filter(array({literal}), r -> contains(__l, r.k))"
    found = f"flatten(transform({fired}, r -> transform({_places('__l', 'r.r')}, x -> named_struct('s', x['0'], 'e', -x['1'], 'p', -r.p, 'o', r.o, 'l', r.l))))"
    own = own.withColumn("__all", F.expr(f"if(__gate, array_sort({found}), null)"))
    reach = f"named_struct('a', 0, 'b', 0, 'c', 0, 'n', cast(array() as array<struct<first: int, past: int, label: string, priority: int>>))"
    # a, b, c: how far detections of priority 1, 2, 3 or higher reach so far
    step = """(k, d) -> named_struct(
        'a', greatest(k.a, -d.e), 'b', if(d.p <= -2, greatest(k.b, -d.e), k.b), 'c', if(d.p <= -3, greatest(k.c, -d.e), k.c),
        'n', if(-d.e <= (CASE d.p WHEN -1 THEN k.a WHEN -2 THEN k.b ELSE k.c END), k.n,
                concat(k.n, array(named_struct('first', d.s, 'past', -d.e, 'label', d.l, 'priority', -d.p)))))"""
    own = own.withColumn("detections", F.expr(f"if(__all IS NULL OR size(__all) = 0, cast(array() as array<struct<first: int, past: int, label: string, priority: int>>), aggregate(__all, {reach}, {step}, k -> k.n))"))
    other = f"x -> x.label <> '{RESERVED[0]}'"
    own = own.withColumn("detections", F.expr(f"if(exists(detections, {other}), filter(detections, {other}), detections)"))
    none = F.coalesce(F.size("__base"), F.lit(0)) < 1
    base_labels = F.expr("array_sort(array_distinct(transform(__base, x -> x.l)))")
    labels = F.expr("array_sort(array_union(coalesce(transform(__base, x -> x.l), array()), transform(detections, x -> x.label)))")
    sure = F.expr("array_max(transform(detections, x -> x.priority))")
    score = F.when(sure == TAG, SCORES[TAG]).when(sure == GRANT, SCORES[GRANT]).when((sure == MENTION) | ~none, SCORES[MENTION]).otherwise(0.0)
    out = own.withColumns(
        {
            "n_words": n_words,
            "n_base": F.when(none, 0).otherwise(F.size("__base")).cast("long"),
            "first_word": F.when(~none, F.expr("array_min(transform(__base, x -> x.s))")).cast("long"),
            "last_word": F.when(~none, F.expr("array_max(transform(__base, x -> x.s))")).cast("long"),
            "base_labels": F.when(none, "").otherwise(F.array_join(base_labels, ",")),
            "labels": F.array_join(labels, ","),
            "score": score.cast("double"),
        }
    )
    return restored(out.drop("__w", "__l", "__gate", "__base", "__all"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: words, base phrases, labels and score."""
    out = scan_licenses(util.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))


QUERIES = {"op1_license_scan": op1_license_scan}
