import re

import regex

from skein.llm import licenses as ls
from skein.llm import util

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    base = [(k, label) for label, phrase in ls.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    padded = " " + " ".join(words) + " " if words else ""
    found = []
    for o, (label, keyword, body, priority) in enumerate(ls.rules()):
        if keyword in padded:
            for m in regex.finditer(f"(?<= )({body})(?= )", padded):
                s = padded[: m.start()].count(" ") - 1
                found.append((s, s + m[0].count(" ") + 1, priority, o, label))
    kept = []
    for d in found:
        inside = [x for x in found if x is not d and x[0] <= d[0] and d[1] <= x[1] and x[2] >= d[2]]
        inside = [x for x in inside if (x[0], x[1]) != (d[0], d[1]) or x[2] > d[2] or x[3] < d[3]]
        if not inside:
            kept.append(d)
    kept = [d for d in kept if d[4] != "proprietary"] or kept
    labels = sorted({x[4] for x in kept} | {x for _, x in base})
    best = max([d[2] for d in kept], default=1 if base else 0)
    score = ls.SCORES.get(best, 0.0)
    starts = [k for k, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(labels), score, len(kept)


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")


def test_rules():
    every = ls.rules()
    assert len(every) >= 300
    for label, keyword, body, priority in every:
        assert any(stem in keyword or stem in body for stem in ls.STEMS), (label, keyword, body)
        assert " ".join(label.split()) == label and priority in ls.SCORES


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in util.table(spark, d, "documents").collect()}
    out = ls.op1_license_scan(spark, d).collect()
    assert len(out) == len(texts)
    for r in out:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id]), r.doc_id
    assert sum(r.n_base > 0 for r in out) > 5


def test_texts_and_edges(spark):
    texts = [
        None, "", " .,; ", "MIT", "MIT License", "mit-license MIT\nLICENSE, the mit license", "mit licensed", "summit license", "émit license mitK license",
        "Licensed under the Apache License, Version 2.0 (the License)", "SPDX-License-Identifier: GPL-2.0-or-later", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "https://creativecommons.org/licenses/by-sa/3.0/", "dual: MIT License or Apache License 2.0; GNU Lesser General Public License v2.1",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "The İMIT License \x00 mit license", "word " * 30000 + "general public license", "mit license " * 300,
        "General Public LICENSE general public license version 2", "SPDX-License-Identifier: Apache-2.0 and again apache-2.0 license apache license",
    ]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id long, text string, labels string")
    out = ls.scan_licenses(df).withColumn("n_detections", util.F.size("detections")).collect()
    for r in out:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.id]), texts[r.id]
    assert ls.scan_licenses(df.where("false")).count() == 0


def test_expressions_spellings_and_reserved_rights(spark):
    texts = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2.0,mit",
        "SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause) OR ISC, by us": "bsd-3-clause,gpl-2.0,isc",
        "SPDX-License-Identifier: MIT. This library goes well with pumps and pipes, with the zlib and others, or X11": "mit",
        "Released under the Boost Software Licence, version 1.0": "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation": "bsl-1.0",
        "Copyright X. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "Copyright X. All rights reserved.": "proprietary",
        "the PHP licence 3.01": "php-3.01",
    }
    df = spark.createDataFrame([(t, "w") for t in texts], "text string, __w string")
    out = ls.scan_licenses(df)
    assert {r.text: r.labels for r in out.collect()} == texts
    assert out.columns[:2] == ["text", "__w"] and {r["__w"] for r in out.collect()} == {"w"}
    for r in out.collect():
        assert tuple(r[c] for c in COLUMNS[:-1]) == brute(r.text)[:-1], r.text


def test_no_python_and_no_shuffle_in_the_plan(spark, sf_dir):
    plan = ls.op1_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
