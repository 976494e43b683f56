"""License scans against plain searches and against SQL."""

import re

import duckdb
import pytest

from tallyscope.llm import license_scan as L
from tallyscope.llm.queries import LLM_QUERIES, LLM_SQL


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


def plain(text):
    w = words(text)
    places = [(i, label) for p, label in L.BASE for i in range(len(w)) if w[i:i + len(words(p))] == words(p)]
    labels, score = {k for _, k in places}, 0.0
    for label, wording, must in L.TEMPLATES:
        t, wide = set(words(wording)), len(words(wording))
        if not set(words(must)) <= set(w):
            continue
        for i in range(len(w)):
            b = set(w[i:i + wide])
            if 5 * len(t & b) >= 4 * len(t) and set(words(must)) <= b:
                labels.add(label)
                score = max(score, len(t & b) / len(t))
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places})), ",".join(sorted(labels)), score)


TEXTS = [
    None, "", " \n-- ", "CC BY", "cc-by cc\nby all rights RESERVED.", "the General, Public\n License", "cc byé", "Licensed under the Apache License Version 3.0",
    "apache license\nversion 2 0 licensed under the", "Permission is granted, free of charge, to any person obtaining copy of software", "All rights reserved",
    "all all rights reserved reserved", "word " * 50000 + "\nReleased under MIT License", "Released under the MIT License\n" * 3,
]


def test_odd_texts(spark):
    texts = TEXTS + [w for _, w, _ in L.TEMPLATES] + [" ".join(reversed(w.split()[1:])) for _, w, _ in L.TEMPLATES]
    rows = [(i if i % 7 else None, t, 1.5) for i, t in enumerate(texts)]
    got = L.scan(spark.createDataFrame(rows + rows[:3], "doc_id long, text string, score double").repartition(3))
    assert got.columns == ["doc_id", "text", *L.RESULT]
    out = got.collect()
    assert len(out) == len(rows) + 3
    for r in out:
        assert tuple(r)[2:] == pytest.approx(plain(r.text)), (r.text or "")[:60]
    assert L.scan(got.limit(0)).count() == 0


WRAPPED = [
    ("Copyright (c) 1999 X\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided", "isc"),
    ("// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy", "mpl-2.0"),
    ("Released under the GPL License", ""), ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"), ("Licensed under the Mozilla Public License, Version 2.0", ""),
    ("Licensed under the Apache License, Version 3.0", ""), ("Licensed under the Apache License,\nVersion 2.0 (the License)", "apache-2.0"),
    ("Redistribution of " + "many " * 30 + "source and binary forms, with or without modification, are permitted", ""),
]


def test_wrapped_headers_and_like_wordings(spark):
    """Wordings broken over lines are found, those that only share most words with a template are not."""
    got = L.scan(spark.createDataFrame(list(enumerate(t for t, _ in WRAPPED)), "doc_id int, text string"))
    assert {r.doc_id: r.labels for r in got.collect()} == {i: label for i, (_, label) in enumerate(WRAPPED)}


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    rel = con.execute(LLM_SQL["op8_license_scan"])
    names = [d[0] for d in rel.description]
    want = {r[0]: r[1:] for r in rel.fetchall()}
    got = LLM_QUERIES["op8_license_scan"](spark, small)
    assert sorted(got.columns) == sorted(names)
    for r in got.select(*names).collect():
        assert tuple(r)[1:] == pytest.approx(want[r.doc_id])
    assert len(want) == got.count() and any(w[5] for w in want.values())
