import random
import re
import textwrap

import duckdb

from chainloom.llm import licenses

HARD = [
    "under the MIT License under the mit-license! CC BY-NC, cc_by nc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of THIS software and documentation files\nnothing",
    "the license, apache version 2.0 under Licensed",
    "under the mıt license, under the MİT license, ﬀ cc by ncé",
    "Apache License Version 2 Apache License Version 2",
]


def brute(text):
    words = re.findall(licenses.WORD + "+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    at = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    met = []
    for line in (text or "").split("\n"):
        held = set(licenses._split(line))
        for label, t in licenses.TEMPLATES:
            s = set(licenses._split(t))
            if len(held & s) >= licenses.THRESHOLD * len(s):
                met.append((len(held & s) / len(s), label))
    base = sorted({x for _, x in at})
    every = sorted({*base, *(x for _, x in met)})
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(every), max((c for c, _ in met), default=0.0)


def test_edges_match_brute_force(spark, odd_docs):
    extra = spark.createDataFrame([(i + 100, t, None, None, 1, "k", 0.5) for i, t in enumerate(HARD)], odd_docs.schema)
    docs = odd_docs.unionByName(extra)
    key = lambda x: tuple((v is None, str(v)) for v in x)
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=key)
    assert sorted((tuple(r) for r in licenses.license_scan(docs).collect()), key=key) == want
    assert any("mit" in w[6] for w in want)
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_sql_agrees(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert sorted(tuple(r) for r in licenses.op6_license_scan(spark, data).collect()) == sorted(con.sql(licenses.OP6_SQL).fetchall())


MIT = licenses.TEMPLATES[1][1]
GPL = licenses.TEMPLATES[6][1]


def brute_wrapped(text):
    """Labels and score over lines, and over every run of words of every paragraph."""
    met = [x for x in [brute(text)] if x[6] > 0]
    score, labels = max((x[6] for x in met), default=0.0), set(filter(None, brute(text)[5].split(",")))
    for paragraph in re.split(f"\n{licenses.GAP}*\n", text):
        said = licenses._split(paragraph)
        for label, t in licenses.TEMPLATES if "\n" in paragraph else ():
            s, n = set(licenses._split(t)), licenses.run_length(t)
            best = max((len(s & set(said[i : i + n])) for i in range(len(said))), default=0)
            if best >= licenses.THRESHOLD * len(s):
                labels.add(label)
                score = max(score, best / len(s))
    return ",".join(sorted(labels)), score


def wrapped(text, start=""):
    return "\n".join(start + x for x in textwrap.wrap(text, 40))


def test_wrapped_notices_are_found(spark):
    far = MIT.split()
    texts = {
        "mit": "Some title\n\n" + wrapped(MIT) + ', to deal in\nthe "Software"',
        "gpl": "/*\n" + wrapped(GPL, " * ") + "\n */\nint x;",
        "bsd": wrapped("x " + licenses.TEMPLATES[3][1], "# ").replace("\n", "\r\n"),
        "apache-2": "Licensed under the\nApache License,\nVersion 2.0",
        "isc,mit": wrapped("a b " + licenses.TEMPLATES[9][1]) + "\n" + wrapped(MIT + " z" * 3),
        "": "\n \n".join([" ".join(far[:9]), " ".join(far[9:])]),
        "none far": "\n".join(f"{w} " + "x " * 30 for w in far),
    }
    for left, label in ((1, "mit"), (4, "")):
        texts[f"{label} without {left}"] = wrapped(" ".join(far[:5] + far[5 + left :]))
    rng = random.Random(4)
    for k in range(60):
        words = [w for _, t in rng.sample(licenses.TEMPLATES, 3) for w in t.split()]
        words = [w for w in words if rng.random() > 0.04 for w in [w, "x"][: 1 + (rng.random() < 0.03)]]
        texts[k] = "".join(w + rng.choice([" "] * 6 + ["\n"] * 2 + ["\n\n"] * (rng.random() < 0.1)) for w in words)
    rows = list(texts.items())
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(docs).collect()}
    assert got == {i: brute_wrapped(t) for i, (_, t) in enumerate(rows)}
    for i, name in enumerate(["mit", "gpl", "bsd", "apache-2", "isc,mit", "", "", "mit", ""]):
        assert got[i][0] == name, rows[i]
    assert sum(bool(x[0]) for x in got.values()) > 30
