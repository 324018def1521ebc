from ledgerline.llm.licences import LEAST, TEMPLATES, Matcher, blocks, licences, matched, passages

from .data import clashing, collected, empty, frame, prose

SCHEMA = "path string, text string, licence string, label string"


def test_every_template_finds_itself():
    m = Matcher({}, 10)
    for name, texts in TEMPLATES.items():
        for t in texts:
            assert m.match(t) and m.match(t)[0] == name, (name, t)
    assert m.match("nothing of the kind") is None and LEAST > 0.5


def test_passages():
    text = f"{prose(1, 50)}.\nLicensed under the MIT License. {prose(2, 30)}\n# SPDX-License-Identifier: MIT\n{prose(3, 9)}"
    assert passages(text) == ["Licensed under the MIT License.", "# SPDX-License-Identifier: MIT"]
    assert passages(prose(4, 400)) == []


MIT = """Copyright (c) 2015 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def test_wrapped_headers_are_matched_whole():
    m = Matcher({}, 1000)
    code = "\nimport os\n" + prose(5, 900)
    for header in (MIT, "\n".join(f"# {x}".rstrip() for x in MIT.split("\n")), "/*\n" + "\n".join(f" * {x}".rstrip() for x in MIT.split("\n")) + "\n */"):
        (block,) = blocks(header + "\n" + code)
        assert len(block) == 3 and "sublicense" in block[1] and "free of charge" in block[1] and "import" not in block[-1]
        tried, words = matched(m, header + "\n" + code)
        assert {x[0] for x in tried} == {"MIT"} and words >= len(MIT.split())


def test_nearest_ancestor(spark):
    files = [
        ("LICENSE", TEMPLATES["MIT"][3]), ("src/a.py", prose(1, 30)), ("src/sub/b.py", "# Licensed under the Apache License, Version 2.0.\n" + prose(2, 60)), ("vendor/COPYING", TEMPLATES["GPL-3.0"][2]),
        ("vendor/x/y/z.c", prose(3, 30)), ("vendor/x/LICENSE.txt", "This is free and unencumbered software released into the public domain."), ("vendorx/q.c", None), (None, prose(4, 30)), ("src/a.py", prose(1, 30)), ("top.c", ""),
    ]
    df = spark.createDataFrame([(*f, "x", "y") for f in files], SCHEMA)
    out = licences(df).collect()
    found = {r.path: (r.licence, r.inherited_from) for r in out}
    assert len(out) == len(files) and out[0].label == "y"
    assert found == {"LICENSE": ("MIT", None), "src/a.py": ("MIT", ""), "src/sub/b.py": ("Apache-2.0", None), "vendor/COPYING": ("GPL-3.0", None), "vendor/x/y/z.c": ("Unlicense", "vendor/x"), "vendor/x/LICENSE.txt": ("Unlicense", None), "vendorx/q.c": ("MIT", ""), None: (None, None), "top.c": ("MIT", "")}


def test_trouble_and_empty(spark):
    assert len(licences(clashing(spark)).collect()) == len(frame(spark).collect())
    assert licences(empty(spark).withColumnRenamed("source", "path")).collect() == []
    out = licences(frame(spark).withColumnRenamed("source", "path"))
    assert {r.licence for r in out.collect()} == {None} and collected(out.select("doc_id")) == collected(frame(spark).select("doc_id"))


def plain_cosine(frequency, n, a, b):
    """TF-IDF cosine of two texts by its definition, with dictionaries over all words; words of no template weigh 1."""
    import math
    import re

    words = lambda t: re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", t.lower())
    known = {w for ts in TEMPLATES.values() for t in ts for w in words(t)}

    def vector(t):
        out = {}
        for w in words(t):
            out[w] = out.get(w, 0) + 1
        return {w: (1 + math.log(c)) * (math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1) if w in known else 1.0 for w, c in out.items()}

    x, y = vector(a), vector(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[w] for w, v in x.items() if w in y) / norm if norm else 0.0


def test_whole_scan_against_plain_loops(spark):
    """Document frequencies, cosines and inheritance, by loops over all files."""
    import random
    import re

    r = random.Random(6)
    names = sorted(TEMPLATES)
    files = []
    for i in range(150):
        folder = "/".join(r.choice("abc") for _ in range(r.randint(0, 4)))
        t = r.choice(TEMPLATES[r.choice(names)])
        if r.random() < 0.3:
            w = t.split()
            t = " ".join(w[: max(3, r.randint(1, len(w)))])
        kind = r.random()
        name, text = ("LICENSE", t) if kind < 0.15 else (f"f{i}.txt", f"{prose(i, 40)}\n\n{t}\n\n{prose(900 + i, 40)}") if kind < 0.4 else (f"f{i}.txt", prose(i, 30))
        files.append((f"{folder}/{name}".lstrip("/") if r.random() < 0.95 else None, text))
    n, frequency = len(files), {}
    for _, text in files:
        for w in {x.strip(".") for x in re.findall(r"[a-z0-9.]+", text.lower())}:
            frequency[w] = frequency.get(w, 0) + 1
    best = lambda part: max(((round(max(plain_cosine(frequency, n, part, t) for t in TEMPLATES[k]), 9), k) for k in names), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
    own, directories = [], {}
    for path, text in files:
        tried, words = [], 0
        for block in blocks(text):
            whole = "\n".join(block)
            for part in [whole] if best(whole)[0] >= LEAST else block:
                if best(part)[0] >= LEAST:
                    tried, words = [*tried, best(part)], words + len(part.split())
                else:
                    tried += [best(x) for x in passages(part) if best(x)[0] >= LEAST]
                    words += sum(len(x.split()) for x in passages(part))
        whole = bool(path and re.match(r"(?i)(licen[cs]e|copying|copyright|notice|unlicense)([.\-_].*)?$", path.split("/")[-1])) or bool(passages(text)) and 2 * words >= len(text.split())
        tried += [best(text)] if whole and best(text)[0] >= LEAST else []
        found = min(tried, key=lambda x: (-x[0], x[1]), default=None)
        own.append(found and found[1])
        if found and whole and path is not None:
            at = path.rpartition("/")[0]
            directories[at] = min(directories.get(at, (1, "")), (-round(found[0], 6), found[1]))
    want = []
    for (path, _), licence in zip(files, own, strict=True):
        at, origin = (path or "").rpartition("/")[0], None
        while path is not None and licence is None:
            if at in directories:
                licence, origin = directories[at][1], at
            elif at:
                at = at.rpartition("/")[0]
                continue
            break
        want.append((path, licence, origin))
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "i int, path string, text string")
    got = [(x.path, x.licence, x.inherited_from) for x in sorted(licences(df).collect(), key=lambda x: x.i)]
    assert got == want and sum(x[2] is not None for x in want) > 20 and len({x[1] for x in want}) > 6


def test_columns_named_as_results_are_renamed(spark):
    out = licences(frame(spark).selectExpr("cast(doc_id as string) path", "text", "1 own_licence", "2 LICENCE", "3 ledgerline_dir"))
    assert {"own_licence_", "LICENCE_", "ledgerline_dir_", "licence", "own_licence"} <= set(out.columns) and {r["LICENCE_"] for r in out.collect()} == {2}
