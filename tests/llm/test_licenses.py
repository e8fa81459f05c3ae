import random
import re
import textwrap

import duckdb

from fathom.llm import queries
from fathom.llm.licenses import TEMPLATES, THRESHOLD, bigrams, normal_words, scan, size_bounds


def brute(text):
    units = [("text", text or "")] + [("line", x) for x in (text or "").split("\n")]
    found = []
    for scope, unit in units:
        g = set(bigrams(normal_words(unit)))
        for k, t in TEMPLATES.items():
            b = set(bigrams(normal_words(t)))
            if g and (d := 2 * len(g & b) / (len(g) + len(b))) >= THRESHOLD - 1e-12:
                found.append((-d, scope == "line", k, scope))
    best = min(found, default=None)
    return (best[2], round(-best[0], 12), best[3], len(found)) if best else (None, None, None, 0)


def test_matches_are_those_of_every_template(spark):
    mit, apache = TEMPLATES["MIT-text"], TEMPLATES["Apache-2.0-header"]
    texts = [None, "", "word", "\n\n", mit, mit.upper().replace(",", " ;"), "Intro.\n" + apache + "\nmore text\n" + TEMPLATES["MIT"], apache.replace("compliance", "accord").replace("file", "book"), "Licensed under the license", "x " * 50_000, mit[:200], *TEMPLATES.values(), "é ".join(mit.split(" ")), "RELEASED under the Mit license\nreleased under the mit license"]
    frame = spark.createDataFrame([(d, t, "z") for d, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r.doc_id: (r.license, r.dice and round(r.dice, 12), r.scope, r.n_matches) for r in scan(frame).collect()}
    assert got == {d: brute(t) for d, t in enumerate(texts)}
    assert scan(frame.limit(0)).collect() == []


def test_size_bounds_prune_nothing_that_could_match():
    for size in range(1, 60):
        low, high = size_bounds(size, THRESHOLD)
        for n in range(1, 200):
            assert (2 * min(n, size) / (n + size) >= THRESHOLD - 1e-12) == (low <= n <= high)


def test_short_notices_within_longer_texts(spark):
    notices = {"All rights reserved.": "all-rights-notice", "Licensed under the MIT License.": "MIT-licensed", "This project is licensed under the MIT License.": "MIT-project", "Licensed under CC BY 4.0.": "CC-BY-4.0-licensed"}
    frame = spark.createDataFrame([(d, f"Some words come first here.\n{x}\nand others after it") for d, x in enumerate(notices)], "doc_id long, text string")
    assert {r.doc_id: (r.license, r.dice, r.scope, r.n_matches) for r in scan(frame).collect()} == {d: (k, 1.0, "line", 1) for d, k in enumerate(notices.values())}


def brute_passages(text):
    """template -> dice of the best run of two or more lines that beats the text and each line."""
    lines = [w for x in text.split("\n") if (w := normal_words(x))]
    sets = [set(bigrams([w for x in lines[i:j] for w in x])) for i in range(len(lines)) for j in range(i + 2, len(lines) + 1)]
    units = [set(bigrams(w)) for w in [[w for x in lines for w in x], *lines]]
    out = {}
    for k, t in TEMPLATES.items():
        b = set(bigrams(normal_words(t)))
        near = lambda some, b=b: max((2 * len(g & b) / (len(g) + len(b)) for g in some), default=0)
        d, alone = near(sets), near(units)
        if d >= THRESHOLD - 1e-12 and d > alone + 1e-12:
            out[k] = d
    return out


def test_wrapped_passages_within_longer_texts(spark):
    code = "\n".join(f"value_{i} = compute(value_{i - 1}, {i})" for i in range(25))
    wrap = lambda t, mark: "\n".join(mark + x for x in textwrap.wrap(t, 60))
    keys = [k for k, t in TEMPLATES.items() if len(t) > 120]
    texts = [f"#!/bin/sh\n#\n{wrap(TEMPLATES[k], '# ')}\n\n{code}" for k in keys]
    r = random.Random(5)
    pool = [w for t in TEMPLATES.values() for w in wrap(t, "").split("\n")]
    texts += ["\n".join(r.choice([*pool, "", "of the", "word"]) for _ in range(r.randint(2, 14))) for _ in range(60)]
    texts += ["released under\nthe mit license\n" * 8, "\nall rights\n\nreserved\nother words of text\nand more"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in scan(frame).collect()}
    assert {"MIT-text", "GPL-3.0-header", "BSD"} <= set(keys)
    assert all(got[d].license in (k, "Apache-2.0") and got[d].dice >= 0.8 for d, k in enumerate(keys))
    for d, text in enumerate(texts):
        runs, (_, near, _, n) = brute_passages(text), brute(text)
        assert got[d].n_matches == n + len(runs)
        assert abs((got[d].dice or 0) - max([near or 0, *runs.values()])) < 1e-9
        assert (got[d].scope == "lines") == (max(runs.values(), default=0) > (near or 0))


FULL = {
    "MIT-license": "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + "\n\n".join(textwrap.fill(x, 78) for x in re.split(r"(?<=conditions:) |(?<=portions of the Software\\.) ", TEMPLATES["MIT-license"])),
    "BSD-2-Clause": "Copyright 2019 Some People. All rights reserved.\n\n" + textwrap.fill(TEMPLATES["BSD-2-Clause"], 72),
    "Apache-2.0-notice": "\n".join("// " + x for x in ["Copyright 2021 The Authors", "", *textwrap.wrap(TEMPLATES["Apache-2.0-notice"], 70)]) + "\n\npackage main\n\nimport fmt\n\nfunc main() { fmt.Println(1) }\n",
    "GPL-2.0-header": "/*\n" + "\n".join(" * " + x for x in textwrap.wrap(TEMPLATES["GPL-2.0-header"], 66)) + "\n */\nint main(void)\n{\n    return 0;\n}\n",
}


def test_whole_licences_wrapped_in_files_are_found_as_by_the_sql(spark, tmp_path):
    code = "\n".join(f"value_{i} = compute(value_{i - 1}, {i})" for i in range(25))
    texts = [*FULL.values(), *[f"{x}\n{code}" for x in FULL.values()], code, "All rights reserved.\nplain words of text", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_license_dice(spark, str(tmp_path)).collect()}
    for d, k in enumerate([*FULL, *FULL]):
        assert got[d].license.split("-")[0] == k.split("-")[0] and got[d].dice >= 0.8, (k, got[d])
    assert got[len([*FULL, *FULL])].license is None
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    show = lambda r: (r[0], r[1], None if r[2] is None else round(r[2], 9), r[3], r[4])
    want = db.execute(f"SELECT doc_id, license, dice, scope, n_matches FROM ({queries.ORACLE['op5_license_dice']})").fetchall()
    assert sorted(map(show, want)) == sorted(show(tuple(r)) for r in got.values())
