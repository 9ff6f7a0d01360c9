import re

import pytest

from fleetlens.llm import license_scan as S
from fleetlens.llm.queries import QUERIES

from .helpers import DOCS, SF, clashing, frame, lower, small_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORD.findall(lower(text))
    places = [(i, label) for p, label in S.PHRASES.items() for i in range(len(w)) if w[i: i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_query_and_edge_cases(spark):
    rows = list(zip(small_docs().doc_id.tolist(), small_docs().text.tolist()))
    for got, want in ((QUERIES["op7_license_scan"](spark, SF), rows), (S.scan_licenses(clashing(spark, DOCS)), DOCS)):
        got = got.collect()
        assert sorted((str(r.doc_id), str((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in got) == \
            sorted((str(d), str(base(t))) for d, t in want)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


CASES = [("Licensed under the Apache License, Version 2.0.", "apache-2"), ("licensed under the apache license 2", "apache-2"),
         ("licensed under the apache licence 2", ""), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
         ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
         ("under the terms of the gnu general public license as published by the free software foundation version 3", "gpl-3"),
         ("under the terms the gnu general public license version 3", ""),
         ("under the gnu general public license a b c d e f g h version 3", "gpl-3"),
         ("under the gnu general public license a b c d e f g h i version 3", ""),
         ("under the terms of the MIT license", "mit"), ("ALL rights\nreserved", "all-rights-reserved"), ("all rights", "")]


def test_templates(spark):
    got = {r.doc_id: r for r in S.scan_licenses(frame(spark, [(i, t) for i, (t, _) in enumerate(CASES)])).collect()}
    for i, (text, label) in enumerate(CASES):
        assert got[i].labels == label, text
        assert (got[i].score == 1.0) == bool(label)
    assert 0 < got[2].score < 1 and 0 < got[11].score < 1


def test_whole_licences(spark):
    """The licences as they are printed, with names filled in, wrapped and commented; a changed word is no match."""
    fill = lambda t: re.sub(r"<<any \d+ \d+>>", "the Acme Authors", re.sub(r"<<like [^>]*>>", "2024", re.sub(r"<</?optional>>", "", t)))
    wrap = lambda t: "/*\n * " + "\n * ".join(t[i: i + 70] for i in range(0, len(t), 70)) + "\n */"
    names = ["mit", "isc", "bsd-2-clause", "bsd-3-clause", "zlib"]
    rows, want = [], {}
    for name in names:
        text = fill(S.TEMPLATES[name][-1])
        for k, t in enumerate((text, "Copyright (c) 2024 Acme\n\n" + text.replace(". ", ".\n\n") + "\n\nint main;", text.upper(), text.rsplit(" ", 3)[0],
                               text.replace("software", "hardware").replace("SOFTWARE", "HARDWARE"))):
            rows.append((len(rows), t))
            want[len(rows) - 1] = (name in ("mit", "isc", "bsd-2-clause", "bsd-3-clause", "zlib") and k < 3, name)
    got = {r.doc_id: r for r in S.scan_licenses(frame(spark, rows)).collect()}
    for i, (yes, name) in want.items():
        assert (name in got[i].labels.split(",")) == yes, (name, i)
        assert got[i].score == 1.0 if yes else got[i].score > 0
    three = rows[15][1]
    assert got[15].labels == "bsd,bsd-3-clause" and "Neither the name" in three
    assert wrap("x")


def test_fields_with_patterns():
    a = S.compile_template("x", "All rights <<optional>>since <<like (19|20)[0-9]{2}>><</optional>> reserved")
    ok = ["all rights reserved", "all rights since 1999 reserved"]
    no = ["all rights since 99 reserved", "all rights since x1999 reserved", "all rights since reserved"]
    assert [a.run(t.split(), 0) == 1 for t in ok + no] == [True] * 2 + [False] * 3
    with pytest.raises(ValueError):
        S.compile_template("x", "a <<like b>> c")


def test_long_templates_compile_in_linear_time():
    import time

    spent = []
    for n in (2000, 20_000):
        t = time.process_time()
        a = S.compile_template("x", " ".join(f"w{i} <<optional>>v{i}<</optional>>" for i in range(n)))
        spent.append(time.process_time() - t)
        assert a.left[0] == n
    assert spent[1] < 40 * max(spent[0], 0.05)


def test_markup():
    a = S.compile_template("x", "a b <<optional>>c <<any 1 2>><</optional>> d")
    ok = ["a b d", "a b c z d", "a b c z z d"]
    no = ["a b c d", "a b c z z z d", "a b", "a d"]
    assert [a.run(t.split(), 0) == 1 for t in ok + no] == [True] * 3 + [False] * 4
    with pytest.raises(ValueError):
        S.compile_template("x", "<<any 0 3>> a b")
    with pytest.raises(ValueError):
        S.compile_template("x", "a b <<optional>> c")


def test_empty(spark):
    assert S.scan_licenses(frame(spark, [])).count() == 0
