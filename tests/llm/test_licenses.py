import re
import textwrap
from collections import Counter
from math import log, sqrt

from rankloom.llm import licenses as ls
from rankloom.llm.licence_templates import NOTICES, TEXTS, TITLES

APACHE = "Licensed under the Apache License, Version 2.0."
FILES = [
    ("LICENSE", "Released under the MIT License.\n" + "filler words go here and on " * 9), ("a/x.py", "code"), ("a/b/LICENSE.txt", APACHE + "\nmore text\n"), ("a/b/c/d/y.py", None),
    ("a/b/z.py", "# Licensed under CC BY-NC 4.0.\ncode of some kind, and more of it in this file than its notices have words\nAll rights reserved."), ("a/q/readme", "This work is licensed under the GNU General Public License, version 3."),
    ("a/q/w.py", ""), (None, APACHE + " " + "word " * 30), (None, "x"), ("e/f.py", "the license of the version"), ("e/f.py", "the license of the version"), ("/a/b/lead.py", "word " * 30000),
]


WRAPPED = "/*\n * Copyright 2020 Some One\n *\n * Licensed under the Apache License, Version 2.0\n * (the \"License\"); you may not use this file\n * except in compliance with the License.\n */\nint main;\n"
FILES += [
    ("h/a.c", WRAPPED), ("h/b.py", "\n".join("# " + x for x in textwrap.wrap(TEXTS["GPL-3.0"][0], 40)) + "\nimport os\n\nthe rest of it"), ("h/c.md", "intro\n\nThis work is licensed under a Creative Commons Attribution-\nNonCommercial 4.0\nInternational License.\n\nend of it"),
    ("i/LICENSE", "Copyright (c) 2001 A B\n\n" + textwrap.fill(TEXTS["BSD-2-Clause"][0], 70)), ("i/x/y.c", "int x;"), ("j/COPYING", "   GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + "whatever the terms say here\n" * 300), ("j/z.c", "int z;"),
    ("k/LICENSE.md", textwrap.fill(TEXTS["MIT"][0], 60).replace("\n", "\r\n")), ("m/only.sh", "#\n# Released under the MIT License.\n# Licensed under the Apache License, Version 2.0."), ("m/LICENSE", ""), ("n/p.py", "#" * 50000 + "\n" * 50000 + "x"),
]
SETS = {"line": [NOTICES], "paragraph": [NOTICES], "licence paragraph": [NOTICES, TITLES], "header": [NOTICES, TEXTS], "file": [TEXTS]}


def words(x):
    return re.findall(r"[^\W_]+(?:\.[0-9]+)*", x.lower())


def slow(files):
    """Licences of each file by loops over its lines, paragraphs, header and whole text."""
    lines = [words(x) for _, t in files for x in (t or "").split("\n")]
    lines = [x for x in lines if x]
    df = Counter(t for w in lines for t in set(w))
    vec = lambda w: {t: (1 + log(n)) * (log((1 + len(lines)) / (1 + df[t])) + 1) for t, n in Counter(w).items()}
    size = lambda v: sqrt(sum(x * x for x in v.values()))

    def closest(w, kind):
        v, met = vec(w), []
        for own in SETS[kind]:
            for name, texts in own.items():
                for u in map(vec, map(words, texts)):
                    c = sum(v.get(t, 0) * x for t, x in u.items()) / (size(v) * size(u)) if v else 0
                    met += [(-round(c, 12), name)] if c >= 0.7 else []
        return (-min(met)[0], {min(met)[1]}) if met else (0, set())

    def wider(whole, parts):
        best = max((s for s, _ in parts), default=0)
        return whole if whole[0] and (whole[0] >= 0.9 or whole[0] >= best) else (best, set().union(*(n for _, n in parts)))

    def paragraphs(rows, named):
        out, group = [], []
        for x in [*rows, ""]:
            if words(x):
                group.append(x)
            elif group:
                one = closest(words(" ".join(group)), "licence paragraph" if named else "paragraph") if named or len(group) > 1 else (0, set())
                out.append(wider(one, [closest(words(y), "line") for y in group]))
                group = []
        return out

    got = []
    for path, text in files:
        named = bool(path and re.search(r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$", path))
        rows, n = (text or "").split("\n"), 0
        comment = lambda x: re.match(r"\s*(?:#|//|/\*|\*|--|;|%|<!--)", x)
        if comment(text or ""):
            n = next((i for i, x in enumerate(rows) if words(x) and not comment(x)), len(rows))
        head = wider(closest(words(" ".join(rows[:n])), "header"), paragraphs(rows[:n], named))
        file = closest(words(text or ""), "file") if named else (0, set())
        got.append(sorted(wider(file, [head, *paragraphs(rows[n:], named)])[1]))
    return got


def test_against_brute_force(spark):
    files = spark.createDataFrame(FILES, "path string, text string").selectExpr("*", "1 as line", "2 as own")
    got = ls.licences(files).collect()
    want = slow(FILES)
    assert sorted(map(str, ((r.path, r.own) for r in got))) == sorted(map(str, ((p, w) for (p, _), w in zip(FILES, want))))
    by = {r.path: r for r in got}
    assert by["a/x.py"].inherited == ["MIT"] and by["a/x.py"].inherited_from == ""
    assert by["a/b/c/d/y.py"].inherited == by["/a/b/lead.py"].inherited == ["Apache-2.0"] and by["a/b/c/d/y.py"].inherited_from == "a/b"
    assert by["a/b/z.py"].own == ["CC-BY-NC-4.0", "Proprietary"] and by["a/b/z.py"].inherited is None
    assert by["a/q/w.py"].inherited == ["GPL-3.0"] and by["a/q/readme"].is_licence_file
    assert by["h/a.c"].own == ["Apache-2.0"] and by["h/b.py"].own == ["GPL-3.0"] and by["h/c.md"].own == ["CC-BY-NC-4.0"]
    assert by["i/LICENSE"].own == ["BSD-2-Clause"] and by["i/x/y.c"].inherited == ["BSD-2-Clause"]
    assert by["j/COPYING"].own == ["GPL-3.0"] and by["j/z.c"].inherited_from == "j" and by["k/LICENSE.md"].own == ["MIT"]
    assert by["m/only.sh"].own == ["Apache-2.0", "MIT"] and by["m/only.sh"].is_licence_file and by["m/LICENSE"].inherited == ["Apache-2.0", "MIT"]
    assert ls.licences(files.limit(0)).count() == 0


def test_ordinary_words_weigh_the_same_in_a_larger_corpus(spark):
    notice = "This whole software project is released under the MIT License."
    for times in (1, 60):
        rows = [(f"p/{i}", notice if i % 1000 == 0 else f"software project whole this is u{i} under" if i % 20 == 0 else f"this is u{i} under v{i}") for i in range(1000 * times)]
        found = ls.licences(spark.createDataFrame(rows, "path string, text string")).where("size(own) > 0").collect()
        assert len(found) == times and all(r.own == ["MIT"] for r in found)
