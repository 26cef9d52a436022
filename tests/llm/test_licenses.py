import random
import re

from glyphgrid.llm import licenses

SENTENCES = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-2.0-or-later",
    "CC\n BY-SA  4.0", "see https://www.gnu.org/licenses/lgpl-2.1.html", "BSD 3-Clause License", "dual-licensed", "All rights reserved",
    "the GNU General Public License version 2 or (at your option) any later version", "Creative Commons Attribution-ShareAlike 4.0 International License",
    "licensed under the Foo License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "public domain", "MIT", "cc by",
]


def brute(text, rules):
    """All rules without the prefilter; a detection is compared with all others."""
    found = [(m.start(), m.end(), r.number, r.priority) for r in rules for m in r.regex.finditer(text)]
    stands = []
    for level in (3, 2, 1):
        higher = list(stands)
        free = [f for f in found if f[3] == level and not any(f[0] < h[1] and h[0] < f[1] for h in higher)]
        for f in free:
            inside = [g for g in free if g is not f and g[0] <= f[0] and f[1] <= g[1] and (g[:2] != f[:2] or g[2] < f[2])]
            if not inside:
                stands.append(f)
    return sorted(f[:3] for f in stands)


def test_scan_matches_all_rules_on_mixed_texts():
    scanner, rng = licenses.Scanner(), random.Random(4)
    for _ in range(150):
        parts = [rng.choice(SENTENCES) if rng.random() < 0.6 else rng.choice(["foo bar", "the license", "K ſ İ", "CC", "version 2.0", "or later"]) for _ in range(rng.randrange(1, 8))]
        text = rng.choice([" ", "\n", ". ", "  "]).join(parts)
        text = rng.choice([str, str.upper, str.lower])(text)
        assert scanner.scan(text) == brute(text, scanner.rules)


def test_there_are_hundreds_of_rules_and_each_gate_is_a_literal_of_its_pattern():
    rules = licenses.parse()
    assert len(rules) > 200 and len({(r.license, r.pattern) for r in rules}) == len(rules)
    for r in rules:
        p, before = r.pattern, None
        while p != before:
            before = p
            p = re.sub(r"\(\?[:!][^()]*\)\?", "", p)
            p = re.sub(r"\(\?!(?:[^()]|\([^()]*\))*\)", "", p)
        plain = p.replace("[- ]", " ").replace("\\b", "").replace("\\.", ".").replace("-", " ").replace("\\(", "(").replace("\\)", ")")
        assert r.keyword in plain, r


def test_known_sentences():
    s = licenses.Scanner()
    name = lambda t: [s.rules[n].license for *_, n in s.scan(t)]
    assert name(SENTENCES[0]) == ["Apache-2.0"] and name(SENTENCES[1]) == ["MIT"]
    assert name(SENTENCES[2]) == ["CC-BY-NC-4.0"] and name(SENTENCES[3]) == ["GPL-3.0"]
    assert name("with love from Smith, no licence") == []


def test_edges(edge, empty):
    rows = licenses.scan(edge).collect()
    assert [(r["doc_id"], r["license"], r["match"]) for r in rows] == [(10, "MIT", "Licensed under the MIT License")]
    text = edge.where("doc_id = 10 AND text LIKE '%MIT%'").first()["text"]
    assert text[rows[0]["start"] : rows[0]["end"]] == rows[0]["match"]
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(edge.unionByName(edge)).count() == 2


def test_very_long_text_is_scanned_whole():
    text = ("word " * 400_000) + SENTENCES[1]
    assert len(licenses.Scanner().scan(text)) == 1


def test_standard_gnu_notices_keep_version_and_or_later():
    s = licenses.Scanner()
    strong = lambda t: [s.rules[n].license for *_, n in s.scan(t) if s.rules[n].priority == 3]
    head = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation"
    names = {"General Public License": ("GPL", ("2", "3")), "Lesser General Public License": ("LGPL", ("2.1", "3")), "Library General Public License": ("LGPL", ("2",)), "Affero General Public License": ("AGPL", ("3",))}
    for name, (family, versions) in names.items():
        for v in versions:
            full = f"{family}-{v if '.' in v else v + '.0'}"
            for gap in ("; either ", ", either ", ";\neither "):
                for tail in (" of the License, or\n(at your option) any later version.", " of the License, or (at your option) any\nlater version.", ", or (at your option) any later version.", " or later."):
                    assert strong(head.format(name) + f"{gap}version {v}{tail}") == [full + "-or-later"], (name, v, gap, tail)
            for gap in ("; ", ", "):
                assert strong(head.format(name) + f"{gap}version {v} of the License.") == [full]
            assert strong(f"under the terms of the GNU {name} version {v}, or the Foo License") == [full]
    for text, want in (("LGPL-2.1+", "LGPL-2.1-or-later"), ("LGPLv3", "LGPL-3.0"), ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0-or-later"), ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"), ("licensed under the GNU General Public License version 3.0 or later", "GPL-3.0-or-later")):
        assert strong(text) == [want], text


def test_bsd_sentence_and_unclear_mention_run_to_their_end():
    s = licenses.Scanner()
    name = lambda t: [s.rules[n].license for *_, n in s.scan(t)]
    tail = "nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
    for holder in ("the copyright holder", "Foo, Inc.", "J. Random Hacker", "the\n   University of California, Berkeley", "the Very Long Named Institute " * 8):
        assert name(f"3. Neither the name of {holder} {tail}") == ["BSD-3-Clause"], holder
    assert name(f"Neither the name of the rose.\n\nNeither the name of the copyright holder {tail}") == ["BSD-3-Clause"]
    assert name("Neither the name of the rose.\n\nIt may be used to endorse or promote products.") == []
    for middle in ("the Foo\nBar", "the Foo v2.0", "a rather long and winding name " * 6 + "of a"):
        assert name(f"licensed under {middle} license") == ["Unclear"], middle
    assert name("licensed under something. A license") == [] and name("licensed under something\n\nThe Foo license") == []
    # no quadratic cost where sentences never end
    assert name("licensed under neither the name of x " * 20_000) == []
