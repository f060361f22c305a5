import random

from ledgerlark.llm.licenses import CUES, TEMPLATES, Scanner, scan_licenses, words_of

PROSE = "Anblewh sttible athawh thonre was is anly hend and, oftionnten.\nEnti a wherer, anhe ntedin thhe."


def test_every_template_is_found():
    s = Scanner()
    for name, wordings in TEMPLATES.items():
        for w in wordings:
            hits = s.scan(f"{PROSE}\n{w}\n{PROSE}")
            assert [h[2] for h in hits] == [name], (name, w, hits)
            hit = hits[0]
            assert f"{PROSE}\n{w}\n{PROSE}"[hit[0] : hit[0] + hit[1]] == w and hit[4] == hit[5] == ""


def test_wrapped_inside_prose_and_near_misses():
    s = Scanner()
    long = TEMPLATES["Apache-2.0"][1]
    lines = "\n".join(long[i : i + 70] for i in range(0, len(long), 70))
    assert [h[2] for h in s.scan(f"{PROSE}\n{TEMPLATES['MIT'][2].replace('free of charge, to', 'free of charge to')}\n")] == ["MIT"]
    assert "Apache-2.0" in [h[2] for h in s.scan(" ".join(long.split()).replace(". ", ".\n"))]
    assert [h[2] for h in s.scan(f"{PROSE} Licensed under CC BY-NC 4.0. {PROSE}")] == ["CC-BY-NC-4.0"]
    assert [h[2] for h in s.scan("Licensed under CC BY 4.0.\nRest.\nReleased under the MIT License.")] == ["CC-BY-4.0", "MIT"]
    for text in ("Licensed under CC BY 3.0.", "Licensed under the Apache License, Version 1.0.", "The license plate was lost.", "copyright", "", "permission is hereby refused", "No rights reserved."):
        assert s.scan(text) == [], text
    assert len(lines) > 100


def test_frames(spark):
    rows = [(1, f"{PROSE}\nLicensed under CC BY-NC 4.0.", "x"), (2, None, "x"), (None, "All rights reserved.", "x"), (3, PROSE, "x"), (1, f"{PROSE}\nLicensed under CC BY-NC 4.0.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted([(r.doc_id or 0, r.start, r.license) for r in scan_licenses(docs).collect()])
    assert got == [(0, 0, "All-rights-reserved"), (1, len(PROSE) + 1, "CC-BY-NC-4.0"), (1, len(PROSE) + 1, "CC-BY-NC-4.0")]
    assert scan_licenses(docs.limit(0)).count() == 0
    long = "w " * 400000 + "Released under the MIT License. " + "w " * 1000
    assert [r.license for r in scan_licenses(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()] == ["MIT"]


def brute(text):
    """Licenses whose wording stands in a text word for word, the longest first at each place, and where."""
    words = words_of(text)
    found = []
    for i in range(len(words)):
        fits = [(len(t), name) for name, ws in TEMPLATES.items() for t in map(words_of, ws) if words[i : i + len(t)] == t]
        if fits:
            found.append((i, *max(fits)))
    return [n for k, (i, _, n) in enumerate(found) if not any(a <= i < a + m for a, m, _ in found[:k])]


def test_every_template_anywhere_against_brute_force():
    """At any offset, several to a sentence, on one long line or wrapped as a comment."""
    rng, s = random.Random(12), Scanner()
    noise = [*PROSE.replace("\n", " ").split(), "license", "of", "the", "software", "copyright", "permission", "in", "and"]
    every = [(n, w) for n, ws in TEMPLATES.items() for w in ws]
    for name, w in every:
        for _ in range(4):
            parts, want = [], []
            for n, v in [(name, w), *rng.sample(every, rng.randrange(3))]:
                parts += [" ".join(rng.choice(noise) for _ in range(rng.randrange(40))) + " zzz", v.rstrip(".: ") + ","]
                want.append(n)
            text = " ".join(parts) + " zzz " + " ".join(rng.choice(noise) for _ in range(rng.randrange(300)))
            if rng.random() < 0.5:
                text = text.replace(" zzz ", " zzz\n# ").replace(" of ", " of\n# ")
            assert [h[2] for h in s.scan(text)] == want == brute(text), (name, w)


def test_numbered_and_edited_notices():
    rng, s = random.Random(13), Scanner()
    for name, ws in TEMPLATES.items():
        long = max(ws, key=len)
        words = long.split()
        if len(words) < 40:
            continue
        for _ in range(5):
            edited = list(words)
            for _ in range(len(words) // 25):  # words without digits go, others come in
                i = rng.randrange(len(edited))
                if not any(c.isdigit() for c in edited[i]):
                    edited[i] = rng.choice(["", "zzz", edited[i] + " qqq"])
            hits = s.scan("of the software in any " * 9 + " ".join(edited) + " and the of in any" * 9)
            assert name in [h[2] for h in hits], (name, hits)
    bsd = TEMPLATES["BSD-2-Clause"][1].replace("Redistributions of", "\n  1. Redistributions of").replace("Redistributions in", "\n  2. Redistributions in")
    assert [h[2] for h in s.scan(bsd)] == ["BSD-2-Clause"]
    assert [h[2] for h in s.scan("Released under the MIT License, and Licensed under CC BY 4.0, by us. SPDX-License-Identifier: Zlib")] == ["MIT", "CC-BY-4.0", "Zlib"]


def test_every_template_has_a_cue():
    assert all(any(c in w.lower() for c in CUES) for ws in TEMPLATES.values() for w in ws)


def test_short_forms_titles_and_expressions():
    s = Scanner()
    names = lambda text: [h[2] for h in s.scan(f"{PROSE}\n{text}\n{PROSE}")]
    for text, want in {
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": ["GPL-3.0"], "Apache License Version 2.0, January 2004": ["Apache-2.0"], "Mozilla Public License Version 2.0": ["MPL-2.0"],
        "The MIT License (MIT)": ["MIT"], "Distributed under the MIT license.": ["MIT"], "Licensed under the Apache License 2.0": ["Apache-2.0"],
        "SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0"], "SPDX-License-Identifier: LGPL-3.0-only": ["LGPL-3.0"],
        "Licensed under the GNU Lesser General Public License, version 3": ["LGPL-3.0"], "SPDX-License-Identifier: Apache-2.0 OR MIT": ["Apache-2.0", "MIT"],
        "SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-2.0-only WITH Classpath-exception-2.0 and Zlib": ["MIT", "BSD-3-Clause", "GPL-2.0", "Zlib"],
        "SPDX-License-Identifier: Unknown-1.0 OR MIT": ["MIT"], "SPDX-License-Identifier: MIT or later": ["MIT"],
    }.items():
        assert names(text) == want, (text, names(text))
    text = "SPDX-License-Identifier: Apache-2.0 OR MIT"
    assert [text[h[0] : h[0] + h[1]] for h in s.scan(text)] == ["SPDX-License-Identifier: Apache-2.0", "MIT"]


def test_saved_bytes_decide_between_confirmed_wordings():
    """The notice of one license is confirmed for its siblings too, as they differ by one word of forty."""
    s = Scanner()
    k = {n: next(i for i, (m, ws, _) in enumerate(s.templates) if m == n and len(ws) > 30) for n in ("GPL-3.0", "LGPL-3.0", "AGPL-3.0")}
    for name, mine in k.items():
        words = s.templates[mine][1]
        assert all(s.confirm(s.templates[other][1], words) for other in k.values())
        assert [h[2] for h in s.scan(f"{PROSE} {' '.join(words)} {PROSE}")] == [name]
