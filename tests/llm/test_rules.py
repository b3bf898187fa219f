import collections
import hashlib
import random
import re

from rows import DDL, empty, frame, rows, words

from tablediff.llm.licenses import COLUMNS as LICENSE_COLUMNS
from tablediff.llm.licenses import license_scan
from tablediff.llm.pii import KINDS, find_pii, sanitise, with_digest
from tablediff.llm.quality import MEASURES, measure, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    t = text or ""
    w = WORD.findall(t)
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in t)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), symbols, repeated, len(covered), failed


def test_measures_equal_brute_force(spark):
    rng = random.Random(21)
    more = ["a\nb\na\n \n\na", "x " * 30, " ".join(rng.choice("ab") for _ in range(200)), "#$ %& | <b>", "a\x0bb\x0cc\rd\x85e"]
    more = [(900 + i, t, "en", "a", 0, "", "") for i, t in enumerate(more)]
    given = [*rows(), *more]
    out = measure(spark.createDataFrame(given, DDL)).collect()
    got = collections.Counter((r["doc_id"], *(r[m] for m in MEASURES), r["score"]) for r in out)
    assert got == collections.Counter((r[0], *brute_measures(r[1]), r[5]) for r in given)


def test_quality_keeps_prose_and_rejects_symbols(spark):
    rng = random.Random(22)
    clean = [(2000 + i, words(rng, rng.randint(30, 200)), "en", f"s{i % 3}", 0, "", "") for i in range(400)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in words(rng, 80).split()), "en", "s0", 0, "", "") for i in range(20)]
    docs = spark.createDataFrame([*clean, *junk, *rows()], DDL)
    out = quality_rules(docs)
    assert out.columns == [*[c for c in docs.columns if c != "kept"], *MEASURES, "distance", "kept"]
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in junk)
    assert not kept[5] and not kept[6] and not kept[11]  # null, empty, repeating
    assert quality_rules(empty(spark)).count() == 0


def test_quality_of_a_shuffled_table_is_the_same(spark):
    rng = random.Random(23)
    given = [(i, words(rng, rng.randint(10, 90)) + " #" * rng.randint(0, 9), "en", "s", 0, "", "") for i in range(300)]
    one = {r["doc_id"]: (r["kept"], r["distance"]) for r in quality_rules(spark.createDataFrame(given, DDL)).collect()}
    other = quality_rules(spark.createDataFrame(given[::-1], DDL).repartition(7)).collect()
    assert one == {r["doc_id"]: (r["kept"], r["distance"]) for r in other}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = (int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return sum(doubled) % 10 == 0


def brute_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits or "1"),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_patterned_spans_equal_brute_force(spark):
    rng = random.Random(24)
    pieces = ["a@b.c", "x.y+z@q-r.co.uk", "@", ".", "1.2.3.4", "256.1.1.1", "010.020.030.040", "4111 1111 1111 1111", "+1 (234) 567-8901", "+", "4111-1111-1111-1111", "%", " ", "é", "日", "1", "22 ", "a.b", "-", "\n"]
    given = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))), "en", "a", 0, "", "") for i in range(500)]
    given += [(900, "1." * 3000, "en", "a", 0, "", ""), (901, "a" * 50000 + "@", "en", "a", 0, "", ""), (902, "9 " * 20000, "en", "a", 0, "", "")]
    given += [(903, "1.2.3.4 " * 1300, "en", "a", 0, "", ""), *rows()]
    out = with_digest(find_pii(spark.createDataFrame(given, DDL).repartition(4))).collect()
    got = collections.Counter((r["doc_id"], ",".join(s for s in r["spans"].split(",") if s[:4] != "term"), r["base_sha256"]) for r in out)
    want = collections.Counter()
    for i, t, *_ in given:
        spans = brute_spans(t)
        want[i, spans, hashlib.sha256(spans.encode()).hexdigest()] += 1
    assert got == want
    assert sum(r["n_email"] for r in out) == sum(s.count("email:") for _, s, _ in want.elements())
    assert find_pii(empty(spark)).count() == 0


def test_disclosing_terms_are_found_and_generalised(spark):
    rng = random.Random(25)
    told = [(i, f"{words(rng, 20)} Blofeld writes from ernst@example.org {words(rng, 20)}", "en", "a", 0, "", "") for i in range(6)]
    plain = [(50 + i, words(rng, 30) + " writes from somewhere", "en", "a", 0, "", "") for i in range(60)]
    lone = [(200, "Blofeld was seen", "en", "a", 0, "", "")]
    found = find_pii(spark.createDataFrame([*told, *plain, *lone], DDL))
    clean = {r["doc_id"]: r["text"] for r in sanitise(found).collect()}
    assert all("Blofeld" not in clean[i] and "ernst" not in clean[i] for i in range(6))
    assert "[EMAIL]" in clean[0] and "[TERM] writes from [EMAIL]" in clean[0]
    assert clean[200] == "[TERM] was seen"
    assert all(clean[i] == t for i, t, *_ in plain)  # common words tell nothing


def test_sanitised_rows_keep_nulls_and_columns(spark):
    out = sanitise(find_pii(frame(spark)))
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[5] is None and texts[6] == "" and texts[7] == "one two three"
    assert texts[13] == "mail [EMAIL] or [IP], call [PHONE], pay [CARD]"


def brute_licenses(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    at, labels = [], set()
    for phrase, label in ((["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl")):
        for i in range(len(w) - len(phrase) + 1):
            if w[i : i + len(phrase)] == phrase:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_phrases_equal_brute_force_and_rules_add_labels(spark):
    texts = {
        800: ("Licensed under the GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"),
        801: ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        802: ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        803: ("MIT LICENSE mit license " * 700, "mit"),
        804: ("submit license", ""),
        805: ("all rights reserved", "proprietary"),
        806: ("apache-license ÉMIT license", "apache"),
    }
    given = [*rows(), *((i, t, "en", "a", 0, "", "") for i, (t, _) in texts.items())]
    out = license_scan(spark.createDataFrame(given, DDL).repartition(3))
    assert out.columns == [*[c for c in DDL_NAMES if c != "score"], *LICENSE_COLUMNS]
    collected = out.collect()
    got = collections.Counter((r["doc_id"], *(r[c] for c in LICENSE_COLUMNS[:5])) for r in collected)
    assert got == collections.Counter((r[0], *brute_licenses(r[1])) for r in given)
    by_id = {r["doc_id"]: r for r in collected}
    assert {i: by_id[i]["labels"] for i in texts} == {i: label for i, (_, label) in texts.items()}
    assert by_id[14]["labels"] == "apache,apache-2.0,mit"
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in collected)
    assert license_scan(empty(spark)).count() == 0


DDL_NAMES = [part.split()[0] for part in DDL.split(", ")]


def test_rules_hold_their_keyword_and_hint():
    from tablediff.llm.license_rules import rules

    assert len(rules()) > 300
    for keyword, _, _, _, pattern in rules():
        re.compile(pattern)
        assert keyword


def samples(rng, parsed):
    """A string that the parsed pattern is likely to match."""
    out = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "IN":
            kind, first = rng.choice(value)
            out += {"LITERAL": lambda: chr(first), "CATEGORY": lambda: "w", "RANGE": lambda: chr(first[0])}[str(kind)]()
        elif name == "BRANCH":
            out += samples(rng, rng.choice(value[1]))
        elif name == "SUBPATTERN":
            out += samples(rng, value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(samples(rng, value[2]) for _ in range(rng.randint(value[0], min(value[0] + 1, value[1]))))
        elif name == "ASSERT" and value[0] == 1:
            out += samples(rng, value[1])
    return out


def test_every_rule_is_reached_also_over_lines(spark):
    from re import _parser

    from tablediff.llm.license_rules import rules

    rng = random.Random(26)
    given, want = [], []
    for _, label, _, _, pattern in rules():
        made = {f"x {samples(rng, _parser.parse(pattern)).strip()} " for _ in range(4)}
        made = [m for m in sorted(made) if re.search(pattern, m)]
        assert made, pattern
        for m in made:
            given.append((len(given), m.strip().upper().replace(" ", rng.choice(["\n", "  ", "-", " \t* "])), "en", "a", 0, "", ""))
            want.append((label, pattern))
    out = license_scan(spark.createDataFrame(given, DDL).repartition(8)).select("doc_id", "labels", "score").collect()
    labels = {r["doc_id"]: r["labels"].split(",") for r in out}
    missed = [(given[i][1], want[i]) for i in labels if labels[i] == [""]]
    assert not missed, missed[:5]
    got = {pattern for i, (label, pattern) in enumerate(want) if label in labels[i]}
    assert {pattern for _, pattern in want} == got


def test_hints_are_words_of_the_reduced_text(spark):
    texts = ["public\ndomain", "All Rights\nReserved", "creative-commons  zero", "WTFPL", "MIT No\nAttribution"]
    given = [(i, f"dedicated to the {t}" if i == 0 else t, "en", "a", 0, "", "") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["labels"] for r in license_scan(spark.createDataFrame(given, DDL)).collect()}
    assert got == {0: "public-domain", 1: "proprietary", 2: "cc0-1.0", 3: "wtfpl", 4: "mit-0"}


def test_identifiers_and_own_texts_give_labels(spark):
    ids = {"MIT": "mit", "ISC": "isc", "Zlib": "zlib", "PostgreSQL": "postgresql", "EPL-2.0": "epl-2.0", "Artistic-2.0": "artistic-2.0"}
    ids |= {"EUPL-1.2": "eupl", "CDDL-1.0": "cddl", "OFL-1.1": "ofl-1.1", "BSL-1.0": "bsl-1.0", "MIT-0": "mit-0", "X11": "x11"}
    cases = [(form.format(i), label) for i, label in ids.items() for form in ("SPDX-License-Identifier: {}", "released under {}", "licensed under\nthe {}.")]
    cases += [
        ("Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files", "mit"),
        ("IN NO EVENT SHALL THE\n * AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY", "mit"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided", "bsd"),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the", "isc"),
        ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable", "zlib"),
        ("he is under MIT supervision", ""),
        ("permits under the limit", ""),
    ]
    given = [(i, t, "en", "a", 0, "", "") for i, (t, _) in enumerate(cases)]
    got = {r["doc_id"]: r["labels"] for r in license_scan(spark.createDataFrame(given, DDL)).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(cases)] == cases


def test_quality_rejects_junk_that_is_a_third_of_a_group(spark):
    rng = random.Random(27)
    clean = [(i, words(rng, rng.randint(60, 200)), "en", "s", 0, "", "") for i in range(400)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in words(rng, 80).split()), "en", "s", 0, "", "") for i in range(200)]
    out = quality_rules(spark.createDataFrame([*clean, *junk], DDL)).select("doc_id", "kept").collect()
    assert {r["doc_id"] for r in out if r["kept"]} == {i for i, *_ in clean}
