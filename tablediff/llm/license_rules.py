"""Ordered signature rules for licences, on texts reduced to lower-case words with one space between them.

Each licence has a label, a keyword that stands in every text that one of its rules can match, and a pattern for its
name. The rules are the licence's name in each form of FORMS, in the order of their priority; its identifier in the forms
that only a licence stands in; and sentences of its own text.
"""

from __future__ import annotations

# Label, keyword, pattern of the name.
LICENSES = [
    ("mit", "mit", r"(?:the )?mit(?: x11)? licen[sc]e"),
    ("mit", "expat", r"(?:the )?expat licen[sc]e"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("apache-1.0", "apache", r"apache (?:software )?licen[sc]e(?: version)? 1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e(?: version)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?"),
    ("0bsd", "bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("gpl-1.0", "g", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? ?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "g", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2(?: or later)?"),
    ("gpl-3.0", "g", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3(?: or later)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("gpl", "gnu gpl", r"gnu gpl"),
    ("lgpl-2.0", "l", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)(?: version| v)? ?2(?: 0)?"),
    ("lgpl-2.1", "l", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)(?: version| v)? ?2 1(?: or later)?"),
    ("lgpl-3.0", "l", r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version| v)? ?3(?: 0)?(?: or later)?"),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", "library general public", r"(?:gnu )?library general public licen[sc]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl-3.0", "a", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: version| v)? ?3(?: 0)?(?: or later)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e(?: version)?(?: 1 [123])?"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("mpl-2.0", "mpl", r"mpl(?: version| v)? ?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("cddl", "common development", r"common development and distribution licen[sc]e(?: version)?(?: 1 [01])?"),
    ("cpl-1.0", "common public", r"common public licen[sc]e(?: version)?(?: 1 0)?"),
    ("eupl", "european union public", r"european union public licen[sc]e(?: version| v)?(?: 1 [012])?"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e(?: version)? 1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: version)? 2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: version)?(?: 1 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?"),
    ("psf-2.0", "python", r"python software foundation licen[sc]e(?: version 2)?"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("php-3.01", "php", r"php licen[sc]e(?: version)?(?: 3 01?)?"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: version)?(?: 1 [01])?"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e"),
    ("osl-3.0", "open software", r"open software licen[sc]e(?: version)?(?: 3 0)?"),
    ("afl-3.0", "academic free", r"academic free licen[sc]e(?: version)?(?: 3 0)?"),
    ("odbl-1.0", "open database", r"(?:odc )?open database licen[sc]e(?: version)?(?: 1 0)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons zero", r"creative commons zero(?: 1 0)?"),
    ("public-domain", "public domain", r"(?:dedicated to|in|into) the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary (?:software|licen[sc]e)"),
]

# The parts of a Creative Commons licence: label, short and long words.
CC_PARTS = [
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
]
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Identifiers that are no names by themselves: label, first word, the rest of the pattern.
IDENTIFIERS = [
    ("mit", "mit", ""),
    ("mit-0", "mit", " 0"),
    ("x11", "x11", ""),
    ("isc", "isc", ""),
    ("zlib", "zlib", ""),
    ("postgresql", "postgresql", ""),
    ("apache-1.0", "apache", " 1 0"),
    ("apache-1.1", "apache", " 1 1"),
    ("apache", "apache", ""),
    ("bsd", "bsd", ""),
    ("gpl", "gpl", ""),
    ("agpl", "agpl", ""),
    ("gfdl", "gfdl", "(?: 1 [123])?(?: only| or later)?"),
    ("mpl-1.0", "mpl", " 1 0"),
    ("mpl-1.1", "mpl", " 1 1"),
    ("mpl", "mpl", ""),
    ("epl-1.0", "epl", " 1 0"),
    ("epl-2.0", "epl", " 2 0"),
    ("epl", "epl", ""),
    ("cddl", "cddl", "(?: 1 [01])?"),
    ("cpl-1.0", "cpl", " 1 0"),
    ("eupl", "eupl", "(?: 1 [012])?"),
    ("artistic-1.0", "artistic", " 1 0"),
    ("artistic-2.0", "artistic", " 2 0"),
    ("bsl-1.0", "bsl", " 1 0"),
    ("psf-2.0", "psf", " 2 0"),
    ("psf-2.0", "python", " 2 0"),
    ("openssl", "openssl", ""),
    ("php-3.01", "php", " 3 01?"),
    ("ruby", "ruby", ""),
    ("ofl-1.1", "ofl", " 1 [01]"),
    ("ms-pl", "ms", " pl"),
    ("ms-rl", "ms", " rl"),
    ("osl-3.0", "osl", " 3 0"),
    ("afl-3.0", "afl", " 3 0"),
    ("odbl-1.0", "odbl", " 1 0"),
]

# Sentences of the licences' own texts: label, keyword, pattern.
AS_IS = "software is provided as is"
TEXTS = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "shall the authors", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("bsl-1.0", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1.0", "anyone distributing", r"in no event shall the copyright holders or anyone distributing the software be liable"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "express or implied warranties", r"this software is provided by (?:\S+ ){1,12}?as is and any express or implied warranties"),
    ("bsd-3-clause", "neither the name", r"neither the names? of (?:\S+ ){1,16}?(?:nor|or) the names of (?:its|their|any|the) ?contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("isc", "for any purpose with or without fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "for any purpose with or without fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("isc", AS_IS, r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("zlib", AS_IS, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("postgresql", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to"),
    ("apache-2.0", "shall mean the terms", r"licen[sc]e shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9"),
]
TEXT_PRIORITY, TEXT_CONFIDENCE = 2, 0.9

# Priority, the form around a name, and what the form adds to the detection's confidence.
FORMS = [
    (1, r"spdx licen[sc]e identifier {name}", 1.0),
    (2, r"(?:licen[sc]ed|released|distributed|available|published|provided|covered)(?: \S+){{0,3}}? under (?:the |a )?(?:terms of (?:the )?)?{name}", 0.95),
    (3, r"(?:see|read|under|subject to|accompanying) (?:the )?{name}", 0.8),
    (4, r"{name}", 0.6),
]


def _names() -> list[tuple[str, str, str]]:
    names = list(LICENSES)
    for label, short, long in CC_PARTS:
        for version in CC_VERSIONS:
            number = version.replace(".", " ")
            names.append((f"cc-{label}-{version}", f"cc {short[:2]}", rf"(?:creative commons |cc )?cc {short} {number}"))
            names.append((f"cc-{label}-{version}", "creative commons", rf"creative commons {long}(?: version)? {number}"))
        names.append((f"cc-{label}", f"cc {short[:2]}", rf"cc {short}(?= (?:licen[sc]e|$))"))
        names.append((f"cc-{label}", "creative commons", rf"creative commons {long}(?! (?:version )?\d)"))
    return names


def rules() -> list[tuple[str, str, int, float, str]]:
    """(keyword, label, priority, confidence, pattern) of every rule; patterns start and end at a word's edge."""
    edged = lambda pattern: "(?<= )" + pattern + "(?= )"
    named = [
        (keyword, label, priority, confidence, edged(form.format(name=f"(?:{name})")))
        for priority, form, confidence in FORMS
        for label, keyword, name in _names()
    ]
    identified = [
        (f" {word} ", label, priority, confidence, edged(form.format(name=f"(?:{word}{rest})")))
        for priority, form, confidence in FORMS[:2]
        for label, word, rest in IDENTIFIERS
    ]
    own = [(keyword, label, TEXT_PRIORITY, TEXT_CONFIDENCE, edged(pattern)) for label, keyword, pattern in TEXTS]
    return named + identified + own
