"""The signature rules of the licence scan: regular expressions over lower-case words, in order.

A rule is (label, priority, weight, keyword, expression). Its keyword is a plain substring that every match
contains; the expression is tried only on texts with the keyword. Expressions speak of words with one space
between them and match whole words only. Written by hand are the names, the frames and the signatures of texts
that carry no name; the rules on names are every name in every frame.
"""

from __future__ import annotations

# label -> how the licence is named, most exact first; ``#`` stands for the ways to write a version
NAMES = {
    "mit": ("mit licen[sc]e", "expat licen[sc]e", "mit x11 licen[sc]e"),
    "apache-2": ("apache(?: software)? licen[sc]e(?: version| v)? ?2(?: 0)?", "apache 2(?: 0)? licen[sc]e", "apache 2 0", "asl 2(?: 0)?"),
    "apache-1": ("apache(?: software)? licen[sc]e(?: version| v)? ?1(?: [01])?",),
    "gpl-3": ("gnu general public licen[sc]e(?: version| v)? ?3(?: 0)?", "gnu gpl(?: version| v)? ?3", "gplv3", "gpl 3(?: 0)?(?: or later| only)?"),
    "gpl-2": ("gnu general public licen[sc]e(?: version| v)? ?2(?: 0)?", "gnu gpl(?: version| v)? ?2", "gplv2", "gpl 2(?: 0)?(?: or later| only)?"),
    "gpl": ("gnu general public licen[sc]e", "gnu gpl"),
    "lgpl-3": ("gnu lesser general public licen[sc]e(?: version| v)? ?3(?: 0)?", "lgplv3", "lgpl 3(?: 0)?(?: or later| only)?"),
    "lgpl-2": ("gnu (?:lesser|library) general public licen[sc]e(?: version| v)? ?2(?: [01])?", "lgplv2(?: 1)?", "lgpl 2(?: [01])?(?: or later| only)?"),
    "lgpl": ("gnu (?:lesser|library) general public licen[sc]e", "gnu lgpl"),
    "agpl-3": ("gnu affero general public licen[sc]e(?: version| v)? ?3(?: 0)?", "agplv3", "agpl 3(?: 0)?(?: or later| only)?"),
    "agpl": ("gnu affero general public licen[sc]e", "gnu agpl"),
    "fdl": ("gnu free documentation licen[sc]e(?: version| v)?(?: 1(?: [0-3])?)?", "gfdl(?: 1 [0-3])?"),
    "bsd-2": ("bsd 2 clause(?: licen[sc]e)?", "2 clause bsd(?: licen[sc]e)?", "simplified bsd licen[sc]e", "freebsd licen[sc]e"),
    "bsd-3": ("bsd 3 clause(?: licen[sc]e)?", "3 clause bsd(?: licen[sc]e)?", "new bsd licen[sc]e", "modified bsd licen[sc]e", "revised bsd licen[sc]e"),
    "bsd-4": ("bsd 4 clause(?: licen[sc]e)?", "4 clause bsd(?: licen[sc]e)?", "original bsd licen[sc]e"),
    "bsd": ("bsd (?:style )?licen[sc]e", "berkeley software distribution licen[sc]e"),
    "mpl-2": ("mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?", "mpl(?: version| v)? ?2(?: 0)?"),
    "mpl-1": ("mozilla public licen[sc]e(?: version| v)? ?1(?: [01])?", "mpl(?: version| v)? ?1(?: [01])?"),
    "epl": ("eclipse public licen[sc]e(?: version| v)?(?: [12](?: 0)?)?", "epl [12] 0"),
    "cddl": ("common development and distribution licen[sc]e(?: 1 [01])?", "cddl(?: 1 [01])?"),
    "cpl": ("common public licen[sc]e(?: version| v)?(?: 1 0)?",),
    "artistic": ("artistic licen[sc]e(?: version| v)?(?: [12](?: 0)?)?", "perl artistic licen[sc]e"),
    "isc": ("isc licen[sc]e", "internet systems consortium licen[sc]e"),
    "zlib": ("zlib(?: libpng)? licen[sc]e",),
    "boost": ("boost software licen[sc]e(?: version| v)?(?: 1 0)?", "bsl 1 0"),
    "unlicense": ("the unlicen[sc]e", "unlicen[sc]e org"),
    "wtfpl": ("do what the fuck you want to public licen[sc]e", "wtfpl(?: version 2)?"),
    "ofl": ("sil open font licen[sc]e(?: version| v)?(?: 1 [01])?", "ofl 1 [01]"),
    "eupl": ("european union public licen[sc]e(?: version| v)?(?: 1 [0-2])?", "eupl(?: v)?(?: 1 [0-2])?"),
    "psf": ("python software foundation licen[sc]e", "psf licen[sc]e(?: version 2)?"),
    "odbl": ("open database licen[sc]e(?: version| v)?(?: 1 0)?", "odbl(?: 1 0)?"),
    "cc0": ("cc0(?: 1 0)?(?: universal)?", "creative commons zero(?: v1 0)?", "cc zero"),
    "cc-by-nc-nd": ("cc by nc nd(?: [1-4] [05])?", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    "cc-by-nc-sa": ("cc by nc sa(?: [1-4] [05])?", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    "cc-by-nc": ("cc by nc(?: [1-4] [05])?", "creative commons attribution non ?commercial(?: [1-4] [05])?"),
    "cc-by-nd": ("cc by nd(?: [1-4] [05])?", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    "cc-by-sa": ("cc by sa(?: [1-4] [05])?", "creative commons attribution share ?alike(?: [1-4] [05])?"),
    "cc-by": ("cc by(?: [1-4] [05])?", "creative commons attribution(?: [1-4] [05])?"),
    "public-domain": ("public domain", "no rights reserved"),
    "proprietary": ("all rights reserved", "proprietary and confidential", "unauthorized copying of this file"),
}
# how a text says that it is under a licence: (before, after, priority, weight)
PHRASES = (
    ("(?:is |are )?(?:licen[sc]ed|released|distributed|published|available|provided|made available) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?", "", 4, 1.0),
    ("(?:under|subject to) the (?:terms (?:and conditions )?of the )?", "", 3, 0.9),
    ("spdx licen[sc]e identifier ", "", 4, 1.0),
    ("licen[sc]e ", "", 2, 0.8),
    ("see (?:the )?", "(?: file)? for (?:the )?(?:full |more )?(?:details|text|terms|information)", 3, 0.8),
    ("", " see licen[sc]e(?: file)?", 3, 0.8),
    ("", "", 1, 0.6),
)
# notices that name no licence but are the text of one: (label, priority, weight, keyword, expression)
TEXTS = (
    ("mit", 5, 1.0, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 5, 0.9, "the above copyright notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", 5, 1.0, "permission to use copy modify", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"),
    ("bsd", 5, 0.9, "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", 5, 1.0, "neither the name of", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors"),
    ("bsd-4", 5, 1.0, "all advertising materials", "all advertising materials mentioning features or use of this software"),
    ("gpl", 5, 0.9, "free software", "this program is free software you can redistribute it and or modify it"),
    ("gpl", 4, 0.8, "warranty", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", 5, 0.9, "free software", "this library is free software you can redistribute it and or modify it"),
    ("apache-2", 5, 1.0, "apache org", "www apache org licenses license 2 0"),
    ("mpl-2", 5, 1.0, "source code form", "this source code form is subject to the terms of the mozilla public license"),
    ("boost", 5, 1.0, "boost org", "www boost org license 1 0"),
    ("unlicense", 5, 1.0, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", 5, 1.0, "altered source", "altered source versions must be plainly marked as such"),
    ("cc-by", 4, 0.9, "creativecommons", "creativecommons org licenses by(?: [1-4] 0)?"),
    ("cc-by-sa", 5, 0.9, "creativecommons", "creativecommons org licenses by sa(?: [1-4] 0)?"),
    ("cc-by-nc", 5, 0.9, "creativecommons", "creativecommons org licenses by nc(?: [1-4] 0)?"),
    ("cc-by-nd", 5, 0.9, "creativecommons", "creativecommons org licenses by nd(?: [1-4] 0)?"),
    ("cc0", 5, 0.9, "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("mit", 5, 0.9, "without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("mit", 4, 0.8, "the software is provided", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties"),
    ("mit", 4, 0.8, "in no event shall the authors", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc", 5, 0.9, "permission notice appear", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", 5, 0.9, "disclaims all warranties", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd", 5, 0.9, "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", 5, 0.9, "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd", 4, 0.8, "this software is provided by", "this software is provided by (?:[^ ]+ ){1,12}as is and any express or implied warranties"),
    ("bsd-3", 5, 0.9, "endorse or promote products", "to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", 5, 0.9, "this product includes software", "this product includes software developed by the (?:university of california|regents of the university)"),
    ("apache-1", 5, 1.0, "this product includes software", "this product includes software developed by the apache (?:software foundation|group)"),
    ("apache-2", 5, 0.9, "in compliance with the licen", "you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2", 5, 0.9, "unless required by applicable", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2", 4, 0.8, "perpetual worldwide", "a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[sc]e"),
    ("gpl-3", 5, 1.0, "either version 3", "general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e"),
    ("gpl-2", 5, 1.0, "either version 2", "general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e"),
    ("gpl", 4, 0.8, "changing it is not allowed", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed"),
    ("gpl", 4, 0.8, "you should have received", "you should have received a copy of the gnu general public licen[sc]e along with this program"),
    ("lgpl", 5, 0.9, "you should have received", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this library"),
    ("lgpl", 4, 0.8, "this library is distributed", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl-3", 5, 1.0, "incorporates the terms", "this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3"),
    ("lgpl-2", 5, 1.0, "either version 2 1", "lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e"),
    ("agpl-3", 5, 1.0, "remote network interaction", "remote network interaction use with the gnu general public licen[sc]e"),
    ("agpl-3", 5, 0.9, "prominently offer all users", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("fdl", 5, 1.0, "permission is granted to copy", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("fdl", 5, 0.9, "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", 5, 0.9, "was not distributed with this file", "if a copy of the mpl was not distributed with this file"),
    ("mpl-1", 5, 1.0, "the contents of this file", "the contents of this file are subject to the mozilla public licen[sc]e version 1"),
    ("epl", 5, 1.0, "the accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("cpl", 5, 1.0, "the accompanying program", "the accompanying program is provided under the terms of this common public licen[sc]e"),
    ("cddl", 5, 1.0, "the contents of this file", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("artistic", 5, 1.0, "the intent of this document", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", 5, 0.9, "verbatim copies of the source", "you may make and give away verbatim copies of the source form of the standard version of this package"),
    ("zlib", 5, 0.9, "the origin of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 5, 0.9, "this notice may not be removed", "this notice may not be removed or altered from any source distribution"),
    ("boost", 5, 1.0, "accompanying documentation", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
    ("unlicense", 5, 0.9, "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 5, 0.9, "changing it is allowed", "verbatim or modified copies of this licen[sc]e document and changing it is allowed as long as the name is changed"),
    ("wtfpl", 5, 0.9, "you just do what", "you just do what the fuck you want to"),
    ("ofl", 5, 1.0, "this font software", "this font software is licensed under the sil open font licen[sc]e"),
    ("ofl", 5, 0.9, "nor any of its individual", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("eupl", 5, 1.0, "applies to the work", "this european union public licen[sc]e (?:the )?eupl applies to the work"),
    ("psf", 5, 1.0, "python software foundation", "this licen[sc]e agreement is between the python software foundation"),
    ("psf", 5, 0.9, "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world ?wide licen[sc]e"),
    ("odbl", 5, 0.9, "contents of the database", "any rights in individual contents of the database are licensed under the database contents licen[sc]e"),
    ("cc0", 5, 0.9, "waived all copyright", "has waived all copyright and related or neighboring rights"),
    ("cc-by", 4, 0.8, "you must give appropriate credit", "you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made"),
    ("cc-by-sa", 4, 0.8, "you must distribute your", "you must distribute your contributions under the same licen[sc]e as the original"),
    ("cc-by-nc", 4, 0.8, "commercial purposes", "you may not use the material for commercial purposes"),
    ("cc-by-nd", 4, 0.8, "the modified material", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-nc-sa", 5, 0.9, "creativecommons", "creativecommons org licenses by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc-nd", 5, 0.9, "creativecommons", "creativecommons org licenses by nc nd(?: [1-4] 0)?"),
    ("public-domain", 4, 0.8, "the public domain", "(?:is|has been|are|have been) (?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 5, 0.9, "copyright to this source code", "the authors? (?:hereby )?disclaims? copyright to this source code"),
    ("proprietary", 4, 0.8, "reverse engineer", "(?:you )?(?:may|shall) not (?:copy modify )?reverse engineer decompile or disassemble"),
    ("proprietary", 4, 0.8, "no part of this publication", "no part of this publication may be reproduced stored in a retrieval system or transmitted"),
    ("proprietary", 4, 0.8, "strictly prohibited", "strictly prohibited without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)"),
)


def _keyword(expression: str) -> str:
    """The longest run of plain letters, digits and spaces that stands outside any choice or option.

    Matches are whole words, so a run at either end of the expression has a space beyond it.
    """
    expression = f" {expression} "
    depth, run, runs = 0, "", []
    i = 0
    while i < len(expression):
        c = expression[i]
        plain = c.isalnum() or c == " "
        follows = expression[i + 1 : i + 2]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if plain and depth == 0 and follows not in ("?", "*", "{"):
            run += c
        elif run:
            runs.append(run)
            run = ""
        i += 1
    return max([*runs, run], key=lambda r: (r.strip() != "licen", len(r)))  # a word that every other licence has tells little


def names() -> list[tuple[str, str, str]]:
    """``label, keyword, expression`` of the ways to name a licence."""
    return [(label, _keyword(name), name) for label, said in NAMES.items() for name in said]


def rules() -> list[tuple[str, int, float, str, str]]:
    """All rules, the most telling first: the texts, and every name in every frame."""
    out = [(label, priority, weight, f" {word}" if f" {word}" in f" {rx}" else word, rx) for label, priority, weight, word, rx in TEXTS]
    for before, after, priority, weight in PHRASES:
        out += [(label, priority, weight, word, before + name + after) for label, word, name in names()]
    return sorted(out, key=lambda r: (-r[1], -r[2]))
