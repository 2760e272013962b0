"""Signature rules of license texts, over normalised words parted by single spaces.

Each rule: label, level, keyword and pattern. Level 1 is a grant or an identifier that settles the matter,
2 a license named with its version or full name, 3 a mention. The keyword must stand in the text before
the pattern is tried; every match of the pattern contains it. Patterns know no spaces but single ones
and match whole words; where rules meet the same words, the order of this list decides.
"""

from __future__ import annotations

#: SPDX identifiers as normalised words, with the label each stands for.
SPDX = {
    "mit": "mit", "mit 0": "mit-0", "apache 1 1": "apache-1.1", "apache 2 0": "apache-2.0", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "bsd 4 clause": "bsd-4-clause", "0bsd": "0bsd", "isc": "isc", "gpl 1 0(?: only| or later)?": "gpl-1.0", "gpl 2 0(?: only| or later)?": "gpl-2.0", "gpl 3 0(?: only| or later)?": "gpl-3.0",
    "lgpl 2 0(?: only| or later)?": "lgpl-2.0", "lgpl 2 1(?: only| or later)?": "lgpl-2.1", "lgpl 3 0(?: only| or later)?": "lgpl-3.0", "agpl 1 0(?: only| or later)?": "agpl-1.0",
    "agpl 3 0(?: only| or later)?": "agpl-3.0", "mpl 1 0": "mpl-1.0", "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2.0", "epl 1 0": "epl-1.0", "epl 2 0": "epl-2.0", "cddl 1 0": "cddl-1.0", "cddl 1 1": "cddl-1.1",
    "cpl 1 0": "cpl-1.0", "eupl 1 1": "eupl-1.1", "eupl 1 2": "eupl-1.2", "unlicense": "unlicense", "wtfpl": "wtfpl", "zlib": "zlib", "libpng": "libpng", "bsl 1 0": "bsl-1.0", "busl 1 1": "busl-1.1",
    "artistic 1 0": "artistic-1.0", "artistic 2 0": "artistic-2.0", "afl 3 0": "afl-3.0", "osl 3 0": "osl-3.0", "ms pl": "ms-pl", "ms rl": "ms-rl", "ncsa": "ncsa", "upl 1 0": "upl-1.0",
    "python 2 0": "python-2.0", "psf 2 0": "psf-2.0", "php 3 01": "php-3.01", "ruby": "ruby", "postgresql": "postgresql", "openssl": "openssl", "ofl 1 0": "ofl-1.0", "ofl 1 1": "ofl-1.1",
    "gfdl 1 1(?: only| or later)?": "gfdl-1.1", "gfdl 1 2(?: only| or later)?": "gfdl-1.2", "gfdl 1 3(?: only| or later)?": "gfdl-1.3", "odbl 1 0": "odbl-1.0", "odc by 1 0": "odc-by-1.0", "pddl 1 0": "pddl-1.0",
    "cdla permissive 1 0": "cdla-permissive-1.0", "cdla permissive 2 0": "cdla-permissive-2.0", "cdla sharing 1 0": "cdla-sharing-1.0", "sspl 1 0": "sspl-1.0", "elastic 2 0": "elastic-2.0", "cc0 1 0": "cc0-1.0",
    "cecill 2 1": "cecill-2.1", "cecill b": "cecill-b", "cecill c": "cecill-c", "mulanpsl 2 0": "mulanpsl-2.0", "blueoak 1 0 0": "blueoak-1.0.0", "ecl 2 0": "ecl-2.0", "efl 2 0": "efl-2.0", "lppl 1 3c": "lppl-1.3c",
    "polyform noncommercial 1 0 0": "polyform-noncommercial-1.0.0", "x11": "x11", "vim": "vim", "tcl": "tcl", "w3c": "w3c", "icu": "icu", "curl": "curl", "hpnd": "hpnd", "qpl 1 0": "qpl-1.0", "sleepycat": "sleepycat", "apsl 2 0": "apsl-2.0", "npl 1 1": "npl-1.1", "ipl 1 0": "ipl-1.0", "rpl 1 5": "rpl-1.5", "watcom 1 0": "watcom-1.0", "zpl 2 1": "zpl-2.1",
}

#: Parts of Creative Commons licenses: short form, long form.
CC = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:s|atives)", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:s|atives)"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: (label, level, keyword, pattern), hand-written.
WRITTEN = (
    # grants
    ("mit", 1, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 1, "mit license", "(?:is |are )?(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit license"),
    ("isc", 1, "permission to use copy", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"),
    ("bsd", 1, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 1, "endorse or promote", "neither the name of (?:[^ ]+ ){1,12}?may be used to endorse or promote products"),
    ("bsd-4-clause", 1, "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", 1, "apache license", "licensed under the apache license version 2 0(?: the license)?"),
    ("apache-2.0", 1, "apache org licenses", "(?:www )?apache org licenses license 2 0"),
    ("gpl-2.0", 1, "general public license", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?general public license (?:version |v )?2(?: 0)?"),
    ("gpl-3.0", 1, "general public license", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?general public license (?:version |v )?3(?: 0)?"),
    ("gpl", 1, "redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 1, "redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", 1, "redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gfdl", 1, "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", 1, "mozilla public license", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-1.1", 1, "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", 1, "eclipse public license", "made available under the terms of the eclipse public license(?: version| v)? 2 0"),
    ("epl-1.0", 1, "eclipse public license", "made available under the terms of the eclipse public license(?: version| v)? 1 0"),
    ("unlicense", 1, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", 1, "waived all copyright", "(?:has|have) waived all copyright and related or neighboring rights"),
    ("public-domain", 1, "public domain", "(?:is |are |been )?(?:hereby )?(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("zlib", 1, "express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", 1, "boost software license", "distributed under the boost software license version 1 0"),
    ("ofl-1.1", 1, "open font license", "this font software is licensed under the sil open font license version 1 1"),
    ("artistic-2.0", 1, "artistic license", "under the terms of the artistic license(?: version)? 2 0"),
    ("wtfpl", 1, "what the fuck", "do what the fuck you want to public license"),
    ("proprietary", 1, "proprietary and confidential", "(?:is |are )?proprietary and confidential"),
    ("proprietary", 1, "unauthorized copying", "unauthorized copying of this (?:file|document|software|work)"),
    ("proprietary", 1, "may not be", "may not be (?:copied|reproduced|published)(?: or (?:copied|reproduced|redistributed))? (?:in any form )?without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)"),
    ("proprietary", 1, "without permission", "(?:no part of this|reproduction|redistribution) (?:[^ ]+ ){0,12}?without permission"),
    ("evaluation", 1, "evaluation purposes", "for evaluation purposes only"),
    ("non-commercial", 1, "commercial use", "(?:not for|no) commercial use"),
    ("non-commercial", 1, "non commercial", "for (?:personal |educational |research )?(?:and |or )?non commercial (?:use|purposes) only"),
    ("research-only", 1, "research purposes", "for (?:academic )?research purposes only"),
    ("no-ai-training", 1, "training", "(?:may|must|shall) not be used (?:for|in) (?:the )?training(?: of)?(?: any)? (?:ai|machine learning|artificial intelligence|language models?)"),
    ("no-ai-training", 1, "text and data mining", "(?:rights? (?:of|to|for)|opt(?:s|ed)? out of) text and data mining"),
    # names with version
    ("apache-2.0", 2, "apache", "apache (?:software )?license(?: version| v)? 2(?: 0)?"),
    ("apache-1.1", 2, "apache", "apache (?:software )?license(?: version| v)? 1 1"),
    ("apache-1.0", 2, "apache", "apache (?:software )?license(?: version| v)? 1 0"),
    ("mit", 2, "mit license", "(?:the )?mit license"),
    ("mit", 2, "expat", "expat license"),
    ("mit-x11", 2, "x11", "(?:mit )?x11 license"),
    ("bsd-2-clause", 2, "bsd", "(?:2 clause|two clause|simplified|freebsd) bsd license"),
    ("bsd-3-clause", 2, "bsd", "(?:3 clause|three clause|new|modified|revised) bsd license"),
    ("bsd-4-clause", 2, "bsd", "(?:4 clause|four clause|original|old) bsd license"),
    ("bsd-2-clause", 2, "bsd", "bsd 2 clause(?: license)?"),
    ("bsd-3-clause", 2, "bsd", "bsd 3 clause(?: license)?"),
    ("gpl-1.0", 2, "general public license", "(?:gnu )?general public license(?: version| v)? 1(?: 0)?"),
    ("gpl-2.0", 2, "general public license", "(?:gnu )?general public license(?: version| v)? 2(?: 0)?"),
    ("gpl-3.0", 2, "general public license", "(?:gnu )?general public license(?: version| v)? 3(?: 0)?"),
    ("gpl-2.0", 2, "gpl", "gpl ?v?(?:ersion)? ?2(?: 0)?"),
    ("gpl-3.0", 2, "gpl", "gpl ?v?(?:ersion)? ?3(?: 0)?"),
    ("gpl-2.0", 2, "gplv2", "(?:gnu )?gplv2"),
    ("gpl-3.0", 2, "gplv3", "(?:gnu )?gplv3"),
    ("lgpl-2.0", 2, "library general public", "(?:gnu )?library general public license(?: version| v)? 2(?: 0)?"),
    ("lgpl-2.1", 2, "lesser general public", "(?:gnu )?lesser general public license(?: version| v)? 2 1"),
    ("lgpl-3.0", 2, "lesser general public", "(?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?"),
    ("lgpl-2.1", 2, "lgpl", "lgpl ?v?(?:ersion)? ?2 1"),
    ("lgpl-3.0", 2, "lgpl", "lgpl ?v?(?:ersion)? ?3(?: 0)?"),
    ("agpl-3.0", 2, "affero", "(?:gnu )?affero general public license(?: version| v)? 3(?: 0)?"),
    ("agpl-3.0", 2, "agpl", "agpl ?v?(?:ersion)? ?3(?: 0)?"),
    ("gfdl-1.2", 2, "free documentation", "(?:gnu )?free documentation license(?: version| v)? 1 2"),
    ("gfdl-1.3", 2, "free documentation", "(?:gnu )?free documentation license(?: version| v)? 1 3"),
    ("mpl-1.0", 2, "mozilla", "mozilla public license(?: version| v)? 1 0"),
    ("mpl-1.1", 2, "mozilla", "mozilla public license(?: version| v)? 1 1"),
    ("mpl-2.0", 2, "mozilla", "mozilla public license(?: version| v)? 2 0"),
    ("epl-1.0", 2, "eclipse", "eclipse public license(?: version| v)? 1 0"),
    ("epl-2.0", 2, "eclipse", "eclipse public license(?: version| v)? 2 0"),
    ("edl-1.0", 2, "eclipse", "eclipse distribution license(?: version| v)? 1 0"),
    ("cddl-1.0", 2, "common development", "common development and distribution license(?: version| v)? 1 0"),
    ("cddl-1.1", 2, "common development", "common development and distribution license(?: version| v)? 1 1"),
    ("cpl-1.0", 2, "common public", "common public license(?: version| v)? 1 0"),
    ("cpal-1.0", 2, "common public attribution", "common public attribution license(?: version| v)? 1 0"),
    ("eupl-1.1", 2, "european union public", "european union public licen[cs]e(?: version| v)? 1 1"),
    ("eupl-1.2", 2, "european union public", "european union public licen[cs]e(?: version| v)? 1 2"),
    ("ofl-1.1", 2, "open font", "(?:sil )?open font license(?: version| v)? 1 1"),
    ("ofl-1.0", 2, "open font", "(?:sil )?open font license(?: version| v)? 1 0"),
    ("bsl-1.0", 2, "boost", "boost software license(?: version| v)? 1 0"),
    ("busl-1.1", 2, "business source", "business source license(?: version| v)? 1 1"),
    ("artistic-1.0", 2, "artistic", "artistic license(?: version| v)? 1 0"),
    ("artistic-2.0", 2, "artistic", "artistic license(?: version| v)? 2 0"),
    ("afl-2.1", 2, "academic free", "academic free license(?: version| v)? 2 1"),
    ("afl-3.0", 2, "academic free", "academic free license(?: version| v)? 3 0"),
    ("osl-3.0", 2, "open software license", "open software license(?: version| v)? 3 0"),
    ("odbl-1.0", 2, "open database", "open database license(?: version| v)? 1 0"),
    ("odc-by-1.0", 2, "open data commons", "open data commons attribution license(?: version| v)? 1 0"),
    ("pddl-1.0", 2, "public domain dedication", "(?:open data commons )?public domain dedication and license(?: version| v)? 1 0"),
    ("cdla-permissive-2.0", 2, "community data license", "community data license agreement permissive(?: version| v)? 2 0"),
    ("cdla-permissive-1.0", 2, "community data license", "community data license agreement permissive(?: version| v)? 1 0"),
    ("cdla-sharing-1.0", 2, "community data license", "community data license agreement sharing(?: version| v)? 1 0"),
    ("sspl-1.0", 2, "server side public", "server side public license(?: version| v)? 1(?: 0)?"),
    ("elastic-2.0", 2, "elastic license", "elastic license(?: version| v)? 2 0"),
    ("ms-pl", 2, "microsoft", "microsoft public license"),
    ("ms-rl", 2, "microsoft", "microsoft reciprocal license"),
    ("psf-2.0", 2, "python software foundation", "python software foundation license(?: version| v)? 2"),
    ("php-3.01", 2, "php license", "php license(?: version| v)? 3 01"),
    ("cecill-2.1", 2, "cecill", "cecill(?: free software license agreement)?(?: version| v)? 2 1"),
    ("upl-1.0", 2, "universal permissive", "universal permissive license(?: version| v)? 1 0"),
    ("ncsa", 2, "ncsa", "university of illinois ncsa open source license"),
    ("ogl-uk-3.0", 2, "open government", "open government licen[cs]e(?: version| v)? 3 0"),
    ("ogl-uk-2.0", 2, "open government", "open government licen[cs]e(?: version| v)? 2 0"),
    ("ogl-uk-1.0", 2, "open government", "open government licen[cs]e(?: version| v)? 1 0"),
    ("etalab-2.0", 2, "licence ouverte", "licence ouverte(?: open licence)?(?: version| v)? 2 0"),
    ("dl-de-by-2.0", 2, "datenlizenz", "datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("dl-de-zero-2.0", 2, "datenlizenz", "datenlizenz deutschland zero(?: version)? 2 0"),
    ("openrail-m", 2, "rail", "(?:creativeml |bigscience )?open ?rail(?: m)?(?: license)?"),
    ("llama-community", 2, "llama", "llama (?:2 |3 |3 1 )?community license(?: agreement)?"),
    ("mulanpsl-2.0", 2, "mulan", "mulan psl v2"),
    ("polyform-noncommercial-1.0.0", 2, "polyform", "polyform noncommercial license(?: 1 0 0)?"),
    ("unlicense", 2, "unlicense", "(?:the )?unlicense(?: license)?"),
    ("cc0-1.0", 2, "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", 2, "creative commons zero", "creative commons zero(?: license)?"),
    ("cc-pdm-1.0", 2, "public domain mark", "public domain mark(?: 1 0)?"),
    ("isc", 2, "isc license", "isc license"),
    ("zlib", 2, "zlib", "zlib (?:libpng )?license"),
    ("wtfpl", 2, "wtfpl", "wtfpl"),
    # mentions
    ("apache", 3, "apache", "apache (?:software )?license"),
    ("bsd", 3, "bsd", "bsd (?:style )?licen[cs]ed?"),
    ("gpl", 3, "general public license", "general public license"),
    ("gpl", 3, "gpl", "(?:gnu )?gpl"),
    ("lgpl", 3, "lgpl", "(?:gnu )?lgpl"),
    ("lgpl", 3, "lesser general public", "(?:gnu )?lesser general public license"),
    ("lgpl", 3, "library general public", "(?:gnu )?library general public license"),
    ("agpl", 3, "affero", "(?:gnu )?affero general public license"),
    ("agpl", 3, "agpl", "(?:gnu )?agpl"),
    ("gfdl", 3, "free documentation", "(?:gnu )?free documentation license"),
    ("mpl", 3, "mozilla", "mozilla public license"),
    ("epl", 3, "eclipse", "eclipse public license"),
    ("cddl", 3, "cddl", "cddl"),
    ("eupl", 3, "eupl", "eupl"),
    ("ofl", 3, "open font", "(?:sil )?open font license"),
    ("artistic", 3, "artistic", "artistic license"),
    ("busl", 3, "business source", "business source license"),
    ("sspl", 3, "server side public", "server side public license"),
    ("odbl", 3, "open database", "open database license"),
    ("ogl", 3, "open government", "open government licen[cs]e"),
    ("cc-by", 3, "cc by", "cc by"),
    ("cc", 3, "creative commons", "creative commons(?: licen[cs]ed?)?"),
    ("public-domain", 3, "public domain", "public domain"),
    ("reserved", 3, "all rights reserved", "all rights reserved"),
    ("reserved", 3, "alle rechte vorbehalten", "alle rechte vorbehalten"),
    ("reserved", 3, "tous droits", "tous droits réservés"),
    ("reserved", 3, "todos los derechos", "todos los derechos reservados"),
    ("copyright", 3, "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("copyright", 3, "©", "© ?(?:19|20)[0-9][0-9]"),
    ("proprietary", 3, "confidential", "(?:strictly |company )confidential"),
    ("eula", 3, "end user", "end user licen[cs]e agreement"),
    ("dual", 3, "dual licensed", "dual licensed"),
    ("terms", 3, "terms of use", "(?:see|subject to) (?:our |the )?terms of use"),
    ("open-source", 3, "open source license", "open source license"),
    ("free-use", 3, "free to use", "free to use (?:and|or) (?:share|modify|distribute)"),
)


def build() -> list[tuple[str, int, str, str]]:
    """All rules in their order: written ones, SPDX lines and names, Creative Commons in every kind and version."""
    out = list(WRITTEN)
    for words, label in SPDX.items():
        out.append((label, 1, "spdx", f"spdx license identifier {words}"))
        out.append((label, 2, "license", f"license(?:d)? (?:under )?{words}"))
    for short, long in CC.items():
        for version in CC_VERSIONS:
            label = f"cc-{short.replace(' ', '-')}-{version.replace(' ', '.')}"
            out.append((label, 1, f"cc {short}", f"(?:licensed|released|available|published|shared) under (?:a |the )?(?:terms of )?(?:the )?cc {short} {version}"))
            out.append((label, 2, f"cc {short}", f"cc {short} {version}"))
            out.append((label, 2, "creative commons", f"creative commons {long}(?: {version}| (?:international|unported|generic)(?: licen[cs]e)? {version}| licen[cs]e {version})"))
        label = f"cc-{short.replace(' ', '-')}"
        out.append((label, 3, f"cc {short}", f"cc {short}"))
        out.append((label, 3, "creative commons", f"creative commons {long}"))
    return out


#: Labels of the base phrases.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Words that every keyword holds one of: what a text without any of them is spared.
GATES = ("licen", "copyright", "©", "public", "rights", "rechte", "droits", "derechos", "cc ", "cc0", "creative commons", "spdx", "apache", "bsd", "gpl", "mit ", "permission", "redistribut", "endorse or", "advertising materials", "unencumbered", "warranty", "what the fuck", "confidential", "unauthorized", "reproduced", "may not be", "end user", "purposes", "commercial use", "non commercial", "training", "text and data mining", "expat", "x11", "affero", "documentation", "mozilla", "eclipse", "common development", "boost", "business source", "artistic", "academic", "database", "open data", "community data", "server side", "elastic", "microsoft", "python software", "cecill", "universal permissive", "ncsa", "government", "ouverte", "datenlizenz", "rail", "llama", "mulan", "polyform", "zlib", "wtfpl", "cddl", "eupl", "open font", "open software", "terms of use", "open source", "free to use")
