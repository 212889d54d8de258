"""Signature rules for licenses, in order: label, kind and a regex over normalised words.

Normalised text has its words (digits, a-z, anything beyond ASCII) in lower case with one
space between them. A rule's kind gives its priority; a pattern never crosses a word's middle.
"""

from __future__ import annotations

import re

#: Kinds from weak to strong; a rule's priority is its kind's place. The second number is the confidence of a find.
KINDS = {"hint": 0.3, "name": 0.6, "title": 0.8, "url": 0.85, "notice": 0.9, "spdx": 0.95, "text": 1.0}

#: Phrases whose every place counts, and which no other find suppresses.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_RULES = """
mit notice (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
mit text permission is hereby granted free of charge to any person obtaining a copy of this software
mit text the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit spdx spdx license identifier mit
mit url opensource org licenses mit(?: license)?
mit title the mit licen[sc]e
mit title mit licen[sc]e mit
mit name mit licen[sc]ed?
mit name expat licen[sc]e
mit hint licen[sc]e mit
mit-0 spdx spdx license identifier mit 0
mit-0 title mit no attribution(?: licen[sc]e)?
mit-0 name mit 0 licen[sc]e
x11 title x11 licen[sc]e
x11 text except as contained in this notice the name of the x consortium shall not be used
x11 spdx spdx license identifier x11
apache-2 notice licensed under the apache licen[sc]e version 2(?: 0)?
apache-2 notice (?:released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?
apache-2 notice you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2 text terms and conditions for use reproduction and distribution 1 definitions
apache-2 spdx spdx license identifier apache 2 0
apache-2 url (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2 url opensource org licenses apache 2 0
apache-2 title apache licen[sc]e version 2(?: 0)?
apache-2 title apache software licen[sc]e version 2(?: 0)?
apache-2 name apache (?:licen[sc]e )?(?:v)?2(?: 0)? licen[sc]ed?
apache-2 name apache 2 0
apache-1.1 title apache software licen[sc]e version 1 1
apache-1.1 spdx spdx license identifier apache 1 1
apache-1.1 text this product includes software developed by the apache software foundation
apache-1.0 spdx spdx license identifier apache 1 0
apache-1.0 title apache licen[sc]e version 1 0
apache hint apache licen[sc]e
apache hint apache licen[sc]ed
gpl-3 notice licensed under the gnu general public licen[sc]e (?:version |v )?3(?: 0)?
gpl-3 notice terms of the gnu general public license as published by the free software foundation either version 3
gpl-3 text gnu general public license version 3 29 june 2007
gpl-3 spdx spdx license identifier gpl 3 0(?: only| or later)?
gpl-3 url (?:www )?gnu org licenses gpl 3 0
gpl-3 title gnu general public licen[sc]e (?:version |v )?3(?: 0)?
gpl-3 name gnu gpl (?:version |v )?3
gpl-3 name gplv3
gpl-3 name gpl (?:v |version )?3(?: 0)?
gpl-2 notice licensed under the gnu general public licen[sc]e (?:version |v )?2(?: 0)?
gpl-2 notice terms of the gnu general public license as published by the free software foundation either version 2
gpl-2 text gnu general public license version 2 june 1991
gpl-2 spdx spdx license identifier gpl 2 0(?: only| or later)?
gpl-2 url (?:www )?gnu org licenses (?:old licenses )?gpl 2 0
gpl-2 title gnu general public licen[sc]e (?:version |v )?2(?: 0)?
gpl-2 name gnu gpl (?:version |v )?2
gpl-2 name gplv2
gpl-2 name gpl (?:v |version )?2(?: 0)?
gpl-1 spdx spdx license identifier gpl 1 0(?: only| or later)?
gpl-1 text gnu general public license version 1 february 1989
gpl hint gnu general public licen[sc]e
gpl hint gnu gpl
gpl hint gpl licen[sc]ed?
lgpl-3 notice terms of the gnu lesser general public license as published by the free software foundation either version 3
lgpl-3 text gnu lesser general public license version 3 29 june 2007
lgpl-3 spdx spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 url (?:www )?gnu org licenses lgpl 3 0
lgpl-3 title gnu lesser general public licen[sc]e (?:version |v )?3(?: 0)?
lgpl-3 name lgplv3
lgpl-3 name lgpl (?:v |version )?3(?: 0)?
lgpl-2.1 notice terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-2.1 text gnu lesser general public license version 2 1 february 1999
lgpl-2.1 spdx spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 url (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-2.1 title gnu lesser general public licen[sc]e (?:version |v )?2 1
lgpl-2.1 name lgplv2 1
lgpl-2.1 name lgpl (?:v |version )?2 1
lgpl-2 title gnu library general public licen[sc]e(?: version 2)?
lgpl-2 spdx spdx license identifier lgpl 2 0(?: only| or later)?
lgpl hint gnu lesser general public licen[sc]e
lgpl hint lgpl licen[sc]ed?
agpl-3 notice terms of the gnu affero general public license as published by the free software foundation either version 3
agpl-3 text gnu affero general public license version 3 19 november 2007
agpl-3 spdx spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 url (?:www )?gnu org licenses agpl 3 0
agpl-3 title gnu affero general public licen[sc]e(?: version 3| v3)?
agpl-3 name agplv3
agpl-3 name agpl (?:v |version )?3(?: 0)?
gfdl notice permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl url (?:www )?gnu org licenses fdl(?: 1 [123])?
gfdl spdx spdx license identifier gfdl 1 [123](?: only| or later)?
gfdl title gnu free documentation licen[sc]e
gpl-classpath title gnu classpath exception
gpl-classpath name gpl (?:2 0 )?with classpath exception
bsd-3 text neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
bsd-3 text neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote
bsd-3 spdx spdx license identifier bsd 3 clause
bsd-3 url opensource org licenses bsd 3 clause
bsd-3 title (?:new|modified|revised|3 clause|three clause) bsd licen[sc]e
bsd-3 title bsd 3 clause(?: licen[sc]e)?
bsd-2 spdx spdx license identifier bsd 2 clause
bsd-2 url opensource org licenses bsd 2 clause
bsd-2 title (?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e
bsd-2 title bsd 2 clause(?: licen[sc]e)?
bsd-4 text all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-4 spdx spdx license identifier bsd 4 clause
bsd-4 title (?:original|4 clause|four clause) bsd licen[sc]e
bsd-0 spdx spdx license identifier 0bsd
bsd-0 title (?:zero clause|0 clause|free public) (?:bsd )?licen[sc]e
bsd notice (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?bsd licen[sc]e
bsd notice redistribution and use in source and binary forms with or without modification are permitted
bsd hint bsd (?:style )?licen[sc]ed?
isc text permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc spdx spdx license identifier isc
isc url opensource org licenses isc
isc title isc licen[sc]e
zlib text this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib spdx spdx license identifier zlib
zlib title zlib libpng licen[sc]e
zlib name zlib licen[sc]e
libpng title libpng licen[sc]e
libpng spdx spdx license identifier libpng(?: 2 0)?
mpl-2 notice this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 text mozilla public license version 2 0 1 definitions
mpl-2 spdx spdx license identifier mpl 2 0
mpl-2 url (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-2 title mozilla public licen[sc]e (?:version |v )?2(?: 0)?
mpl-2 name mpl (?:v )?2 0
mpl-1.1 notice the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 spdx spdx license identifier mpl 1 1
mpl-1.1 title mozilla public licen[sc]e (?:version |v )?1 1
mpl hint mozilla public licen[sc]e
epl-2 notice terms of the eclipse public license (?:v |version )?2 0
epl-2 spdx spdx license identifier epl 2 0
epl-2 url (?:www )?eclipse org legal epl (?:v20|2 0)
epl-2 title eclipse public licen[sc]e (?:version |v )?2(?: 0)?
epl-1 notice terms of the eclipse public license (?:v |version )?1 0
epl-1 spdx spdx license identifier epl 1 0
epl-1 url (?:www )?eclipse org legal epl v10
epl-1 title eclipse public licen[sc]e (?:version |v )?1(?: 0)?
epl hint eclipse public licen[sc]e
edl-1 title eclipse distribution licen[sc]e(?: v 1 0)?
cddl-1 spdx spdx license identifier cddl 1 [01]
cddl-1 notice subject to the terms of the common development and distribution license
cddl-1 title common development and distribution licen[sc]e(?: version 1 [01])?
cpl-1 title common public licen[sc]e(?: version 1 0)?
cpl-1 spdx spdx license identifier cpl 1 0
ipl-1 title ibm public licen[sc]e(?: version 1 0)?
eupl-1.2 spdx spdx license identifier eupl 1 2
eupl-1.2 title european union public licen[sc]e(?: v)? ?1 2
eupl hint european union public licen[sc]e
eupl hint licensed under the eupl
artistic-2 spdx spdx license identifier artistic 2 0
artistic-2 title (?:the )?artistic licen[sc]e (?:version )?2(?: 0)?
artistic-1 spdx spdx license identifier artistic 1 0(?: perl)?
artistic-1 title (?:the )?artistic licen[sc]e
bsl-1 text boost software license version 1 0 august 17th 2003
bsl-1 spdx spdx license identifier bsl 1 0
bsl-1 url (?:www )?boost org license 1 0(?: txt)?
bsl-1 title boost software licen[sc]e
busl-1.1 spdx spdx license identifier busl 1 1
busl-1.1 title business source licen[sc]e(?: 1 1)?
sspl-1 spdx spdx license identifier sspl 1 0
sspl-1 title server side public licen[sc]e
elastic-2 spdx spdx license identifier elastic 2 0
elastic-2 title elastic licen[sc]e (?:v )?2(?: 0)?
unlicense text this is free and unencumbered software released into the public domain
unlicense spdx spdx license identifier unlicense
unlicense url unlicense org
unlicense title the unlicense
wtfpl text do what the fuck you want to public licen[sc]e
wtfpl spdx spdx license identifier wtfpl
wtfpl name wtfpl
cc0 notice to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights
cc0 spdx spdx license identifier cc0 1 0
cc0 url creativecommons org publicdomain zero 1 0
cc0 title creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?
cc0 name cc0(?: 1 0)?
cc-by-nc notice licensed under (?:a |the )?(?:creative commons )?cc by nc(?: [1-4] [05])?
cc-by-nc spdx spdx license identifier cc by nc [1-4] [05]
cc-by-nc url creativecommons org licenses by nc [1-4] [05]
cc-by-nc title creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)?
cc-by-nc name cc by nc(?: [1-4] [05])?
cc-by-nc-sa notice licensed under (?:a |the )?(?:creative commons )?cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa spdx spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-sa url creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-sa title creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international)?
cc-by-nc-sa name cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd notice licensed under (?:a |the )?(?:creative commons )?cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd spdx spdx license identifier cc by nc nd [1-4] [05]
cc-by-nc-nd url creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-nd title creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc-nd name cc by nc nd(?: [1-4] [05])?
cc-by-sa notice licensed under (?:a |the )?(?:creative commons )?cc by sa(?: [1-4] [05])?
cc-by-sa spdx spdx license identifier cc by sa [1-4] [05]
cc-by-sa url creativecommons org licenses by sa [1-4] [05]
cc-by-sa title creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?
cc-by-sa name cc by sa(?: [1-4] [05])?
cc-by-nd spdx spdx license identifier cc by nd [1-4] [05]
cc-by-nd url creativecommons org licenses by nd [1-4] [05]
cc-by-nd title creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nd name cc by nd(?: [1-4] [05])?
cc-by notice licensed under (?:a |the )?(?:creative commons )?cc by(?: [1-4] [05])?
cc-by spdx spdx license identifier cc by [1-4] [05]
cc-by url creativecommons org licenses by [1-4] [05]
cc-by title creative commons attribution(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?
cc-by name cc by [1-4] [05]
cc hint creative commons licen[sc]e
odbl title open database licen[sc]e
odbl spdx spdx license identifier odbl 1 0
odbl url opendatacommons org licenses odbl
odc-by title open data commons attribution licen[sc]e
odc-by url opendatacommons org licenses by
pddl title public domain dedication and licen[sc]e
ogl title open government licen[sc]e(?: v? ?3(?: 0)?)?
ofl-1.1 text this font software is licensed under the sil open font license version 1 1
ofl-1.1 spdx spdx license identifier ofl 1 1
ofl-1.1 title sil open font licen[sc]e
psf-2 title python software foundation licen[sc]e(?: version 2)?
psf-2 spdx spdx license identifier (?:psf|python) 2 0
ruby title ruby licen[sc]e
php-3 title php licen[sc]e(?: version 3 01?)?
openssl title openssl licen[sc]e
openssl text this product includes software developed by the openssl project
curl title curl licen[sc]e
ncsa title university of illinois ncsa open source licen[sc]e
ncsa spdx spdx license identifier ncsa
postgresql title postgresql licen[sc]e
postgresql spdx spdx license identifier postgresql
ms-pl title microsoft public licen[sc]e
ms-pl spdx spdx license identifier ms pl
ms-rl title microsoft reciprocal licen[sc]e
afl-3 title academic free licen[sc]e(?: version 3 0)?
osl-3 title open software licen[sc]e(?: version 3 0)?
upl-1 title universal permissive licen[sc]e(?: version 1 0)?
vim title vim licen[sc]e
beerware title beerware licen[sc]e
json text the software shall be used for good not evil
mulan-2 title mulan permissive software licen[sc]e(?: version 2)?
openrail title open rail (?:m|s)?licen[sc]e
openrail name openrail(?: m)? licen[sc]e
llama title llama (?:2|3) community licen[sc]e
public-domain notice (?:released|placed|dedicated) (?:in)?to the public domain
public-domain notice (?:is|are) in the public domain
public-domain hint public domain
all-rights notice copyright .{1,60} all rights reserved
all-rights hint all rights reserved
""".strip()

#: Every rule's keyword holds one of these words: texts with none hold no license.
ANCHORS = ("licen", "public domain", "publicdomain", "cc by", "cc0", "creative commons", "copyright", "permission", "redistribution", "rights reserved", "gpl", "wtfpl", "apache", "mpl", "gnu", "mozilla", "eclipse", "warranty", "software", "mit no attribution", "terms", "bsd", "libpng", "x consortium", "endorse or promote", "openrail", "open rail", "classpath")


def keyword(pattern: str) -> str:
    """The longest literal part with an anchor that every match of a pattern holds."""
    flat = re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??", "\0", pattern)
    flat = re.sub(r"\[[^\]]*\]\??|\.\{[^}]*\}|.\?", "\0", flat)
    return max((p.strip() for p in flat.split("\0")), key=lambda p: (any(a in p for a in ANCHORS), len(p)))


def rules() -> list[dict]:
    """Base phrases first, then the rules in their order."""
    kinds = list(KINDS)
    out = [{"label": label, "kind": "notice", "pattern": phrase, "base": True} for phrase, label in BASE]
    for line in _RULES.split("\n"):
        label, kind, pattern = line.split(" ", 2)
        out.append({"label": label, "kind": kind, "pattern": pattern, "base": False})
    for r in out:
        r["keyword"], r["priority"], r["confidence"] = keyword(r["pattern"]), kinds.index(r["kind"]), KINDS[r["kind"]]
    return out
