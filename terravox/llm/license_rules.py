"""Licence signatures: fixed names of public licences, and the rules made of them.

A rule is a regular expression over normalised text (lower case, words parted by one space) with a
keyword without which it cannot match, a label, a kind and a priority.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Licence id | name in words | versions | words of its web address (or -)
LICENCES = """
MIT|mit license,mit licence,expat license|-|opensource org licenses mit
Apache|apache license,apache software license,apache public license|1.0,1.1,2.0|apache org licenses license
GPL|gnu general public license,general public license,gnu gpl|1.0,2.0,3.0|gnu org licenses gpl
LGPL|gnu lesser general public license,lesser general public license,gnu library general public license,gnu lgpl|2.0,2.1,3.0|gnu org licenses lgpl
AGPL|gnu affero general public license,affero general public license,gnu agpl|1.0,3.0|gnu org licenses agpl
GFDL|gnu free documentation license,free documentation license|1.1,1.2,1.3|gnu org licenses fdl
BSD-2-Clause|simplified bsd license,freebsd license,2 clause bsd license,bsd 2 clause license,two clause bsd license|-|opensource org licenses bsd 2 clause
BSD-3-Clause|new bsd license,modified bsd license,revised bsd license,3 clause bsd license,bsd 3 clause license,three clause bsd license|-|opensource org licenses bsd 3 clause
BSD-4-Clause|original bsd license,4 clause bsd license,bsd 4 clause license,four clause bsd license|-|-
BSD|bsd license,bsd style license,berkeley software distribution license|-|opensource org licenses bsd license
0BSD|zero clause bsd license,bsd zero clause license,free public license|-|-
MPL|mozilla public license|1.0,1.1,2.0|mozilla org mpl
EPL|eclipse public license|1.0,2.0|eclipse org legal epl
CPL|common public license|1.0|-
IPL|ibm public license|1.0|-
CDDL|common development and distribution license|1.0,1.1|-
EUPL|european union public licence,european union public license|1.0,1.1,1.2|-
CeCILL|cecill license,cecill free software license|1.0,2.0,2.1|cecill info licences
Artistic|artistic license,perl artistic license|1.0,2.0|-
ISC|isc license,isc licence|-|opensource org licenses isc
Zlib|zlib license,zlib libpng license|-|-
BSL|boost software license|1.0|boost org license
BUSL|business source license|1.1|-
CC0|creative commons zero,cc0 public domain dedication|1.0|creativecommons org publicdomain zero
CC-BY|creative commons attribution license,creative commons attribution|1.0,2.0,2.5,3.0,4.0|creativecommons org licenses by
CC-BY-SA|creative commons attribution sharealike,creative commons attribution share alike|1.0,2.0,2.5,3.0,4.0|creativecommons org licenses by sa
CC-BY-NC|creative commons attribution noncommercial,creative commons attribution non commercial|1.0,2.0,2.5,3.0,4.0|creativecommons org licenses by nc
CC-BY-ND|creative commons attribution noderivs,creative commons attribution noderivatives|1.0,2.0,2.5,3.0,4.0|creativecommons org licenses by nd
CC-BY-NC-SA|creative commons attribution noncommercial sharealike,creative commons attribution non commercial share alike|1.0,2.0,2.5,3.0,4.0|creativecommons org licenses by nc sa
CC-BY-NC-ND|creative commons attribution noncommercial noderivs,creative commons attribution non commercial no derivatives|1.0,2.0,2.5,3.0,4.0|creativecommons org licenses by nc nd
Unlicense|the unlicense,unlicense|-|unlicense org
WTFPL|do what the fuck you want to public license|2.0|-
OFL|sil open font license,open font license|1.0,1.1|scripts sil org ofl
ODbL|open database license,odc open database license|1.0|opendatacommons org licenses odbl
ODC-By|open data commons attribution license|1.0|opendatacommons org licenses by
PDDL|public domain dedication and license|1.0|opendatacommons org licenses pddl
PHP|php license|3.0,3.01|-
PSF|python software foundation license,psf license|2.0|-
Ruby|ruby license|-|-
OpenSSL|openssl license|-|-
OSL|open software license|1.0,2.0,2.1,3.0|-
AFL|academic free license|1.1,1.2,2.0,2.1,3.0|-
APSL|apple public source license|1.0,1.1,1.2,2.0|-
MS-PL|microsoft public license|-|-
MS-RL|microsoft reciprocal license|-|-
NCSA|university of illinois ncsa open source license,ncsa open source license|-|-
Postgres|postgresql license,postgresql licence|-|-
X11|x11 license,mit x11 license|-|-
SSPL|server side public license|1.0|-
Elastic|elastic license|2.0|-
UPL|universal permissive license|1.0|-
Vim|vim license|-|-
W3C|w3c software license,w3c software notice and license|-|-
LPPL|latex project public license|1.0,1.1,1.2,1.3|-
ECL|educational community license|1.0,2.0|-
NPL|netscape public license|1.0,1.1|-
QPL|q public license|1.0|-
MulanPSL|mulan permissive software license|1.0,2.0|-
"""

# Label | priority | sentence of a licence text or notice
TEXTS = """
MIT|80|permission is hereby granted free of charge to any person obtaining a copy
MIT|60|the above copyright notice and this permission notice shall be included in all
ISC|80|permission to use copy modify and or distribute this software for any purpose with or without fee
BSD|70|redistribution and use in source and binary forms with or without modification are permitted
BSD-3-Clause|75|neither the name of
BSD-4-Clause|75|all advertising materials mentioning features or use of this software
GPL|70|this program is free software you can redistribute it and or modify it
LGPL|72|this library is free software you can redistribute it and or modify it
GPL|60|you should have received a copy of the gnu general public license
Apache|70|you may not use this file except in compliance with the license
Zlib|70|this software is provided as is without any express or implied warranty in no event
Unlicense|75|this is free and unencumbered software released into the public domain
BSL|75|permission is hereby granted free of charge to any person or organization obtaining a copy of the software
public-domain|40|released into the public domain
public-domain|40|dedicated to the public domain
public-domain|40|is in the public domain
proprietary|50|all rights reserved
proprietary|60|this software is proprietary and confidential
proprietary|60|unauthorized copying of this file via any medium is strictly prohibited
proprietary|50|for internal use only
"""


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    weight: float


def _version(v: str) -> str:
    """A version as words of normalised text, where a point has become a gap: "2.0" is "2 0" or "2"."""
    whole, part = v.split(".")
    return whole + (r"(?: 0)?(?! \d)" if part == "0" else f" {part}")


def _rule(label: str, keyword: str, pattern: str, priority: int, weight: float) -> Rule:
    return Rule(label, keyword.encode(), re.compile(rf"(?<![^ ]){pattern}(?![^ ])".encode()), priority, weight)


def build_rules() -> list[Rule]:
    """All rules, most specific first: tag lines, versioned names, addresses, texts, bare names."""
    rules: list[Rule] = []
    for line in LICENCES.strip().splitlines():
        ident, names, versions, address = line.split("|")
        versions = [] if versions == "-" else versions.split(",")
        tag = " ".join(re.findall(r"[a-z]+|[0-9]+", ident.lower())) if not ident.startswith(("0", "X1", "W3", "CC0")) else ident.lower()
        for v in versions:
            full = f"{ident}-{v}"
            rules.append(_rule(full, "spdx license identifier", rf"spdx license identifier {tag} {_version(v)}(?: only| or later)?", 100, 0.99))
            for name in names.split(","):
                rules.append(_rule(full, name, rf"{name}(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?{_version(v)}", 90, 0.95))
            rules.append(_rule(full, tag, rf"{tag} v?{_version(v)}", 65, 0.6))
        rules.append(_rule(ident, "spdx license identifier", rf"spdx license identifier {tag}", 95, 0.97))
        if address != "-":
            rules.append(_rule(ident, address, rf"(?:https? )?(?:www )?{address}(?: [0-9]+)*(?: txt| html| php)?", 85, 0.9))
        for name in names.split(","):
            rules.append(_rule(ident, name, rf"(?:licensed|released|distributed|available|covered|provided)(?: [a-z]+)? under (?:the )?(?:terms of )?(?:the )?{name}", 70, 0.9))
            rules.append(_rule(ident, name, name, 50, 0.7))
    for line in TEXTS.strip().splitlines():
        label, priority, text = line.split("|")
        rules.append(_rule(label, text, text, int(priority), 0.5 if label in ("proprietary", "public-domain") else 0.85))
    return sorted(rules, key=lambda r: (-r.priority, r.label, r.pattern.pattern))
