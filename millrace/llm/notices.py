"""Licences that a whole text declares: SPDX lines, header blocks and standard licence texts.

Method. Units are the single lines that hold a marker word, the paragraphs, the comments (block
comments and runs of line comments), and the whole text of licence files. Each is compared, by
the cosine of TF-IDF vectors, with :data:`STANDARD` together with the short notices of
:mod:`millrace.llm.licenses`, which stay in the running with the weights of this larger list. SPDX
lines are parsed: their expression counts as it stands, with a score of 1.

Defined cases: several SPDX lines of one text hold together (``AND``); ``-only``, ``-or-later`` and
``+`` of the GNU licences are left out of the name, as the templates' names have none; identifiers
that the list lacks stay as written.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import cache

TERM = re.compile("[a-z0-9]+")
MARKER = re.compile("licen[sc]|copyright|spdx|public domain")

_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation; {1} of the License, or (at your option) any later version."
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License version {1} as published by the Free Software Foundation."
_GNU_LINE = "This work is licensed under the GNU {0}General Public License, version {1}."
_GNU_TITLE = "GNU {0}GENERAL PUBLIC LICENSE Version {1}, {2}"
_GNUS = (
    ("GPL-2.0", "", "2", "June 1991"),
    ("GPL-3.0", "", "3", "29 June 2007"),
    ("LGPL-2.1", "Lesser ", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser ", "3", "29 June 2007"),
    ("AGPL-3.0", "Affero ", "3", "19 November 2007"),
    ("GPL-1.0", "", "1", "February 1989"),
    ("LGPL-2.0", "Library ", "2", "June 1991"),
)
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, '
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
_APACHE_END = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: Fixed values: (name, text) of standard headers, licence texts and the titles of long ones.
STANDARD = (
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_END),
    ("MIT", "The MIT License (MIT)"),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_END),
    ("BSD-3-Clause", _CONDITIONS + _SOURCE + _BINARY + _NAMES + _BSD_END),
    ("BSD-3-Clause", _NAMES),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", _CONDITIONS + _SOURCE + _BINARY + _BSD_END),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_END),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    *((name, _GNU.format(kind, f"either version {v}")) for name, kind, v, _ in _GNUS),
    *((name, _GNU_ONLY.format(kind, v)) for name, kind, v, _ in _GNUS),
    *((name, _GNU_LINE.format(kind, v)) for name, kind, v, _ in _GNUS if name not in ("GPL-2.0", "GPL-3.0", "LGPL-3.0")),
    *((name, _GNU_TITLE.format(kind, v, day)) for name, kind, v, day in _GNUS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    *((f"CC-{k}-{v}", f"Creative Commons {name} {v} International{' Public License' * p}") for v in ("4.0",) for k, name in _CC.items() for p in (0, 1)),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for k, name in _CC.items()),
    *((f"CC-{k}-3.0", f"This work is licensed under a Creative Commons {name} 3.0 Unported License.") for k, name in _CC.items()),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in _CC if k not in ("BY", "BY-SA", "BY-NC")),
    *((f"CC-{k}-3.0", f"Licensed under CC {k} 3.0.") for k in _CC),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    *((f"GFDL-{v}", f"GNU Free Documentation License Version {v}, {day}") for v, day in (("1.2", "November 2002"), ("1.3", "3 November 2008"))),
    *((f"GFDL-{v}", f"Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {v} or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.") for v in ("1.2", "1.3")),
    ("Artistic-1.0", 'The "Artistic License"'),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Anything that a declaration of one of these licences holds, in lower case; other texts are not looked at.
HINT = "licen[sc]|copyright|spdx|public domain|permission|redistribution|creative commons|attribution|prior written|cc0|free and unencumbered"

_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.:+-]*\)*"
_SPDX = re.compile(rf"SPDX-License-Identifier\s*:\s*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)", re.I)
_SHOWN = {n.lower(): n for n in [name for name, _ in STANDARD] + ["0BSD", "BSL-1.0", "Zlib", "MIT-0", "Apache-1.1", "EPL-1.0", "CDDL-1.0", "WTFPL"]}
_BLOCK = re.compile(r'/\*.*?\*/|<!--.*?-->|""".*?"""', re.S)
_LINE = re.compile(r"\s*(?://|#|;|--|%|dnl\b|rem\b|\*)", re.I)


def _named(identifier: re.Match) -> str:
    word = identifier.group()
    if word.upper() in ("AND", "OR", "WITH"):
        return word.upper()
    bare = re.sub(r"(?i)(-only|-or-later|\+)$", "", word) if re.match("(?i)[AL]?GPL-", word) else word
    return _SHOWN.get(bare.lower(), bare)


def spdx(text: str) -> str | None:
    """The expression of a text's SPDX lines, or None."""
    found = list(dict.fromkeys(re.sub(r"[A-Za-z0-9][A-Za-z0-9.:+-]*", _named, re.sub(r"\s+", " ", x.rstrip("-"))) for x in _SPDX.findall(text)))
    return " AND ".join(f"({x})" if len(found) > 1 and " OR " in x else x for x in found) or None


def units(text: str, whole: bool) -> Iterable[str]:
    """Single lines with a marker, paragraphs, comments, and all of a licence file; in lower case."""
    low = text.lower()
    found = dict.fromkeys([low] if whole else [])
    lines = low.split("\n")
    paragraph: list[str] = []
    comment: list[str] = []
    for line in [*lines, ""]:
        if MARKER.search(line):
            found[line] = None
        if TERM.search(line):
            paragraph.append(line)
        elif paragraph:
            found["\n".join(paragraph)] = None
            paragraph = []
        if _LINE.match(line):
            comment.append(line)
        elif comment:
            found["\n".join(comment)] = None
            comment = []
    found.update(dict.fromkeys(_BLOCK.findall(low)))
    return (u for u in found if re.search(HINT, u))


@cache
def _vectors(short: tuple[tuple[str, str], ...]) -> tuple[dict[str, float], float, dict[str, list[tuple[int, float]]]]:
    """Weights of terms, that of any other term, and a list of (template, share of its norm) a term."""
    counts = [Counter(TERM.findall(text.lower())) for _, text in (*short, *STANDARD)]
    seen = Counter(w for x in counts for w in x)
    n = len(counts)
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in seen.items()}
    lists: dict[str, list[tuple[int, float]]] = {}
    for i, x in enumerate(counts):
        norm = math.sqrt(sum((k * idf[w]) ** 2 for w, k in x.items()))
        for w, k in x.items():
            lists.setdefault(w, []).append((i, k * idf[w] / norm))
    return idf, math.log(1 + n) + 1, lists


def declared(text: str, whole: bool, short: tuple[tuple[str, str], ...], least: float) -> tuple[str, float] | None:
    """(licence, score) if an SPDX line or a standard template fits ``text`` best; None if a short one or none does."""
    named = spdx(text)
    if named:
        return named, 1.0
    idf, unknown, lists = _vectors(short)
    best = (0.0, 0)
    for unit in units(text, whole):
        counts = Counter(TERM.findall(unit))
        size = math.sqrt(sum((k * idf.get(w, unknown)) ** 2 for w, k in counts.items()))
        dots: dict[int, float] = {}
        for w, k in counts.items():
            for i, share in lists.get(w, ()):
                dots[i] = dots.get(i, 0.0) + k * idf[w] * share
        for i, dot in dots.items():
            best = max(best, (round(dot / size, 4), -i))
    score, at = best[0], -best[1]
    return (STANDARD[at - len(short)][0], score) if score >= least and at >= len(short) else None
