"""License scan by sentence rules.

A paragraph's words are normalised, so that line breaks, comment marks, case,
punctuation and spelling do not matter.  From every place where a sentence may
begin, the spans up to the next ends of sentences are compared, whole, with the
known licence sentences; the longest known one is an identifier.  A sentence of
n words is known with up to n // 10 words inserted, left out or changed (not its
first), or cut short after eight words or more; it then counts as modified.
Ordered rules over the sequence of identifiers name the licences.  A licence is
modified if a sentence of its rule is, or if other words stand between them.

A sentence of the kind "this software is licensed under ..." is a known
opening, from a table made of subjects and verbs, followed by known names, from
a table made of families, versions and forms, joined by "or" or "and".
"""

from __future__ import annotations

import re
from itertools import product

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text

# Known licence sentences by identifier.  Numbers stand for any number.
SENTENCES = [
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-notice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    ("mit-asis", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mit-liable", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc-asis", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-adverts", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("bsd-asis", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("apache2-only", "you may not use this file except in compliance with the License."),
    ("apache2-copy", "You may obtain a copy of the License at"),
    ("apache2-asis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache2-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("gpl-implied", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-received", "You should have received a copy of the GNU General Public License along with this program"),
    ("zlib-asis", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("bsl-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("wtfpl", "You just DO WHAT THE FUCK YOU WANT TO."),
    ("reserved", "All rights reserved."),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("json-good", "The Software shall be used for Good, not Evil."),
    ("bsd-liable", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc-liable", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib-liable", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("zlib-notice", "This notice may not be removed or altered from any source distribution."),
    ("gpl-see", "See the GNU General Public License for more details."),
    ("gpl-see", "See the GNU Lesser General Public License for more details."),
    ("gpl-see", "See the GNU Affero General Public License for more details."),
    ("gpl-received", "You should have received a copy of the GNU Lesser General Public License along with this program"),
    ("gpl-received", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("gnu-verbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("gpl3-head", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("gpl3-freedom", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("gpl2-head", "The licenses for most software are designed to take away your freedom to share and change it."),
    ("agpl3-head", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("lgpl3-head", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("lgpl21-head", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it."),
    ("epl-use", "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("epl2-head", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")."),
    ("apache2-grant", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("unlicense-any", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

# Ordered rules; a rule matches where its identifiers follow each
# other in this order.  Longer rules stand before shorter ones.  An identifier
# ending in * is followed by the licence that the sentence itself names.
RULES = [
    ("JSON", ["mit-grant", "mit-notice", "json-good"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-adverts", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-1-Clause", ["bsd-grant", "bsd-source"]),
    ("*", ["named*", "apache2-only", "apache2-copy", "apache2-asis", "apache2-see"]),
    ("*", ["named*", "mpl-copy"]),
    ("*", ["gpl-free*", "gpl-warranty", "gpl-implied", "gpl-received"]),
    ("*", ["gpl-free*"]),
    ("*", ["named*"]),
    ("*", ["spdx*"]),
    ("Zlib", ["zlib-asis", "zlib-grant"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("GPL-3.0-only", ["gpl3-head"]),
    ("GPL-2.0-only", ["gpl2-head"]),
    ("AGPL-3.0-only", ["agpl3-head"]),
    ("LGPL-3.0-only", ["lgpl3-head"]),
    ("LGPL-2.1-only", ["lgpl21-head"]),
    ("EPL-2.0", ["epl2-head", "epl-use"]),
    ("Apache-2.0", ["apache2-grant"]),
    ("Unlicense", ["unlicense"]),
    ("WTFPL", ["wtfpl"]),
]

# Registered names of licences and the words that name them.
NAMES = {
    "MIT": ["MIT License", "MIT", "Expat License", "MIT/Expat License", "MIT style license"],
    "ISC": ["ISC License", "ISC"],
    "0BSD": ["Zero-Clause BSD License", "0BSD License", "BSD Zero Clause License"],
    "BSD-2-Clause": ["2-clause BSD License", "two-clause BSD License", "BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["3-clause BSD License", "three-clause BSD License", "BSD 3-Clause License", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "BSD-4-Clause": ["4-clause BSD License", "four-clause BSD License", "BSD 4-Clause License", "Original BSD License"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache Software License, Version 2.0", "Apache 2.0 License", "Apache 2.0", "ASL 2.0"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL version 2.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "EPL 1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "EPL 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "Common Development and Distribution License 1.0", "CDDL 1.0"],
    "EUPL-1.2": ["European Union Public License, Version 1.2", "EUPL 1.2", "EUPL version 1.2"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "Open Font License 1.1"],
    "PostgreSQL": ["PostgreSQL License"],
    "Python-2.0": ["Python Software Foundation License", "PSF License"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["Do What The Fuck You Want To Public License", "WTFPL"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons Zero 1.0", "Creative Commons Zero 1.0 Universal", "Creative Commons CC0 1.0 Universal"],
}
GNU = {"GPL": ("General Public License", "GPL"), "LGPL": ("Lesser General Public License", "Library General Public License", "LGPL"), "AGPL": ("Affero General Public License", "AGPL")}
GNU_VERSIONS = {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("3.0",)}
LATER = ("or later", "or any later version", "or later version", "or newer", "or at your option any later version")
CC_WORDS = {"BY": ("by", "attribution"), "NC": ("nc", "noncommercial", "non commercial"), "SA": ("sa", "sharealike", "share alike"), "ND": ("nd", "noderivatives", "noderivs", "no derivatives")}
CC_KINDS = (("BY",), ("BY", "SA"), ("BY", "ND"), ("BY", "NC"), ("BY", "NC", "SA"), ("BY", "NC", "ND"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_ENDS = ("", "license", "international", "international license", "public license", "international public license", "unported", "unported license", "generic", "generic license")
SUBJECTS = ("", "it is", *(f"{this}{thing} is" for this in ("this ", "") for thing in ("work", "software", "project", "file", "code", "source code", "program", "library", "package", "module", "text", "page", "article", "document", "content", "dataset", "material")))
VERBS = ("licensed", "released", "distributed", "available", "made available", "provided", "published", "offered", "free software released", "open source software released", "dual licensed")
TERMS = ("", "terms of", "terms and conditions of", "conditions of")
#: What may follow a name in the same sentence.
TAILS = ("", "license", "licenses", "at your option", "as published by free software foundation", "see license", "see license file", "see license file for details")
OPENERS = ("this source code form is subject to terms of", "subject to terms of", "this program and accompanying materials are made available under terms of")

TRIGGER = r"(?i)licen[cs]e|copyright|permission|warrant|redistribut|\bspdx|\bmpl\b|rights reserved|public domain|creative commons|\bcc[ -]?(?:by|0)|unencumbered|for good, not evil|freedom to share|redistribution|\b(?:under|by) (?:the )?(?:mit|gpl|lgpl|agpl|apache|bsd|isc|wtfpl|epl|eupl|cddl)\b"
_TRIGGER = re.compile(TRIGGER)
_WORD = re.compile(r"[A-Za-z0-9+]+(?:\.[0-9A-Za-z+]+)*")
_SPELLING = {"licence": "license", "licences": "licenses", "licenced": "licensed", "relicenced": "relicensed", "ver": "version", "v": "version", "cc0": "cc0", "sublicence": "sublicense"}
_DROPPED = {"the", "a", "an"}
#: Kinds of ends: of a paragraph, a sentence, a line.
_BREAK, _END, _SOFT = 3, 2, 1
#: Words of a known sentence that was cut short, at least.
BEGINNING = 8
#: One word of so many may differ.
TOLERANCE = 10
#: Words between two sentences of a rule that make the licence a modified one.
FOREIGN = 3
_LINK = re.compile(r"\S*(?:https?://|www\.)\S*")


def _normal(word: str) -> tuple[str, ...]:
    """Normalised words of one word: lower case, one spelling, versions without a last zero."""
    w = word.lower()
    if len(w) > 1 and w[0] == "v" and w[1].isdigit():
        return ("version", *_normal(w[1:]))
    if w[0].isdigit() and w.endswith(".0"):
        w = w[:-2]
    w = _SPELLING.get(w, w)
    return () if w in _DROPPED else (w,)


def normalise(sentence: str) -> tuple[str, ...]:
    return tuple(w for m in _WORD.finditer(sentence) for w in _normal(m.group()))


def _unnumbered(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple("#" if w[0].isdigit() else w for w in words)


def _name_table() -> dict[tuple[str, ...], str]:
    out = {normalise(form): name for name, forms in NAMES.items() for form in forms}
    for family, forms in GNU.items():
        for form, version, gnu, word in product(forms, GNU_VERSIONS[family], ("GNU ", ""), ("", "version ", "as published by the Free Software Foundation version ")):
            base = f"{gnu}{form} {word}{version}"
            for end in ("", " of the License") if word else ("",):
                out |= {normalise(base + end): f"{family}-{version}-only", normalise(base + end + " only"): f"{family}-{version}-only"}
                for either, later in product((word, word.replace("version", "either version")), LATER):
                    out[normalise(f"{gnu}{form} {either}{version}{end} {later}")] = f"{family}-{version}-or-later"
    for kind, version, end in product(CC_KINDS, CC_VERSIONS, CC_ENDS):
        for words in product(*(CC_WORDS[k] for k in kind)):
            for first in ("creative commons", "cc", "creative commons cc"):
                out[normalise(f"{first} {' '.join(words)} {version} {end}")] = f"CC-{'-'.join(kind)}-{version}"
                out[normalise(f"{first} {' '.join(words)} {end.partition(' ')[2] or end} {version}")] = f"CC-{'-'.join(kind)}-{version}"
    return out


def _opening_table() -> set[tuple[str, ...]]:
    made = {normalise(f"{s} {v} under {t}") for s, v, t in product(SUBJECTS, VERBS, TERMS)}
    return made | {normalise(x) for x in OPENERS}


_NAMES, _OPENINGS = _name_table(), _opening_table()
_TAILS = {normalise(x) for x in TAILS}
_LONGEST_NAME = max(map(len, _NAMES))
_OPENING_SIZES = sorted({len(x) for x in _OPENINGS}, reverse=True)
_WHOLE = {_unnumbered(normalise(text)): name for name, text in SENTENCES}
_CUT = {k[:size]: (name, len(k) - size) for k, name in reversed(_WHOLE.items()) for size in range(BEGINNING, len(k))}
_SIZED: dict[int, list] = {}  # known sentences by the lengths that they can have with words changed
for _k, _name in _WHOLE.items():
    for _n in range(len(_k) - len(_k) // TOLERANCE, len(_k) + len(_k) // TOLERANCE + 1):
        _SIZED.setdefault(_n, []).append((_k, frozenset(_k), _name))
_REGISTERED = {x.lower(): x for x in (*_NAMES.values(), *NAMES)}
_REGISTERED |= {x.lower().removesuffix("-only"): x for x in _NAMES.values() if x.endswith("-only")}  # names of older lists
_REGISTERED |= {x.lower().removesuffix("-or-later") + "+": x for x in _NAMES.values() if x.endswith("-or-later")}
_GNU_NAMES = {_unnumbered(normalise("GNU " + form)): family for family, forms in GNU.items() for form in forms}
_FREE = normalise("free software you can redistribute it and or modify it under the terms of the")
_ENDORSE = normalise("may be used to endorse or promote products derived from this software without specific prior written permission")
MOST_WORDS = max(max(_SIZED) + 1, 60)
_FIRST = {x[0] for x in (*_WHOLE, *_OPENINGS)} | {"neither", "spdx", "copyright", "c"}


def _free_software(words: tuple[str, ...]) -> str | None:
    """The licence of a notice "X is free software; you can redistribute it ... either version 2 of the License, or later"."""
    for i in range(min(8, len(words))):
        if words[i] == "is" and words[i + 1 : i + 1 + len(_FREE)] == _FREE:
            rest = words[i + 1 + len(_FREE) :]
            for size in range(2, 6):
                family = _GNU_NAMES.get(rest[:size])
                if family and "version" in rest[:16]:
                    at = rest.index("version")
                    number = rest[at + 1] if at + 1 < len(rest) else ""
                    number = number if "." in number else number + ".0"
                    if number not in GNU_VERSIONS[family]:
                        return None
                    later = any(rest[k : k + 2] == ("later", "version") for k in range(at, len(rest)))
                    return f"{family}-{number}-{'or-later' if later else 'only'}"
    return None


def _registered(expression: str) -> str:
    """An SPDX expression with its licences named as registered."""
    words = re.findall(r"[A-Za-z0-9.+-]+|[()]", expression)
    return " ".join(w.upper() if w.upper() in ("AND", "OR", "WITH") else _REGISTERED.get(w.lower(), w) for w in words).replace("( ", "(").replace(" )", ")")


def distance(a: tuple[str, ...], b: tuple[str, ...], most: int) -> int:
    """Words inserted, left out or changed between two sentences; above ``most`` any number above it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        last, row[low - 1] = row[low - 1], i if low == 1 else far  # above and to the left
        for j in range(low, high + 1):
            above = row[j] if j < i + most else far
            last, row[j] = above, min(last + (x != b[j - 1]), above + 1, row[j - 1] + 1)
        if min(row[low - 1 : high + 1]) > most:
            return far
    return row[len(b)]


def nearest_known(key: tuple[str, ...]) -> tuple[str, int] | None:
    """The known sentence with the fewest words changed, at most one in ``TOLERANCE`` of its own, the first listed of several, and their number."""
    best, found = len(key) + 1, None
    words = frozenset(key)
    for known, has, name in _SIZED.get(len(key), ()):
        most = min(len(known) // TOLERANCE, best - 1)
        if len(has) - len(has & words) <= most and (d := distance(key, known, most)) <= most:
            best, found = d, (name, d)
    return found


def _named(words: tuple[str, ...], choice: bool) -> str | None:
    """The expression of one or several names, with a known tail or none; ``choice``: "and" stands between licences to choose from."""
    names, links = [], set()
    if words[:1] == ("either",):
        words = words[1:]
    while True:
        size = next((n for n in range(min(_LONGEST_NAME, len(words)), 0, -1) if words[:n] in _NAMES), 0)
        if not size:
            return None
        names.append(_NAMES[words[:size]])
        words = words[size:]
        if words in _TAILS:
            break
        link = next((x for x in (("and", "or"), ("or",), ("and",)) if words[: len(x)] == x), None)
        if not link:
            return None
        links.add(link[-1])
        words = words[len(link) :]
    if len(links) > 1:  # which of them bind first is not said
        return None
    return (" AND " if links == {"and"} and not choice else " OR ").join(dict.fromkeys(names))


def identify(words: tuple[str, ...], ends: bool = True) -> tuple[str, str | None, int, int] | None:
    """(identifier, licence that the sentence names or None, how it ends, words changed or missing) of the normalised words of a known sentence, or None.

    A whole sentence may end with any line, a notice ends with its first
    sentence and a copyright line with its line.  ``ends``: the words go on to
    the end of a sentence, so modified ones are compared too.
    """
    if words and (words[0].isdigit() or len(words[0]) == 1 and words[0] != "c"):  # numbers of a list
        words = words[1:]
    if not words:
        return None
    key = _unnumbered(words)
    if name := _WHOLE.get(key):
        return name, None, 0, 0
    for size in _OPENING_SIZES:
        if words[:size] in _OPENINGS and (licence := _named(words[size:], "dual" in words[:size])):
            return "named", licence, 0, 0
    if words[0] == "neither" and words[-len(_ENDORSE) :] == _ENDORSE:
        return "bsd-endorse", None, 0, 0
    if words[0] in ("copyright", "c") and any(len(w) == 4 and w.isdigit() for w in words[1:4]):
        return "copyright", None, _SOFT, 0
    if not ends:
        return None
    if licence := _free_software(words):
        return "gpl-free", licence, _END, 0
    other = nearest_known(key) or _CUT.get(key)
    return (other[0], None, 0, other[1]) if other else None


_MARKS = re.compile(r"[.;:!?](?:\s|[\"')\]]|$)")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+ ()-]*[A-Za-z0-9.+)])", re.I)


def _gap(text: str) -> int:
    """What lies between two words: a paragraph's end, a sentence's end, a line's end or nothing."""
    lines = text.count("\n")
    return _BREAK if lines > 1 else _END if _MARKS.search(text) else _SOFT if lines else 0


def paragraphs(text: str):
    """(start, end) of the paragraphs, parted by blank lines, that hold a legal word."""
    last = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < last:
            continue
        start = text.rfind("\n\n", 0, m.start())
        start = 0 if start < 0 else start + 2
        last = text.find("\n\n", m.end())
        last = len(text) if last < 0 else last
        yield start, last


def _subject(words: tuple[str, ...], after: list[int], i: int) -> bool:
    """Whether some words and "is" stand in one line."""
    for k in range(i + 1, min(i + 8, len(words))):
        if after[k - 1]:
            return False
        if words[k] == "is":
            return True
    return False


def _known(text: str, offset: int):
    """Known sentences of a paragraph as (identifier, licence, start, end, words changed), and how many others look legal."""
    words, place, stop = [], [], []  # normalised words, their token; kind of end after each
    spans = []
    for m in _WORD.finditer(text):
        if spans:
            stop.append(_gap(text[spans[-1][1] : m.start()]))
        for w in _normal(m.group()):
            words.append(w)
            place.append(len(spans))
        spans.append(m.span())
    if not spans:
        return [], 0
    stop.append(_BREAK)
    last_of = [i + 1 == len(place) or place[i + 1] != place[i] for i in range(len(place))]
    # the gap after a word also counts the gaps of dropped words that follow it
    after = []
    for i in range(len(words)):
        if not last_of[i]:
            after.append(0)
            continue
        until = place[i + 1] if i + 1 < len(words) else len(spans)
        after.append(max(stop[place[i] : until]))
    spdx = [(m.start(), m.end(), _registered(m.group(1))) for m in _SPDX.finditer(text)]
    found, i, covered = [], 0, -1
    sentence_known, unknown, sentence_start = False, 0, 0
    every = tuple(words)
    while i < len(words):
        begins = i == 0 or after[i - 1]
        got = None
        if begins and i >= covered:
            at = spans[place[i]][0]
            inside = next((x for x in spdx if x[0] <= at < x[1]), None)
            if inside:
                j = i
                while j < len(words) and spans[place[j]][0] < inside[1]:
                    j += 1
                got = (("spdx", inside[2], 0), j)
            elif every[i] in _FIRST or every[i].isdigit() or len(every[i]) == 1 or _subject(every, after, i):
                for j in range(i + 1, min(len(words), i + MOST_WORDS) + 1):
                    if after[j - 1]:
                        hit = identify(every[i:j], after[j - 1] >= _END)
                        # a whole sentence goes before a changed one, unless only a line ends with it
                        firm = got and not got[0][2] and after[got[1] - 1] >= _END
                        if hit and (not got or not hit[3] and not hit[2] or hit[3] and not firm and (not got[0][2] or hit[3] < got[0][2])):
                            got = ((hit[0], hit[1], hit[3]), j)
                        if hit and hit[2]:
                            break
                        if after[j - 1] == _BREAK:
                            break
        if got:
            (name, licence, changed), covered = got
            found.append((name, licence, offset + spans[place[i]][0], offset + spans[place[covered - 1]][1], changed))
            sentence_known = True
        if after[i] >= _END or i + 1 == len(words):
            if not sentence_known and i >= covered and _TRIGGER.search(text, spans[place[sentence_start]][0], spans[place[i]][1]):
                unknown += 1
            sentence_start, sentence_known = i + 1, i + 1 < covered
        i += 1
    return found, unknown


def _matches(known: list[tuple[str, str | None]]):
    """(licence, places of its sentences) of the rules that a sequence of identifiers meets; one pass for each rule, each identifier is used once."""
    free = [True] * len(known)
    for licence, order in RULES:
        state, used = 0, []
        for i, (name, own) in enumerate(known):
            want = order[state]
            if free[i] and name == want.removesuffix("*") and (own or not want.endswith("*")):
                used.append(i)
                state += 1
                if state == len(order):
                    yield known[used[0]][1] if licence == "*" else licence, used
                    for u in used:
                        free[u] = False
                    state, used = 0, []


def match_rules(known: list[tuple[str, str | None]]) -> list[str]:
    """Sorted licences that the rules find in a sequence of identifiers."""
    return sorted({licence for licence, _ in _matches(known)})


def inspect(text: str):
    """Licences, known sentence identifiers, their spans in characters, the number of unknown legal sentences, and the modified licences."""
    known, unknown = [], 0
    for start, end in paragraphs(text):
        found, other = _known(text[start:end], start)
        known += found
        unknown += other
    # whether other words stand before a known sentence, behind the one before it; sums tell it for any two of them
    foreign = [0]
    for a, b in zip(known, known[1:]):
        between = text[a[3] : b[2]]
        foreign.append(foreign[-1] + (len(between) > FOREIGN and len(normalise(_LINK.sub(" ", between))) >= FOREIGN))
    names, modified = set(), set()
    for licence, used in _matches([k[:2] for k in known]):
        names.add(licence)
        if any(known[u][4] for u in used) or foreign[used[-1]] > foreign[used[0]]:
            modified.add(licence)
    return sorted(names), [k[0] for k in known], [k[2:4] for k in known], unknown, sorted(modified)


def scan(text: str):
    """Licences, known sentence identifiers, their spans in characters, and the number of unknown legal sentences."""
    return inspect(text)[:4]


SCHEMA = "doc_id long, licences array<string>, sentences array<string>, span_starts array<long>, span_ends array<long>, n_unknown long, modified array<string>"


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document that holds a known licence sentence.

    Columns: doc_id, licences (sorted registered names), sentences
    (identifiers in text order), span_starts and span_ends (characters),
    n_unknown (sentences that look legal but are unknown), modified (licences
    whose sentences are changed, cut short or parted by other words).  Null and empty
    texts give no row; repeated rows give a row each; a null doc_id is kept;
    extra columns are ignored; an empty table gives an empty table.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("licences", pa.list_(pa.string())), ("sentences", pa.list_(pa.string())), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64())), ("n_unknown", pa.int64()), ("modified", pa.list_(pa.string()))])

    def run(batches):
        for b in _text.pieces(batches):
            b = b.filter(pc.fill_null(pc.match_substring_regex(b.column("text"), TRIGGER), False))
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                names, ids, spans, unknown, modified = inspect(text)
                if ids:
                    rows.append((i, names, ids, [s for s, _ in spans], [e for _, e in spans], unknown, modified))
            if rows:
                yield _text.batch_of(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
