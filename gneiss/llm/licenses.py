"""Licence recognition by sentence rules.

A text is cut into sentences (at marks that end one, and at line ends; a known sentence may run over
several lines). Each is normalised to words in lower case and looked up among known licence sentences, which
gives it an identifier. The sequence of identifiers, in which any other sentence leaves a break, is then
matched against rules in their order: a rule is a sequence of identifiers that must stand side by side; what
a rule has matched is used up for later rules. Copyright lines and list markers neither count nor break, and a
sentence is also known behind a list marker, as the clauses of BSD licences are.

Texts without any word that all known sentences share one of (ANCHORS, checked when the module loads) hold no
known sentence and are not cut. The scan works document by document, without a shuffle.

Results for odd input: null is the empty text; repeated rows each get their row; an empty table stays empty;
a text of any length takes time in proportion to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

# Sentences of public licence texts and notices, and what they are called here.
SENTENCES = {
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "MIT License"],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    ],
    "mit-liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "apache2-notice": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "apache2-licensed": ['Licensed under the Apache License, Version 2.0 (the "License");'],
    "apache2-use": ["you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-basis": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl-redistribute": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-redistribute": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-details": ["See the GNU General Public License for more details."],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program."],
    "cc-by-nc4-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "cc-by4-notice": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0-notice": ["This work is dedicated to the public domain under the CC0 1.0 license."],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-warranty": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'],
    "mpl2-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-warranty": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "isc-liability": ["IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "isc-notice": ["Licensed under the ISC License.", "ISC License"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-liability": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsd-liability": ["IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "bsd2-notice": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License."],
    "bsd3-notice": ["BSD 3-Clause License", "Licensed under the BSD 3-Clause License."],
    "gpl1-redistribute": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."],
    "gpl2-only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "gpl3-only": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."],
    "gpl-received-long": ["You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."],
    "gpl-see": ["If not, see <https://www.gnu.org/licenses/>.", "If not, see <http://www.gnu.org/licenses/>."],
    "agpl3-redistribute": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-details": ["See the GNU Affero General Public License for more details."],
    "agpl-received": ["You should have received a copy of the GNU Affero General Public License along with this program."],
    "lgpl2-redistribute": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "lgpl21-redistribute": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-redistribute": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl-details": ["See the GNU Lesser General Public License for more details.", "See the GNU Library General Public License for more details."],
    "gfdl-grant": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation;"],
    "epl2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "cc-by-sa4-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nd4-notice": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "apache2-title": ["Apache License Version 2.0, January 2004"],
    "gpl1-title": ["GNU GENERAL PUBLIC LICENSE Version 1, February 1989"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl2-title": ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "gfdl13-title": ["GNU Free Documentation License Version 1.3, 3 November 2008"],
    "mpl2-title": ["Mozilla Public License Version 2.0"],
    "artistic2-title": ["The Artistic License 2.0"],
    "epl2-title": ["Eclipse Public License - v 2.0"],
    "cc0-title": ["CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"],
}
#: Identifiers of the SPDX list: a line "SPDX-License-Identifier: X" is a sentence of its own.
SPDX = ("MIT", "Apache-2.0", "GPL-1.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0", "Artistic-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0")
SENTENCES |= {f"spdx-{x.lower()}": [f"SPDX-License-Identifier: {x}"] for x in SPDX}
#: Rules in order: (licence, sentences side by side). Longer evidence comes before what it contains.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-notice", "mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("Apache-2.0", ("apache2-licensed", "apache2-use", "apache2-copy", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-licensed", "apache2-use", "apache2-copy")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-hope", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-redistribute",)),
    ("GPL-3.0-only", ("gpl3-only", "gpl-hope", "gpl-details")),
    ("GPL-3.0-only", ("gpl3-only",)),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-details")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-1.0-or-later", ("gpl1-redistribute", "gpl-hope", "gpl-details")),
    ("GPL-1.0-or-later", ("gpl1-redistribute",)),
    ("AGPL-3.0-or-later", ("agpl3-redistribute", "gpl-hope", "agpl-details", "agpl-received")),
    ("AGPL-3.0-or-later", ("agpl3-redistribute", "gpl-hope", "agpl-details")),
    ("AGPL-3.0-or-later", ("agpl3-redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute", "lgpl-hope", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute",)),
    ("LGPL-2.1-or-later", ("lgpl21-redistribute", "lgpl-hope", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-redistribute",)),
    ("LGPL-2.0-or-later", ("lgpl2-redistribute", "lgpl-hope", "lgpl-details")),
    ("LGPL-2.0-or-later", ("lgpl2-redistribute",)),
    ("BSD-3-Clause", ("bsd3-notice", "bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd2-notice", "bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("ISC", ("isc-notice", "isc-grant", "isc-warranty", "isc-liability")),
    ("ISC", ("isc-grant", "isc-warranty", "isc-liability")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("GPL-3.0", ("gpl3-title", "verbatim")),
    ("GPL-2.0", ("gpl2-title", "verbatim")),
    ("GPL-1.0", ("gpl1-title", "verbatim")),
    ("LGPL-2.0", ("lgpl2-title", "verbatim")),
    ("LGPL-2.1", ("lgpl21-title", "verbatim")),
    ("LGPL-3.0", ("lgpl3-title", "verbatim")),
    ("AGPL-3.0", ("agpl3-title", "verbatim")),
    ("GFDL-1.3", ("gfdl13-title", "verbatim")),
    ("GFDL", ("gfdl-grant",)),
    *((f"{name}", (f"spdx-{name.lower()}",)) for name in SPDX),
    ("GPL-3.0", ("gpl3-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-1.0", ("gpl1-title",)),
    ("LGPL-2.0", ("lgpl2-title",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("GFDL-1.3", ("gfdl13-title",)),
    ("Apache-2.0", ("apache2-title",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("Artistic-2.0", ("artistic2-title",)),
    ("EPL-2.0", ("epl2-title",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("CC0-1.0", ("cc0-title",)),
    ("BSL-1.0", ("boost-notice",)),
    ("BSD-3-Clause", ("bsd3-notice",)),
    ("BSD-2-Clause", ("bsd2-notice",)),
    ("ISC", ("isc-notice",)),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd4-notice",)),
    ("CC-BY-4.0", ("cc-by4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
)
ANCHORS = ("license", "permission", "redistribut", "copyright", "liable", "software", "warrant", "cc by", "mpl", "gnu", "cc0")
BREAKS = re.compile(r"[^a-z0-9]+")
#: What stands before a clause of a list: 1. 12) (3) a. b) (iv) and the like, with marks of a comment before it.
MARKER = re.compile(r"[^\w(\[]*[(\[]?(?:\d{1,3}|[a-z]|[ivx]{1,4})[.):\]]+\s*", re.IGNORECASE)


def normal(sentence: str) -> str:
    return BREAKS.sub(" ", sentence.lower()).strip()


KNOWN = {normal(s): name for name, texts in SENTENCES.items() for s in texts}
BEGINNINGS = {" ".join(k.split()[:i]) for k in KNOWN for i in range(1, len(k.split()) + 1)}
if not all(any(normal(a) in k for a in ANCHORS) for k in KNOWN):
    raise ValueError("a known sentence has no anchor")


def sentences(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, words) of each piece of a text that has a word."""
    at = 0
    for m in re.finditer(r"[.!?;:]+(?=\s|$)|\n|$", text):
        words = normal(text[at : m.end()])
        if words:
            lead = len(text[at : m.end()]) - len(text[at : m.end()].lstrip())
            yield at + lead, m.end() if m[0] != "\n" else m.start(), words
        at = m.end()


def known_at(pieces: list[tuple[int, int, str]], i: int, words: str) -> tuple[int, str] | None:
    """(last piece, identifier) of the longest known sentence from piece i, whose words are given."""
    best, j = None, i
    while words in BEGINNINGS:
        if words in KNOWN:
            best = (j, KNOWN[words])
        j += 1
        if j == len(pieces):
            break
        words = f"{words} {pieces[j][2]}"
    return best


def recognised(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, identifier) in order; None marks a break. A known sentence may cover several pieces."""
    pieces = list(sentences(text))
    out: list[tuple[int, int, str | None]] = []
    i = 0
    while i < len(pieces):
        start, end, words = pieces[i]
        best = known_at(pieces, i, words)
        if not best and (marker := MARKER.match(text, start, end)):
            words = normal(text[marker.end() : end])
            if best := known_at(pieces, i, words):
                start = marker.end()
        if best:
            i, name = best
            out.append((start, pieces[i][1], name))
        elif words and not words.startswith("copyright "):
            if not out or out[-1][2] is not None:
                out.append((start, end, None))
        i += 1
    return out


def apply_rules(found: list[tuple[int, int, str | None]]) -> list[tuple[int, int, str]]:
    """(start, end, licence) of the matches, by place."""
    names = [name for _, _, name in found]
    out = []
    for licence, wanted in RULES:
        i, n = 0, len(wanted)
        while i + n <= len(names):
            if tuple(names[i : i + n]) == wanted:
                out.append((found[i][0], found[i + n - 1][1], licence))
                names[i : i + n] = [None] * n
                i += n
            else:
                i += 1
    return sorted(out)


def scan_text(text: str) -> tuple[str, str, str]:
    """(identifiers, licences, places) of a text, each comma-joined in order."""
    found = recognised(text)
    got = apply_rules(found)
    return (
        ",".join(name for _, _, name in found if name),
        ",".join(licence for _, _, licence in got),
        ",".join(f"{start}:{end}" for start, end, _ in got),
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document: doc_id, sentence_ids, licenses, spans (code points), n_licenses."""
    small_batches(docs.sparkSession)
    pattern = "|".join(ANCHORS).replace(" ", r"[^a-z0-9]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = pc.match_substring_regex(b.column(1), pattern, ignore_case=True).fill_null(False)
            texts = pc.if_else(may, b.column(1), pa.scalar("", b.column(1).type)).to_pylist()
            got = [scan_text(t) if t else ("", "", "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([g[k] for g in got], pa.string()) for k in range(3))],
                names=["doc_id", "sentence_ids", "licenses", "spans"],
            )

    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, sentence_ids string, licenses string, spans string"
    )
    return got.withColumn("n_licenses", F.when(F.col("licenses") == "", 0).otherwise(F.size(F.split("licenses", ","))).cast("long"))
