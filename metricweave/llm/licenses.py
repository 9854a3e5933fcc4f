"""Licence scans: text compared with licence templates by word bigrams.

A text is compared with a template by the Dice coefficient of their word bigrams,
repeats counted, in two ways. Every run of as many bigrams as the template has is a
window, wherever its words stand: a licence over several paragraphs or wrapped lines
inside a long document is found so. And each text is cut into units (lines, sentences
of a line, paragraphs, the whole text), which may be shorter or longer than the template.

A coefficient of at least ``t`` is only possible while the smaller of the two has at
least ``t / (2 - t)`` bigrams of the larger, so the templates, sorted by size, are pruned
by bisection before a unit is compared, and templates longer than the text before a
window is. Of the windows only those that begin with a bigram of the template are
formed, one from the other: any other shares no more than the next of these.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame

from metricweave.llm.arrow import append_columns

THRESHOLD = 0.8

_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Licence notices and texts, fixed values.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
        "(at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "BSD-2-Clause": (
        f"{_BSD_GRANT} {_BSD_DISCLAIMER}",
        _BSD_GRANT,
        "Use of this source code is governed by a BSD-style license.",
    ),
    "BSD-3-Clause": (
        f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_DISCLAIMER}",
        f"{_BSD_GRANT} {_BSD_NAMES}",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "all-rights-reserved": ("All rights reserved.",),
}

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")


def normal_words(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def units(text: str) -> Iterator[str]:
    """The whole text, its paragraphs, lines and sentences, each different text once."""
    parts = {text}
    for paragraph in _PARAGRAPH.split(text):
        parts.add(paragraph)
        for line in paragraph.split("\n"):
            parts.add(line)
            parts.update(_SENTENCE.split(line))
    return iter(parts)


class Templates:
    """Templates sorted by size, with their bigrams."""

    def __init__(self, texts: Mapping[str, tuple[str, ...]], threshold: float):
        self.threshold = threshold
        made = [(bigrams(normal_words(text)), name) for name, own in texts.items() for text in own]
        self.sized = sorted(((sum(b.values()), name, b) for b, name in made), key=lambda x: x[:2])
        self.sizes = [size for size, _, _ in self.sized]
        #: templates that hold a bigram
        self.known: dict[tuple[str, str], list[int]] = {}
        for k, (_, _, own) in enumerate(self.sized):
            for pair in own:
                self.known.setdefault(pair, []).append(k)
        bound = threshold / (2 - threshold)
        self.least, self.most = min(self.sizes) * bound, max(self.sizes) / bound
        self.bound = bound

    def scores(self, text: str) -> dict[str, float]:
        """The best coefficient per licence, of all windows and units, where it reaches the threshold."""
        best: dict[str, float] = {}
        words = normal_words(text)
        pairs = list(zip(words, words[1:]))
        places: dict[int, list[int]] = {}
        for i, pair in enumerate(pairs):
            for k in self.known.get(pair, ()):
                places.setdefault(k, []).append(i)
        if not places:
            return best
        for k, own in places.items():
            total, name, _ = self.sized[k]
            if total <= len(pairs) and len(own) >= self.threshold * total:
                self._better(best, name, self._best_window(pairs, own, k) / total)
        for unit in units(text):
            words = normal_words(unit)
            size = len(words) - 1
            if not self.least <= size <= self.most:
                continue
            own_pairs = None
            first = bisect_left(self.sizes, size * self.bound)
            for k in range(first, bisect_right(self.sizes, size / self.bound)):
                if k in places:
                    own_pairs = own_pairs or bigrams(words)
                    total, name, theirs = self.sized[k]
                    shared = sum(min(n, own_pairs[pair]) for pair, n in theirs.items() if pair in own_pairs)
                    self._better(best, name, 2 * shared / (size + total))
        return best

    def _better(self, best: dict[str, float], name: str, score: float) -> None:
        if score >= self.threshold:
            best[name] = max(score, best.get(name, 0.0))

    def _best_window(self, pairs: list[tuple[str, str]], places: list[int], k: int) -> int:
        """The most bigrams that a window of the template's size shares with it; ``places`` are those it knows."""
        size, _, theirs = self.sized[k]
        inside: Counter = Counter()
        shared = most = begin = end = 0
        for place in places:
            start = min(place, len(pairs) - size)
            while end < len(places) and places[end] < start + size:
                pair = pairs[places[end]]
                inside[pair] += 1
                shared += inside[pair] <= theirs[pair]
                end += 1
            while places[begin] < start:
                pair = pairs[places[begin]]
                shared -= inside[pair] <= theirs[pair]
                inside[pair] -= 1
                begin += 1
            most = max(most, shared)
        return most


def scan_licenses(
    df: DataFrame,
    text: str = "text",
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Append ``licenses``: ``array<struct<license, score>>`` by name, each licence once.

    The score is that of the best window or unit. Whole texts are scanned, without a shuffle. A null or empty text has no
    licence; no row is dropped or repeated, an empty table gives an empty table,
    an input column named ``licenses`` is replaced. Templates are configuration
    and must have at least two words.
    """
    made: list[Templates] = []

    def scan(texts: list[bytes]) -> list[list]:
        if not made:
            made.append(Templates(templates, threshold))
        found = [made[0].scores(t.decode("utf-8", "replace")) for t in texts]
        return [[[{"license": name, "score": score} for name, score in sorted(own.items())] for own in found]]

    return append_columns(df, text, "licenses array<struct<license: string, score: double>>", scan)
