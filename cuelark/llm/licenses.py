"""License scans by MinHash bands over overlapping text windows, verified by exact shingle containment.

A template of n five-word shingles, of any length, belongs to the window class of the least width w >= n out of
1, 2, 3, 4, 6, 8, 12, .. (two and three times the powers of two, without end). Windows of class w hold w + w/4 shingles and start every w/4 (at least 1), so every stretch of w
shingles lies whole in one of them. A window that holds a share CONTAINMENT of a template
of more than w' shingles (w' the next smaller width) has at least the resemblance `floor_of(w)`; the number
of bands of ROWS rows is then the least for which the chance of a shared band is at least CERTAIN.
Retrieved windows are verified exactly: at least CONTAINMENT of the template's distinct shingles lie in
the window. Words compare without case and ASCII punctuation. Versions of one license resemble each other, so every finding says
whether it is the `best`: no template found in an overlapping window is held to a larger share.

TEMPLATES holds short notices and headers, and the full texts of the short licenses. `read_templates` adds any folder of license
texts, such as a system's own; the scan has no limit on their length or number.

Defined results: null and empty texts hold no license; texts of any length are scanned whole; a text that holds
a template several times gives it once, with its best containment and the first window that has it;
repeated rows each give their rows; an empty table gives no rows. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .decontam import item_words, shingles

K = 5
CONTAINMENT = 0.8
CERTAIN = 0.9999
ROWS = 1

#: Names of licenses and the notices that grant them, as their stewards publish them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-full": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-full": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


_MIT_TERMS = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
TEMPLATES |= {
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "MIT": TEMPLATES["MIT-grant"] + " " + _MIT_TERMS,
    "BSD-2-Clause": " ".join([TEMPLATES["BSD-grant"], _BSD_TWO, _BSD_END]),
    "BSD-3-Clause": " ".join([TEMPLATES["BSD-grant"], _BSD_TWO, _BSD_THIRD, _BSD_END]),
    "ISC": TEMPLATES["ISC-grant"] + " " + _ISC_END,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
}


def read_templates(folder: str) -> dict[str, str]:
    """TEMPLATES and every text file of a folder on the driver, named by its file name: full texts of any length."""
    out = dict(TEMPLATES)
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out[name] = f.read()
    return out


def widths() -> Iterator[int]:
    yield 1
    w = 2
    while True:
        yield w
        yield w * 3 // 2
        w *= 2


def width_of(n: int) -> int:
    """The class of a template of n shingles."""
    return next(w for w in widths() if w >= n)


def floor_of(width: int) -> float:
    """The least resemblance of a class-w window to a template it holds to CONTAINMENT."""
    smaller = max((w for w in takewhile(lambda x: x < width, widths())), default=0) + 1
    window = width + max(1, width // 4) if width > 1 else 1
    inside = math.ceil(CONTAINMENT * smaller - 1e-9)
    return inside / (window + smaller - inside)


def bands_for(resemblance: float, rows: int = ROWS, certain: float = CERTAIN) -> int:
    if resemblance >= 1:
        return 1
    return math.ceil(math.log(1 - certain) / math.log1p(-(resemblance**rows)))


_BANDS = max(bands_for(floor_of(w)) for w in takewhile(lambda x: x < 1 << 20, widths()))
_ODD = np.random.Generator(np.random.PCG64(10)).integers(1, 2**62, _BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Templates:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = sorted(templates)
        self.words = item_words([templates[n] for n in self.names])
        self.sets = [np.unique(shingles(w)) for w in self.words]
        self.classes: dict[tuple[int, int], list[int]] = {}  # (words of a shingle, width) -> templates
        for t, (w, s) in enumerate(zip(self.words, self.sets, strict=True)):
            if len(w):
                self.classes.setdefault((min(K, len(w)), width_of(len(s))), []).append(t)
        self.tables = {}
        for key, own in self.classes.items():
            bands = bands_for(floor_of(key[1]))
            for band in range(bands):
                mins = [self._band(np.array([(self.sets[t] * _ODD[band * ROWS + r]).min() for r in range(ROWS)], np.uint64)) for t in own]
                order = np.argsort(mins)
                self.tables[key, band] = np.array(mins, np.uint64)[order], np.array(own)[order]

    @staticmethod
    def _band(mins: np.ndarray) -> np.ndarray:
        out = np.zeros(mins.shape[1:], np.uint64)
        for m in mins:
            out = W.mix(out + m)
        return out

    def scan(self, s: W.Slice) -> list[list[dict]]:
        words, out = W.hash_words(s), [dict() for _ in range(s.n)]
        for k in sorted({k for k, _ in self.classes}):
            gram, at = W.grams(words, k)
            if not len(gram):
                continue
            text = words.text_of()[at]
            wanted = np.unique(np.concatenate([self.sets[t] for key, own in self.classes.items() if key[0] == k for t in own]))
            # windows that share no shingle with any template share no band: only stretches near a known shingle are hashed
            place = np.minimum(np.searchsorted(wanted, gram), len(wanted) - 1)
            known = np.flatnonzero(wanted[place] == gram)
            if not len(known):
                continue
            first = np.searchsorted(text, text[known])  # the text's first shingle
            last = np.searchsorted(text, text[known], "right")
            for key, own in self.classes.items():
                if key[0] == k:
                    self._windows(key, gram, at - words.bounds[:-1][text], text, known, first, last, out)
        return [[v | {"best": not any(x["containment"] > v["containment"] and x["first_word"] < v["end_word"] and v["first_word"] < x["end_word"] for x in o.values())} for _, v in sorted(o.items())] for o in out]

    def _windows(self, key, gram, at, text, known, first, last, out) -> None:
        width = key[1]
        step = max(1, width // 4)
        size = width + step if width > 1 else 1
        local = known - first
        lo, hi = np.maximum(0, -(-(local - size + 1) // step)), local // step
        starts = np.unique(np.concatenate([first + np.minimum(lo + j, hi) * step for j in range(int((hi - lo).max()) + 1)]))
        ends = np.minimum(starts + size, np.searchsorted(text, text[starts], "right"))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            window = gram[a:b]
            found = set()
            for band in range(bands_for(floor_of(width))):
                keys, owners = self.tables[key, band]
                own = self._band(np.array([(window * _ODD[band * ROWS + r]).min() for r in range(ROWS)], np.uint64))
                i = int(np.searchsorted(keys, own))
                while i < len(keys) and keys[i] == own:
                    found.add(int(owners[i]))
                    i += 1
            for t in found:
                share = float(np.isin(self.sets[t], window).mean())
                if share >= CONTAINMENT - 1e-12:
                    place, name = out[text[a]], self.names[t]
                    if name not in place or share > place[name]["containment"]:
                        place[name] = {"license": name, "containment": share, "first_word": int(at[a]), "end_word": int(at[b - 1]) + key[0]}


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("best", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("best", pa.bool_())]))


def with_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, name: str = "licenses") -> DataFrame:
    """docs with the array of licenses found in `text` added."""
    held = Templates(templates)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([row for s in W.normal_slices(texts) for row in held.scan(s)], _ARROW)

    return docs.select("*", F.arrow_udf(run, FOUND)(F.col("text")).alias(name))
