"""License scan: normalised text compared with licence templates by the Dice coefficient over word bigrams.

Templates are the licence texts in `license_texts`, their standard headers, SPDX tags and short notices. Compared with each are the whole
text, each line, and the windows of words of the whole text (line ends are spaces to them), so a notice may be wrapped or stand inside a paragraph.
With a bigrams on one side, Dice d or more needs between a d / (2 - d) and a (2 - d) / d on the other. A window has as many words as the
template at least: a shorter one would leave out the very word that tells two licences apart. Normalising lower-cases and takes words of letters, digits and
inner dots. A text of one word has that word as its only "bigram".

Defined results: null, empty and wordless texts match nothing (license null, dice 0, no matches). The best match is one of a named licence if there is any
("All rights reserved" stands in open licences too), then that of the largest coefficient, then the earliest line (the whole text is line -1, and comes first),
then the name of the license. A window counts as the line where it starts, and only if it is better than what its license has by lines.
Columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import regex
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import append_struct, text_or_empty

RESULTS = ["license", "dice", "matches"]

_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3}"
_LATER = "either version {} of the License, or (at your option) any later version."

#: Short notices and standard headers by which texts name their license.
NOTICES = {
    "MIT": ["Released under the MIT License.", "This software is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0",
        _GNU.format("program", ";", "General Public License", "; " + _LATER.format(2)),
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
        _GNU.format("program", ":", "General Public License", ", " + _LATER.format(3)),
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1",
        _GNU.format("library", ";", "Lesser General Public License", "; " + _LATER.format(2.1)),
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0",
        _GNU.format("library", ":", "Lesser General Public License", ", " + _LATER.format(3)),
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0",
        _GNU.format("program", ":", "Affero General Public License", ", " + _LATER.format(3)),
    ],
    "BSD-2-Clause": ["Licensed under the 2-Clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "ISC": ["Released under the ISC License.", "This software is licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "Unlicense": ["Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "Zlib": ["Released under the zlib License.", "SPDX-License-Identifier: Zlib"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved."],
}

#: Notices and whole licence texts by license.
TEMPLATES = {n: list(t) for n, t in NOTICES.items()}
for _file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    TEMPLATES[_file.stem].append(_file.read_text())

#: Bounds are products of floating numbers: a size just at a bound must not fall out by their last bits.
_SLACK = 1e-9
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*")
_kind = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("matches", pa.list_(pa.struct([("license", pa.string()), ("line", pa.int64()), ("dice", pa.float64())])))])


def bigrams(text: str) -> frozenset[tuple[str, ...]]:
    words = _WORD.findall(text.lower())
    return frozenset(zip(words, words[1:], strict=False)) if len(words) != 1 else frozenset([(words[0],)])


class _Known:
    """Templates by number: name, bigrams and bigram places; and the templates of each bigram."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.sets, self.places, self.of = [], [], [], {}
        for name in sorted(templates):
            for text in templates[name]:
                own = bigrams(text)
                if own:
                    for b in own:
                        self.of.setdefault(b, []).append(len(self.names))
                    self.names.append(name)
                    self.sets.append(own)
                    self.places.append(max(len(_WORD.findall(text.lower())) - 1, 1))


def _windows(pairs: list[tuple[str, str]], hits: list[int], size: int, places: int, least: float) -> Iterator[tuple[int, float]]:
    """(first place, Dice) of the best window at each start that can be best. hits: places of bigrams of a template of `size` different
    bigrams at `places` places. A longer window than the template ends, and one at least as long starts, at a hit; else it could be cut to a better one."""
    most = int(places * (2 - least) / least + _SLACK)
    seen: dict = {}
    before = np.empty(len(pairs), np.int64)  # the place of the same bigram before
    for i, b in enumerate(pairs):
        before[i] = seen.get(b, -1)
        seen[b] = i
    hit = np.zeros(len(pairs), bool)
    hit[hits] = True
    at = np.asarray(hits)
    starts = np.unique(np.concatenate((at, at - places + 1)))
    starts = starts[(starts >= 0) & (starts <= len(pairs) - places)]
    total = np.concatenate(([0], np.cumsum(hit)))
    ends = np.minimum(starts + most, len(pairs))
    starts = starts[total[ends] - total[starts] >= least * size / (2 - least) - _SLACK]
    for i in starts.tolist():
        new = before[i : i + most] < i
        own, common = np.cumsum(new), np.cumsum(new & hit[i : i + most])
        dice = 2 * common[places - 1 :] / (own[places - 1 :] + size)
        yield i, float(dice.max())


def _match(text: str, known: _Known, least: float) -> dict:
    lines = [_WORD.findall(line) for line in text.lower().split("\n")]
    words = [w for line in lines for w in line]
    pairs = list(zip(words, words[1:], strict=False))
    of = known.of
    hits = [i for i, b in enumerate(pairs) if b in of]
    best: dict[tuple[str, int], float] = {}
    first = [0, *accumulate(map(len, lines))]  # of each line among the words
    if hits or len(words) < 2 or any(len(line) == 1 and (line[0],) in of for line in lines):
        for at, line in [(-1, words), *enumerate(lines)] if len(lines) > 1 else [(-1, words)]:
            own = frozenset(zip(line, line[1:], strict=False)) if len(line) != 1 else frozenset([(line[0],)])
            for k in {k for b in own for k in of.get(b, ())}:
                t = known.sets[k]
                if len(t) * least <= len(own) * (2 - least) + _SLACK and len(own) * least <= len(t) * (2 - least) + _SLACK:
                    dice = 2 * len(own & t) / (len(own) + len(t))
                    if dice >= least:
                        key = known.names[k], at
                        best[key] = max(dice, best.get(key, 0.0))
    by_template: dict[int, list[int]] = {}
    for i in hits:
        for k in of[pairs[i]]:
            by_template.setdefault(k, []).append(i)
    top: dict[str, float] = {}
    for (name, _), d in best.items():
        top[name] = max(d, top.get(name, 0.0))
    inside: dict[str, tuple[float, int]] = {}
    for k, at in by_template.items():
        name, size = known.names[k], len(known.sets[k])
        if len(at) * (2 - least) < size * least - _SLACK or top.get(name, 0.0) >= 1:
            continue
        for i, dice in _windows(pairs, at, size, known.places[k], least):
            if dice >= least and dice > top.get(name, 0.0):
                inside[name] = min(inside.get(name, (0.0, 0)), (-dice, i))
    for name, (dice, i) in inside.items():
        line = int(np.searchsorted(first, i, "right")) - 1 if len(lines) > 1 else -1
        best[name, line] = max(-dice, best.get((name, line), 0.0))
    matches = [{"license": n, "line": at, "dice": d} for (n, at), d in best.items()]
    matches.sort(key=lambda m: (m["license"] == "proprietary", -m["dice"], m["line"], m["license"]))
    return {"license": matches[0]["license"] if matches else None, "dice": matches[0]["dice"] if matches else 0.0, "matches": matches}


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8) -> DataFrame:
    """docs with license (of the best match), dice and matches (license, line, dice)."""
    chosen = templates or TEMPLATES

    @F.arrow_udf("license string, dice double, matches array<struct<license:string,line:long,dice:double>>")
    def scanned(text: pa.Array) -> pa.Array:
        known = _Known(chosen)
        return pa.array([_match(t.as_py(), known, least) for t in text], _kind)

    return append_struct(docs, scanned.asNondeterministic()(text_or_empty()), RESULTS)
