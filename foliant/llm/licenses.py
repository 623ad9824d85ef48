"""Licence scans: TF-IDF cosine of windows of licence wording to templates, SPDX identifiers, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Mapping
from importlib.resources import files as package_files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foliant.llm.common import id_field, map_texts, stage, texts_of

_GNU = {"GPL-3.0": ("General", "3"), "GPL-2.0": ("General", "2"), "LGPL-3.0": ("Lesser General", "3"), "LGPL-2.1": ("Lesser General", "2.1"),
        "AGPL-3.0": ("Affero General", "3")}
_CC = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial",
       "CC-BY-ND-4.0": "Attribution-NoDerivatives", "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike",
       "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives"}
# Short notices and standard headers of common licences; whole licences lie in licence_texts.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.", "The MIT License (MIT)", "MIT License", "Licensed under the MIT license.",
            "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This program is free software under the terms of the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "version 2 as published by the Free Software Foundation."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.", "BSD 3-Clause License",
                     "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "ISC": ["ISC License", "Licensed under the ISC license."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC0-1.0": ["CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    **{k: [f"Licensed under {k[:-4].replace('-', ' ', 1)} 4.0.",
           f"This work is licensed under a Creative Commons {name} 4.0 International License."] for k, name in _CC.items()},
}
for _name, (_kind, _version) in _GNU.items():
    _noun = "library" if _kind.startswith("Lesser") and _version == "2.1" else "program"
    TEMPLATES.setdefault(_name, []).extend([
        f"GNU {_kind} Public License Version {_version}", f"Licensed under the GNU {_kind} Public License v{_version}",
        f"This {_noun} is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind} Public License as published by "
        f"the Free Software Foundation, either version {_version} of the License, or (at your option) any later version.",
        f"This {_noun} is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind} Public License as published by "
        f"the Free Software Foundation, either version {_version} of the License, or (at your option) any later version. This {_noun} is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        f"PURPOSE. See the GNU {_kind} Public License for more details. You should have received a copy of the GNU {_kind} Public License along with "
        f"this {_noun}. If not, see <https://www.gnu.org/licenses/>."])
#: Words, any of each set, that a text needs beside its cosine to be a notice of the licence; whole licences need none.
NAMED_BY = {
    "Apache-2.0": ["apache", "2.0 2"], "MIT": ["mit"], "GPL-3.0": ["gpl gnu", "3 3.0"], "GPL-2.0": ["gpl gnu", "2 2.0"], "LGPL-3.0": ["lesser", "3 3.0"],
    "LGPL-2.1": ["lesser", "2.1"], "AGPL-3.0": ["affero", "3 3.0"], "BSD-3-Clause": ["bsd"], "BSD-2-Clause": ["bsd"], "ISC": ["isc"],
    "MPL-2.0": ["mozilla mpl", "2.0"], "CC0-1.0": ["cc0 cc waived"],
    **{k: ["4.0"] for k in _CC},
}
#: Wording that starts windows.
HINTS = (r"licen[sc]|copyright|spdx|redistribution[^A-Za-z0-9]+and[^A-Za-z0-9]+use|permission[^A-Za-z0-9]+is[^A-Za-z0-9]+hereby|"
         r"permission[^A-Za-z0-9]+to[^A-Za-z0-9]+use|free[^A-Za-z0-9]+software|creative[^A-Za-z0-9]+commons|cc0|waived[^A-Za-z0-9]+all")
#: Names of licence files.
FILE_NAMES = ["license", "licence", "copying", "unlicense"]
#: Cosine that a match needs.
LEAST_COSINE = 0.6
#: Cosine from which a match covers the matches inside it.
SURE_COSINE = 0.8
#: Templates with fewer words are compared with lines and pairs of lines only, as their words say little inside a sentence.
LEAST_WINDOW = 5
_HINT = re.compile(HINTS, re.I)
_WORD = re.compile(r"[^\W\d_]+|[0-9]+(?:\.[0-9]+)*")
_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+:-]*[A-Za-z0-9+]\)*"
_SPDX = re.compile(rf"(?i:SPDX-License-Identifier)\s*:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)")


def templates_of(templates: Mapping[str, str | Iterable[str]] | None = None) -> list[tuple[str, str, list[str]]]:
    """(licence, text, words it is named by): of the fixed values and the whole licences, or of the given texts."""
    if templates is not None:
        return [(k, text, []) for k, v in templates.items() for text in ([v] if isinstance(v, str) else v)]
    whole = [(f.name.removesuffix(".txt"), f.read_text(), []) for f in package_files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")]
    return [(k, text, NAMED_BY.get(k, [])) for k, v in TEMPLATES.items() for text in v] + sorted(whole)


def spdx_licence(text: str) -> str | None:
    """The declared licences, by SPDX identifiers: names of templates where they have one; several lines hold together."""
    known = {k.lower(): k for k in TEMPLATES}

    def name(match: re.Match) -> str:
        bare = re.sub(r"(-only|-or-later|\+)$", "", match[0], flags=re.I).lower()
        return known.get(bare, match[0])

    lines = {re.sub(r"[A-Za-z0-9][A-Za-z0-9.+:-]*", name, re.sub(r"[ \t]+", " ", m[1])) for m in _SPDX.finditer(text)}
    lines -= {"NONE", "NOASSERTION"}
    return " AND ".join(f"({x})" if " OR " in x and len(lines) > 1 else x for x in sorted(lines)) or None


class Matcher:
    """Templates as TF-IDF vectors, and the search for the window of a text that is most like one of them.

    Terms are lower-case words, numbers with their points, and pairs of neighbours.  Document frequencies
    are taken over the templates, so a file's verdict does not hang on the other files; a term that no
    template has weighs as the rarest do.
    """

    def __init__(self, templates: list[tuple[str, str, list[str]]], least: float) -> None:
        split = [[w.lower() for w in _WORD.findall(text)] for _, text, _ in templates]
        counts = [Counter(words + list(map(" ".join, zip(words, words[1:], strict=False)))) for words in split]
        df = Counter(t for c in counts for t in c)
        self.least, self.places = least, {t: i for i, t in enumerate(df)}
        self.weights = np.array([math.log((len(templates) + 1) / (n + 1)) + 1 for n in df.values()])
        self.foreign = math.log(len(templates) + 1) + 1
        self.matrix = np.zeros((len(df), len(templates)))
        for k, c in enumerate(counts):
            at = [self.places[t] for t in c]
            row = self.weights[at] * list(c.values())
            self.matrix[at, k] = row / (np.linalg.norm(row) or 1)
        self.licences = [k for k, _, _ in templates]
        self.named_by = [[{self.places.get(w, -1) for w in one.split()} for one in needs] for _, _, needs in templates]
        sizes = [len(words) for words in split]
        self.short = np.array(sizes) < LEAST_WINDOW
        self.windows: list[int] = []
        for size in sorted(set(sizes)):
            if size >= LEAST_WINDOW and (not self.windows or size > 1.1 * self.windows[-1]):
                self.windows.append(size)

    def _best(self, one: np.ndarray, two: np.ndarray, short: bool) -> tuple[float, str] | None:
        """The nearest licence of a window of words ``one`` and pairs ``two``, where it is near enough."""
        terms, counts = np.unique(np.concatenate([one, two]), return_counts=True)
        n = int(np.searchsorted(terms, len(self.weights)))
        own = counts[:n] * self.weights[terms[:n]]
        length = math.sqrt(own @ own + self.foreign**2 * float(counts[n:] @ counts[n:]))
        if not n or math.sqrt(own @ own) < self.least * length:
            return None
        cosine = own @ self.matrix[terms[:n]] / length
        if not short:
            cosine[self.short] = 0
        have = None
        for k in np.argsort(-cosine, kind="stable"):
            if round(cosine[k], 9) < self.least:
                return None
            if self.named_by[k]:
                have = have or set(terms[:n].tolist())
                if not all(have & any_of for any_of in self.named_by[k]):
                    continue
            return round(float(cosine[k]), 9), self.licences[k]
        return None

    def licence_of(self, text: str, is_licence: bool) -> tuple[float, str] | None:
        """Cosine and licence of the whole text.

        An SPDX identifier is a declaration and counts first.  Else lines with a hint, alone and with a
        neighbour, are compared, then windows of as many words as a template has, an eighth of that apart,
        all over the text where they hold a hint; of licence files the whole text too.
        """
        declared = spdx_licence(text)
        if declared:
            return 1.0, declared
        hints = [m.start() for m in _HINT.finditer(text)]
        spans = [(m.start(), m[0].lower()) for m in _WORD.finditer(text)] if hints or is_licence else []
        if not spans:
            return None
        starts, words = np.array([s for s, _ in spans]), [w for _, w in spans]
        extra: dict[str, int] = {}
        place = lambda t: self.places[t] if t in self.places else len(self.weights) + extra.setdefault(t, len(extra))
        one = np.array([place(w) for w in words], np.int64)
        two = np.array([place(f"{a} {b}") for a, b in zip(words, words[1:], strict=False)], np.int64)
        n = len(words)
        hinted = np.zeros(n + 1, np.int64)
        np.add.at(hinted, np.clip(np.searchsorted(starts, hints, side="right"), 1, n), 1)
        before = np.cumsum(hinted)
        ends = np.array([0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1])
        lines = np.unique(np.searchsorted(ends, hints, side="right") - 1)
        cut = np.unique(np.searchsorted(starts, ends))
        held = np.unique(np.searchsorted(cut, np.searchsorted(starts, ends[lines]), side="right") - 1)
        last = len(cut) - 1
        ranges = {(int(cut[a]), int(cut[b])) for k in held for a, b in ((k, k + 1), (k, k + 2), (k - 1, k + 1)) if 0 <= a and b <= last}
        if is_licence:
            ranges.add((0, n))
        found = [(self._best(one[s:e], two[s:e - 1], True), s, e) for s, e in sorted(ranges)]
        windows = set()
        for size in self.windows:
            at = np.unique(np.r_[np.arange(0, max(1, n - size + 1), max(1, size // 8)), max(0, n - size)])
            at = at[before[np.minimum(at + size, n)] > before[at]]
            windows.update((s, min(s + size, n)) for s in at.tolist())
        found += [(self._best(one[s:e], two[s:e - 1], False), s, e) for s, e in sorted(windows)]
        found = [f for f in found if f[0]]
        sure = [(s, e) for best, s, e in found if best[0] >= SURE_COSINE]
        found = [best for best, s, e in found if not any(a <= s and e <= b and e - s < b - a for a, b in sure)]
        return min(found, key=lambda f: (-f[0], f[1]), default=None)


def _own_licences(files: DataFrame, matcher: Matcher) -> DataFrame:
    """Each row (file, path, text, is_licence) with a licence of its own or none; decided where the text is read, so that no id is joined."""
    readable = F.col("text").rlike(f"(?i){HINTS}") | F.col("is_licence")
    docs = files.select(F.col("file").alias("doc_id"), F.when(readable, F.col("text")).alias("text"), "is_licence", "path",
                        (F.col("is_licence") & F.coalesce(F.trim("text") != "", F.lit(False))).alias("says"))
    schema = T.StructType([id_field(docs), docs.schema["path"], docs.schema["is_licence"], docs.schema["says"],
                           T.StructField("licence", T.StringType()), T.StructField("cosine", T.DoubleType())])
    known = files.sparkSession.sparkContext.broadcast(matcher)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(known.value.licence_of(t, whole) if t else None) or (None, None) for t, whole in zip(texts_of(batch), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), batch.column(4), pa.array([f[1] for f in found], pa.string()),
                                           pa.array([f[0] for f in found], pa.float64())], schema.names)

    return map_texts(docs, work, schema).withColumnRenamed("doc_id", "file")


def scan_licences(files: DataFrame, templates: Mapping[str, str | Iterable[str]] | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """Licence of each file (file, path, text), from itself or from the nearest directory above it.

    Whole texts are searched for SPDX identifiers, and for windows (``Matcher.licence_of``) that the
    cosine of TF-IDF weights likens to a template: a notice, a standard header or a whole licence.  A
    directory has the best match of its licence files (ties: the first name); a file without a match
    of its own takes that of its nearest directory with one.

    Null and empty texts have no match of their own; a licence file that says something else than the templates
    takes no other licence; a null path has no directories; every row is a file of its own, whether its id is
    null or repeated; an empty table gives no rows; other columns are not read.  ``origin`` is "own",
    "inherited" or null.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    is_licence = F.coalesce(F.regexp_extract(name, r"^([a-z]+)", 1).isin(FILE_NAMES), F.lit(False))
    marked = files.select("file", "path", "text", is_licence.alias("is_licence"))
    placed = stage(_own_licences(marked, Matcher(templates_of(templates), least)))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    of_folder = placed.where("is_licence and licence is not null and path is not null").groupBy(folder.alias("folder")).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best")).select("folder", F.col("best.licence").alias("from_folder"))
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folders = placed.where("licence is null and not says and path is not null").select(folder.alias("own_folder"), F.array_distinct(above).alias("above")).distinct()
    nearest = folders.select("own_folder", F.explode("above").alias("folder")).join(of_folder, "folder").groupBy("own_folder").agg(
        F.max(F.struct(F.length("folder").alias("l"), "folder", "from_folder")).alias("near"))
    nearest = nearest.select("own_folder", F.col("near.folder").alias("near_folder"), F.col("near.from_folder").alias("from_folder"))
    out = placed.withColumn("own_folder", F.when(F.col("licence").isNull() & ~F.col("says"), folder)).join(nearest, "own_folder", "left")
    return out.select("file", "path", F.coalesce("licence", "from_folder").alias("licence"), "cosine",
                      F.when(F.col("licence").isNotNull(), "own").when(F.col("from_folder").isNotNull(), "inherited").alias("origin"), "near_folder")
