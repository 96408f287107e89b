"""Licence scans: stretches of a text compared to licence notices and licence texts by Dice coefficient over word bigrams.

Texts are normalised to lower-case ASCII words. Units are the lines of a text, the whole text if it has several lines, and stretches of words that begin and
end anywhere, whatever the line breaks. With n word bigrams in a unit and a in a template, Dice is 2 * common / (a + n); it can reach t only if
a * t / (2 - t) <= n <= a * (2 - t) / t. Bigrams are looked up by 64-bit hash in one table of all templates; only where enough of a template's bigrams lie
close enough together are stretches compared.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerops.llm import words as W
from ledgerops.llm.tables import slices

#: Wording of public licence notices, by short name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT-header", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TOP = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str, program: str = "This program") -> str:
    return (
        f"{program} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
        f"later version. {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for "
        f"more details. You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


#: Whole texts kept beside this module.
_WHOLE = ("Apache-2.0", "CC0-1.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0")


def _licence_texts() -> list[tuple[str, str]]:
    """Read as package data, so that they are found in a zip too; a missing one is an error."""
    folder = resources.files("ledgerops.llm") / "licence_texts"
    return [(f"{name}-text", (folder / f"{name}.txt").read_text(encoding="utf-8")) for name in _WHOLE]


#: Whole notices as they stand at the top of files, and whole licence texts; the registered SQL has the list above only.
MORE = [
    ("0BSD-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_AS_IS),
    ("AGPL-3.0-notice", _gnu("GNU Affero General Public License", "3")),
    (
        "Apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause-text", _BSD_TOP + _BSD_AS_IS),
    (
        "BSD-3-Clause-text",
        _BSD_TOP + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_AS_IS,
    ),
    ("GPL-2.0-notice", _gnu("GNU General Public License", "2")),
    ("GPL-3.0-notice", _gnu("GNU General Public License", "3")),
    (
        "ISC-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        + _ISC_AS_IS,
    ),
    ("LGPL-2.1-notice", _gnu("GNU Lesser General Public License", "2.1", "This library")),
    ("LGPL-3.0-notice", _gnu("GNU Lesser General Public License", "3")),
    (
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    ),
    (
        "MPL-2.0-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
] + _licence_texts()
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach ``threshold`` with a template of ``size`` bigrams."""
    return ceil(size * threshold / (2 - threshold) - 1e-9), floor(size * (2 - threshold) / threshold + 1e-9)


_GAP = np.ones(256, dtype=bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return W.mix(hashes[:-1] * _PAIR + hashes[1:])


@dataclass(frozen=True)
class _Form:
    """A template: its bigrams, least and most bigrams of a unit, and how often each bigram of the common table counts."""

    name: str
    size: int
    low: int
    high: int
    times: np.ndarray


def _forms(templates, threshold: float) -> tuple[np.ndarray, list[_Form]]:
    """All bigrams of all templates in ascending order of their hashes, and the templates.

    Those of ``MORE`` count a bigram as often as the template has it, as long texts repeat theirs; all others count it once.
    """
    made = []
    for name, text in templates:
        raw, bounds_ = W.text_bytes(pa.array([text]))
        start, end, _ = W.word_spans(raw, bounds_, _GAP)
        made.append((name, Counter(_pairs(W.word_hashes(raw, start, end)).tolist()), (name, text) in MORE))
    table = np.array(sorted(set().union(*(c for _, c, _ in made))), dtype=np.uint64)
    forms = []
    for name, grams, repeats in made:
        times = np.zeros(len(table), dtype=np.int32)
        at = np.searchsorted(table, np.array(list(grams), dtype=np.uint64))
        times[at] = list(grams.values()) if repeats else 1
        size = int(times.sum())
        forms.append(_Form(name, size, *bounds(size, threshold), times))
    return table, forms


def _earlier(gram: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each hit, the hit of the same bigram that lies ``times`` occurrences before it, or -1."""
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    first = np.searchsorted(g, g)
    back = np.arange(len(g)) - times[order]
    out = np.empty(len(g), dtype=np.int64)
    out[order] = np.where(back >= first, order[np.maximum(back, 0)], -1)
    return out


def _stretches(at: np.ndarray, gram: np.ndarray, form: _Form, threshold: float) -> list[tuple[int, int, float]]:
    """(first bigram, last bigram, Dice) of stretches that reach ``threshold``, none over another, from the places of a template's bigrams.

    Every stretch that reaches it is reported or overlaps one that is reported; of those that overlap, the best goes first, then the earliest and shortest. A best
    stretch begins and ends with bigrams of the template, so only these are tried.
    """
    found: list[tuple[int, int, float]] = []
    work = [(0, len(at))]
    while work:
        lo, hi = work.pop()
        p = at[lo:hi]
        least = max(form.low, 1)
        if len(p) < least:
            continue
        starts = np.flatnonzero(p[least - 1 :] - p[: len(p) - least + 1] < form.high)
        if not len(starts):
            continue
        before = _earlier(gram[lo:hi], form.times[gram[lo:hi]])
        ends = np.searchsorted(p, p[starts] + form.high)
        known: dict[int, tuple[float, int, int] | None] = {}

        def best(i: int):
            if i not in known:
                k, e = int(starts[i]), int(ends[i])
                n = p[k:e] - p[k] + 1
                dice = 2.0 * np.cumsum(before[k:e] < k) / (n + form.size)
                dice[n < form.low] = 0
                j = int(dice.argmax())
                known[i] = (float(dice[j]), k, k + j) if dice[j] >= threshold else None
            return known[i]

        i, free = 0, 0
        while i < len(starts):
            got = best(i)
            if got is None:
                i += 1
                continue
            r = i + 1  # all that begin inside the best so far are its rivals
            while r < len(starts) and starts[r] <= got[2]:
                rival = best(r)
                if rival is not None and rival[0] > got[0]:
                    got = rival
                r += 1
            dice, k, j = got
            found.append((int(p[k]), int(p[j]), dice))
            if k > starts[i]:
                work.append((lo + int(starts[i]), lo + k))
            free = j + 1
            i = int(np.searchsorted(starts, free))
            known.clear()
    return sorted(found)


def _units(columns: list[pa.Array], table: np.ndarray, forms: list[_Form], threshold: float) -> Iterator[tuple[int, int, str, float]]:
    """(row, unit_no, license, dice) of every unit and template at or above ``threshold``."""
    raw, rows = W.text_bytes(columns[1])
    start, end, first = W.word_spans(raw, rows, _GAP)
    if len(start) < 2:
        return
    hashes = _pairs(W.word_hashes(raw, start, end))
    row = np.repeat(np.arange(len(rows) - 1), np.diff(first))
    breaks = np.flatnonzero(raw == 10)
    line = np.searchsorted(breaks, start) + row  # each row begins a line
    first_line = np.searchsorted(breaks, rows[:-1]) + np.arange(len(rows) - 1)
    several = np.diff(np.searchsorted(breaks, rows)) > 0
    in_row, in_line = row[1:] == row[:-1], line[1:] == line[:-1]
    lines = len(breaks) + len(rows)
    n_line, n_row = np.bincount(line[:-1][in_line], minlength=lines), np.bincount(row[:-1][in_row], minlength=len(rows) - 1)
    slot = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    hit = np.flatnonzero((table[slot] == hashes) & in_row)
    slot = slot[hit]
    apart = max(f.high for f in forms) + 2
    for form in forms:
        own = form.times[slot] > 0
        at, gram = hit[own], slot[own]
        if not len(at):
            continue

        def common(unit: np.ndarray, n: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pairs, count = np.unique(unit[at[keep]].astype(np.int64) * len(table) + gram[keep], return_counts=True)
            units, where = np.unique(pairs // len(table), return_inverse=True)
            dice = 2.0 * np.bincount(where, np.minimum(count, form.times[pairs % len(table)]), len(units)) / (n[units] + form.size)
            fits = (n[units] >= form.low) & (n[units] <= form.high) & (dice >= threshold)
            return units[fits], dice[fits]

        matched, dice = common(line, n_line, in_line[at])
        owner = np.searchsorted(first_line, matched, side="right") - 1
        yield from zip(owner.tolist(), (matched - first_line[owner]).tolist(), [form.name] * len(owner), dice.tolist())
        whole, dice = common(row, n_row, several[row[at]])
        yield from zip(whole.tolist(), [-1] * len(whole), [form.name] * len(whole), dice.tolist())
        for a, b, d in _stretches(at + row[at].astype(np.int64) * apart, gram, form, threshold):
            r = int(np.searchsorted(first[1:] + np.arange(len(rows) - 1) * apart, a, side="right"))
            a, b = a - r * apart, b - r * apart
            if r in whole or np.searchsorted(matched, line[a]) < np.searchsorted(matched, line[b + 1], side="right"):
                continue
            yield r, -2 - (a - int(first[r])), form.name, d


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + MORE, threshold: float = THRESHOLD) -> DataFrame:
    """(id, unit_no, license, dice): every unit and template at or above ``threshold``.

    Lines count from 0; the whole text of several lines is unit -1; a stretch from word k of the text on is unit -2 - k. Of one template, stretches do not overlap,
    the best going first, and those that lie across a line or whole text already found are left to it. Null and empty texts, and units of fewer than two
    words, match nothing. Rows with equal ids are scanned each for itself.
    """
    table, forms = _forms(templates, threshold)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")

    def run(batches):
        for piece in slices(batches, 4096):
            found = list(_units(piece.columns, table, forms, threshold))
            if found:
                row, unit, name, dice = zip(*found)
                columns = [piece.column(0).take(pa.array(row)), pa.array(unit, pa.int32()), pa.array(name, pa.string()), pa.array(dice, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "unit_no", "license", "dice"])

    found = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, unit_no int, license string, dice double")
    return found.withColumnRenamed("id", id_col)


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + MORE, threshold: float = THRESHOLD) -> DataFrame:
    """(id, license, dice, n_matches, licenses) for each id with a match: the best by Dice then name, and all names.

    Ids without a match, and null ids, have no row.
    """
    hits = scan(docs, id_col, text_col, templates, threshold)
    best = F.max_by(F.struct("license", "dice"), F.struct("dice", "license"))
    out = hits.where(F.col(f"`{id_col}`").isNotNull()).groupBy(id_col).agg(best.alias("b"), F.count("*").alias("n_matches"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"))
    return out.select(id_col, "b.license", F.col("b.dice").alias("dice"), "n_matches", "licenses")


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same over the table ``documents`` for lines, whole texts and ``TEMPLATES``, in DuckDB's SQL; stretches and ``MORE`` are not in it."""
    rows = []
    for name, text in TEMPLATES:
        grams = _bigrams(text)
        low, high = bounds(len(grams), threshold)
        rows.append(f"('{name}', [{', '.join(repr(g) for g in grams)}], {low}, {high})")
    return f"""
    WITH t(license, own, low, high) AS (VALUES {', '.join(rows)}),
    u AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), CASE WHEN contains(text, chr(10)) THEN [text] ELSE [] END)) AS unit FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, string_split(trim(regexp_replace(translate(unit, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM u),
    g AS (SELECT doc_id, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS grams FROM w WHERE len(words) > 1),
    m AS (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(list_distinct(grams), own)) / (len(grams) + len(own)) AS dice
          FROM g JOIN t ON len(grams) BETWEEN low AND high)
    SELECT doc_id, arg_max(license, (dice, license)) AS license, max(dice) AS dice, count(*) AS n_matches,
           string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
    FROM m WHERE dice >= {threshold} AND doc_id IS NOT NULL GROUP BY doc_id"""
