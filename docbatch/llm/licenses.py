"""License scans: winnowed fingerprints pick candidates, banded alignment decides.

Templates are whole license texts, standard notices and lines.  A text is cut
into its paragraphs; the k-word grams of the paragraphs are put into an inverted
index of hash to (paragraph, place).  A document's winnowed grams look up the
index; hits on one diagonal of a paragraph make a candidate, whose words are
aligned with the paragraph inside a band around the diagonal.  Paragraphs of a
text that follow each other in the document make one passage, so that a later
part of a text is found too.  The scan reports the matched share of the template
and the words it spans; of passages that overlap the one with the most matched
words is kept, of equals the one that covers most of its template.

Short templates have to be there word by word, and a license that a line names
after "under" is taken from the longest name that fits, so that another variant
or version isn't taken for it.

With grams of 3 words and windows of 2 every common run of 4 words is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.textio import slices, split_words, window_hashes, word_hashes

GRAM, WINDOW = 3, 2
_PUNCTUATION = ".,;:!?()[]{}\"'*#/-`“”‘’<>="
SHORT, PART = 20, 8  # templates of fewer words must match whole; paragraphs of fewer words join another

# The wording of public licenses and notices.  Whole texts are in license_texts.
_FREE = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_HOPE = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
TEMPLATES = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))} | {
    f"{name}-{version}.0-notice".replace("2.1.0", "2.1"): (_FREE + "\n\n" + _HOPE).format(what, kind, version)
    for name, what, kind, versions in (("GPL", "program", "", "1 2 3"), ("LGPL", "library", "Lesser ", "2.1 3"), ("AGPL", "program", "Affero ", "3")) for version in versions.split()
} | {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice-end": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    **{f"{name}-notice-end": _HOPE.format(what, kind) for name, what, kind in (("GPL", "program", ""), ("LGPL", "library", "Lesser "), ("AGPL", "program", "Affero "))},
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}

#: Words that have to be in a passage of the template, one run of them after another: version and variant.
KEYS = {
    "GPL-1.0-notice": ("gnu general public license", "version 1"), "GPL-2.0-notice": ("gnu general public license", "version 2"), "GPL-3.0-notice": ("gnu general public license", "version 3"),
    "LGPL-2.1-notice": ("lesser general public license", "version 2.1"), "LGPL-3.0-notice": ("lesser general public license", "version 3"), "AGPL-3.0-notice": ("affero general public license", "version 3"),
    "Apache-2.0-notice": ("apache license version 2.0",), "MPL-2.0-notice": ("mozilla public license v 2.0",), "EPL-2.0-notice": ("eclipse public license 2.0",),
}


def _names() -> dict[str, str]:
    """Names that lines give licenses, to the license; a name without version gives its family."""
    out = {}

    def family(spdx: str, names: list[str], versions: str) -> None:
        out.update({n: f"{spdx}-line" for n in names})
        for v in versions.split():
            license = f"{spdx}-{v}-line"
            for w in {v, v.removesuffix(".0")}:
                for n in names:
                    out.update({f"{n} {form}": license for form in (f"version {w}", f"v{w}", f"v. {w}", w, f"License version {w}", f"License v{w}", f"License {w}")})
                    out.update({f"version {w} of the {n}": license, f"{n}v{w}": license, f"{n}-{w}": license, f"{n}-v{w}": license})
                    out.update({f"{n}{form}": license for form in (f"v{w}+", f"-{w}+", f"-{w}-only", f"-{w}-or-later")})

    gnu = lambda kind, short: [f"{g}{kind}General Public License{s}" for g in ("GNU ", "") for s in ("", f" ({short})", f" (GNU {short})")] + [short, f"GNU {short}"]
    family("GPL", gnu("", "GPL"), "1.0 2.0 3.0")
    family("LGPL", gnu("Lesser ", "LGPL") + gnu("Library ", "LGPL"), "2.0 2.1 3.0")
    family("AGPL", gnu("Affero ", "AGPL"), "1.0 3.0")
    family("Apache", ["Apache", "Apache License", "Apache Software License"], "1.0 1.1 2.0")
    family("MPL", ["MPL", "Mozilla Public License", "Mozilla Public License (MPL)"], "1.0 1.1 2.0")
    family("EPL", ["EPL", "Eclipse Public License", "Eclipse Public License (EPL)"], "1.0 2.0")
    family("BSL", ["Boost Software License", "BSL"], "1.0")
    family("Artistic", ["Artistic License"], "1.0 2.0")
    family("CC0", ["CC0", "Creative Commons Zero", "Creative Commons CC0"], "1.0")
    whole = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        long = "-".join(whole[x] for x in kind.split("-"))
        spelled = {long, long.replace("Non", "Non-").replace("Share", "Share-"), long.replace("Derivatives", "Derivs"), long.replace("-", " ")}
        family(f"CC-{kind}", [f"CC {kind}", f"CC-{kind}", f"Creative Commons {kind}", *(f"Creative Commons {x}" for x in spelled)], "1.0 2.0 2.5 3.0 4.0")
    for license, names in {
        "MIT": "MIT|MIT/X11|X11/MIT|MIT (Expat)|MIT/Expat|Expat", "MIT-0": "MIT-0|MIT No Attribution", "ISC": "ISC", "Unlicense": "Unlicense", "Zlib": "zlib",
        "BSD": "BSD|BSD-style", "BSD-2-Clause": "BSD 2-Clause|BSD-2-Clause|2-Clause BSD|Two-Clause BSD|BSD 2 Clause|Simplified BSD|FreeBSD|BSD 2-Clause \"Simplified\"",
        "BSD-3-Clause": "BSD 3-Clause|BSD-3-Clause|3-Clause BSD|Three-Clause BSD|BSD 3 Clause|New BSD|Modified BSD|Revised BSD|BSD 3-Clause \"New\" or \"Revised\"", "BSD-4-Clause": "BSD 4-Clause|BSD-4-Clause|4-Clause BSD|Original BSD",
        "0BSD": "0BSD|Zero-Clause BSD|BSD Zero Clause|BSD-0-Clause",
    }.items():
        out.update({n: f"{license}-line" for n in names.split("|")})
    return out


def _normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, lower-cased and without punctuation at its ends, and row offsets."""
    flat, offsets = split_words(column, lower=True)
    return word_hashes(flat, _PUNCTUATION), offsets


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest gram of each window, the last one of equals."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.array([int(grams.argmin())] if len(grams) else [], np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(n) + window - 1 - views.argmin(axis=1))


def _grams(words: np.ndarray) -> np.ndarray:
    if len(words) < GRAM:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return window_hashes(words, np.full(len(words), len(words)), GRAM)[: len(words) - GRAM + 1]


def _parts(text: str) -> list[str]:
    """Paragraphs; one of few words joins the longer of its neighbours."""
    out: list[str] = []
    paragraphs = re.split(r"\n\s*\n", text.strip())
    ahead = ""
    for p, after in zip(paragraphs, [*paragraphs[1:], ""], strict=True):
        p, ahead = f"{ahead} {p}".strip(), ""
        if len(p.split()) >= PART or not (out or after):
            out.append(p)
        elif out and len(out[-1].split()) > len(after.split()):
            out[-1] += " " + p
        else:
            ahead = p
    return out


class Index:
    """Inverted index of the templates; its size depends on the templates alone."""

    def __init__(self, templates: dict[str, str], keys: dict[str, tuple[str, ...]] | None = None) -> None:
        self.names = sorted(templates)
        cut = [(t, part) for t, name in enumerate(self.names) for part in _parts(templates[name])]
        self.of = [t for t, _ in cut]  # template of a part
        self.words = [_normal(pa.array([part]))[0] for _, part in cut]
        self.size, self.start = [0] * len(self.names), []  # words of a template, place of a part in it
        for t, words in zip(self.of, self.words, strict=True):
            self.start.append(self.size[t])
            self.size[t] += len(words)
        self.keys = [[_normal(pa.array([k]))[0] for k in (keys or {}).get(name, ())] for name in self.names]
        hashes, places = [], []
        for part, words in enumerate(self.words):
            grams = _grams(words)
            hashes.append(grams)  # every gram of the templates, winnowed ones of the documents
            places.append(np.column_stack([np.full(len(grams), part), np.arange(len(grams))]))
        hashes, places = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order]


class Lines:
    """The names after "under", as a tree of word hashes."""

    NOUNS = "work works project software program file library code document package content material text"
    VERBS = "licensed released distributed available made provided published dual-licensed relicensed covered"
    ARTICLES = ("the terms and conditions of the", "the terms of the", "terms of the", "the conditions of the", "the terms of", "a", "an", "the", "")

    def __init__(self) -> None:
        names = _names()
        word = lambda text: [_normal(pa.array([w]))[0][0] for w in text.split()]
        self.starts = np.array(word("under SPDX-License-Identifier"), np.uint64)
        self.ends, self.joins, self.verbs, self.nouns, self.these, self.are = ({*map(int, word(x))} for x in ("license licence licenses", "or and and/or", self.VERBS, self.NOUNS, "this these the", "is are was were"))
        self.articles = [[int(x) for x in word(a)] for a in self.ARTICLES]
        self.tree: dict = {}
        column = pa.array([*names])
        words, offsets = _normal(column)
        for license, a, b in zip(names.values(), offsets[:-1], offsets[1:], strict=True):
            node = self.tree
            for w in words[a:b].tolist():
                node = node.setdefault(w, {})
            node[None] = license

    def name(self, words: list[int], at: int) -> tuple[str, int] | None:
        """License of the longest name from word `at` on, and the place after it."""
        node, found = self.tree, None
        while at < len(words) and (node := node.get(words[at])) is not None:
            at += 1
            if None in node:
                found = node[None], at
        return found

    def scan(self, all_words: np.ndarray) -> list[tuple[str, int, int]]:
        """(license, first word, last+1 word)"""
        out = []
        for u in np.flatnonzero(np.isin(all_words, self.starts)).tolist():
            low = max(u - 12, 0)
            words = all_words[low : u + 40].tolist()
            at, first = u - low + 1, u - low
            sure = words[first] == int(self.starts[1])
            if first and words[first - 1] in self.verbs:
                first, sure = first - 1, True
                if first and words[first - 1] in self.verbs:  # made available
                    first -= 1
            if first > 2 and words[first - 1] in self.are and words[first - 2] in self.nouns and words[first - 3] in self.these:
                first -= 3
            while True:
                hits = [(h[1], h[0], at + len(a)) for a in self.articles if words[at : at + len(a)] == a and (h := self.name(words, at + len(a)))]
                if not hits:
                    break
                end, license, begin = max(hits)
                ended = end < len(words) and words[end] in self.ends
                if not sure and end - begin < 2 and not ended:
                    break  # one word alone can be something else
                out.append((license, low + first, low + end + ended))
                at = first = end + ended
                if at >= len(words) or words[at] not in self.joins:
                    break
                at = first = at + 1
        return out


@cache
def _default() -> tuple[Index, Lines]:
    return Index(TEMPLATES, KEYS), Lines()


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Matched words, first and last+1 word, of the best alignment near words[i] ~ template[i - diagonal].

    Match +2, mismatch or gap -1, local in the document and in the template.
    """
    n = len(template)
    low = diagonal - band
    width = 2 * band + 1
    best, end = (0, 0, 0), 0
    score = [(0, 0, None)] * (width + 2)  # (score, matches, first word) by offset from the band's left edge
    for i in range(n):
        new = [(0, 0, None)] * (width + 2)
        for j in range(width):
            at = low + i + j
            if not 0 <= at < len(words):
                continue
            s, m, first = score[j + 1]  # diagonal move keeps the offset
            if template[i] == words[at]:
                here = (s + 2, m + 1, at if first is None else first)
            else:
                here = (s - 1, m, first)
            up, left = score[j + 2], new[j]
            here = max(here, (up[0] - 1, *up[1:]), (left[0] - 1, *left[1:]), key=lambda x: (x[0], x[1]))
            new[j + 1] = here if here[0] > 0 else (0, 0, None)
            if here[0] > best[0]:
                best, end = here, at + 1
        score = new
    return best[1], best[2] or 0, end


def _holds(words: np.ndarray, run: np.ndarray) -> bool:
    return any(np.array_equal(words[i : i + len(run)], run) for i in np.flatnonzero(words == run[0]).tolist())


def _candidates(words: np.ndarray, index: Index, min_coverage: float) -> list[tuple[int, int, int, int]]:
    """(part, matched, first word, last+1 word) of the parts that are there."""
    grams = _grams(words)
    at = winnow(grams)
    if not len(at):
        return []
    left = np.searchsorted(index.hashes, grams[at], side="left")
    right = np.searchsorted(index.hashes, grams[at], side="right")
    tried, found = set(), []
    for i in np.flatnonzero(right > left):
        for part, place in index.places[left[i] : right[i]].tolist():
            own = index.words[part]
            n, whole = len(own), index.size[index.of[part]] < SHORT
            band = 0 if whole else max(3, n // 8)
            diagonal = int(at[i]) - place
            if any((part, d) in tried for d in range(diagonal - band // 2, diagonal + band // 2 + 1)):
                continue
            tried.add((part, diagonal))
            if diagonal >= 0 and np.array_equal(words[diagonal : diagonal + n], own):
                found.append((part, n, diagonal, diagonal + n))
                continue
            # No alignment matches a word that isn't in reach.
            reach = words[max(diagonal - band, 0) : diagonal + n + band + 1]
            if whole or np.isin(own, reach).sum() < min_coverage * n:
                continue
            matched, first, last = align(own, words, diagonal, band)
            if matched >= min_coverage * n:
                found.append((part, matched, first, last))
    return found


def scan_words(words: np.ndarray, index: Index, min_coverage: float, lines: Lines | None = None) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched, first word, last+1 word), the best of those that overlap."""
    parts: dict[int, list] = {}
    for part, matched, first, last in sorted(_candidates(words, index, min_coverage), key=lambda x: (-x[1], x[2], x[0])):
        own = parts.setdefault(index.of[part], [])
        if all(last <= f or first >= e for _, _, f, e in own):
            own.append((part, matched, first, last))
    found = []
    for t, own in parts.items():
        passages: list[list] = []
        for hit in sorted(own, key=lambda x: x[2]):
            if passages:
                before = passages[-1][-1]
                missing = index.start[hit[0]] - index.start[before[0]] - len(index.words[before[0]])
                if hit[0] > before[0] and hit[2] - before[3] <= 2 * missing + SHORT:
                    passages[-1].append(hit)
                    continue
            passages.append([hit])
        for p in passages:
            matched, first, last = sum(x[1] for x in p), p[0][2], p[-1][3]
            if all(_holds(words[first:last], k) for k in index.keys[t]):
                found.append((index.names[t], matched / index.size[t], matched, first, last))
    if lines:
        found += [(name, 1.0, last - first, first, last) for name, first, last in lines.scan(words)]
    kept: list[tuple[str, float, int, int, int]] = []
    for hit in sorted(found, key=lambda x: (-x[2], -x[1], x[3], x[0])):
        if all(hit[4] <= k[3] or hit[3] >= k[4] for k in kept):
            kept.append(hit)
    return sorted(kept, key=lambda x: x[3])


def _scan(templates: dict[str, str] | None, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, lines = (Index(templates), None) if templates else _default()
        for b in slices(batches, "text"):
            words, offsets = _normal(b.column("text"))
            out = []
            for doc_id, a, e in zip(b.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                out += [(doc_id, *hit) for hit in scan_words(words[a:e], index, min_coverage, lines)]
            if out:
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "license", "coverage", "matched", "first_word", "end_word"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8) -> DataFrame:
    """Rows (doc_id, license, coverage, matched, first_word, end_word): one per license passage of a document.

    Null and empty texts give none; each row of docs is scanned on its own, and
    an empty table gives no rows.  Words count from 0 in the whole text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(templates, min_coverage), "doc_id long, license string, coverage double, matched int, first_word int, end_word int")
