"""License scans by template-markup matching.

A template is license wording with two kinds of marked regions: `[[ ... ]]` may be
absent, and `{{a-b}}` stands for any a to b words (a copyright holder, a project
name). Each template is compiled to a token automaton; a text is given the
template's label only where all mandatory wording matches word for word. The
automaton runs outward from its anchor, the longest mandatory run, in both
directions, so that texts without the anchor cost one substring search. Whole
texts and headers run from their first mandatory word to their last, so wording
that stops early, or that has words put in, is no match; a notice after `not` is
none either.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lowered. Base
phrases are fixed word runs with a label each; the automata add labels (`tmpl:`
names) and never remove base ones.

Defined cases: null text is empty: no words, no labels, score 0. Repeated rows
are scanned one by one, an empty table gives no rows; only doc_id and text are
read, so other columns cannot clash. score is 1 where a template matches, 0.5
where only a base phrase does, else 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_BSD_FIRST = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " {{0-1}} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " {{0-1}} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
    " in the documentation and or other materials provided with the distribution"
)
_BSD_LAST = (
    "this software is provided by {{1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability"
    " and fitness for a particular purpose are disclaimed in no event shall {{1-12}} be liable for any direct indirect incidental special exemplary or consequential damages"
    " including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability"
    " whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
#: License wording with optional [[...]] and replaceable {{a-b}} regions. `-text` and `-header` templates are complete.
TEMPLATES = {
    "tmpl:apache-2.0-notice": "[[this {{0-3}} is]] licensed under the apache license version 2 0 [[the license]]",
    "tmpl:mit-notice": "[[this {{0-4}} is]] [[licensed]] [[released]] [[distributed]] under the [[terms of the]] mit license",
    "tmpl:cc-by-nc-4.0-notice": "[[this work is]] licensed under [[a]] [[the]] cc by nc 4 0 [[international]] [[license]]",
    "tmpl:cc-by-4.0-notice": "[[this work is]] licensed under [[a]] [[the]] cc by 4 0 [[international]] [[license]]",
    "tmpl:gpl-notice": "[[this {{0-3}} is]] licensed under the gnu general public license version {{1-1}}",
    "tmpl:gpl-header": (
        "this [[program]] [[file]] [[library]] is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by"
        " the free software foundation either version {{1-1}} of the license or [[at your option]] any later version"
        " [[this]] [[{{1-3}}]] is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
        " see the gnu general public license for more details"
        " [[you should have received a copy of the gnu general public license along with [[this]] {{1-3}} if not [[see]] [[http]] [[https]] [[www gnu org licenses]] [[write to the free software foundation]]]]"
    ),
    "tmpl:apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this [[file]] [[work]] [[software]] except in compliance with the license"
        " you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
        " without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license"
    ),
    "tmpl:mit-text": (
        "[[the]] [[mit]] [[license]] [[mit]] [[copyright {{0-12}}]] permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal in the software without restriction including without limitation the rights to use"
        " copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"
        " fitness for a particular purpose and noninfringement in no event shall {{1-12}} be liable for any claim damages or other liability"
        " whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "tmpl:isc-text": (
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that"
        " the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and {{1-12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall {{1-12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
        " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "tmpl:bsd-2-text": f"{_BSD_FIRST} {_BSD_LAST}",
    "tmpl:bsd-3-text": (
        f"{_BSD_FIRST} {{{{0-1}}}} neither the name of {{{{1-12}}}} nor the names of [[its]] [[their]] [[other]] contributors may be used to endorse or promote products"
        f" derived from this software without specific prior written permission {_BSD_LAST}"
    ),
    "tmpl:zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"
        " subject to the following restrictions {{0-1}} the origin of this software must not be misrepresented you must not claim that you wrote the original software"
        " if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"
        " {{0-1}} altered source versions must be plainly marked as such and must not be misrepresented as being the original software"
        " {{0-1}} this notice may not be removed or altered from any source distribution"
    ),
}

#: Words that turn a notice into its opposite right before it, and those that may stand between.
NEGATIONS, BETWEEN = {b"not", b"never", b"nor", b"neither", b"isn", b"cannot", b"t"}, {b"yet", b"been", b"being", b"longer", b"currently", b"t"}

_BYTES = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


@dataclass(frozen=True)
class Automaton:
    """States are numbers; steps[s] holds (word or None for any, next), free[s] the states reached without a word."""

    steps: tuple[tuple[tuple[bytes | None, int], ...], ...]
    free: tuple[tuple[int, ...], ...]
    final: int

    def _close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def longest(self, tokens: list[bytes], at: int, step: int) -> int | None:
        """The number of words, from `at` in direction `step`, of the longest match; None without a match."""
        states, n = self._close({0}), 0
        best = 0 if self.final in states else None
        while states and 0 <= at < len(tokens):
            word = tokens[at]
            states = self._close({t for s in states for w, t in self.steps[s] if w is None or w == word})
            n, at = n + 1, at + step
            if self.final in states:
                best = n
        return best


Item = tuple  # ("word", bytes) | ("any", least, most) | ("maybe", [items])


def parse(markup: str) -> list[Item]:
    def take(parts: list[str]) -> list[Item]:
        items: list[Item] = []
        while parts:
            p = parts.pop(0)
            if p == "]]":
                return items
            if p == "[[":
                items.append(("maybe", take(parts)))
            elif m := re.fullmatch(r"\{\{(\d+)-(\d+)\}\}", p):
                items.append(("any", int(m[1]), int(m[2])))
            else:
                items += [("word", w) for w in words(p)]
        return items

    return take(re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", markup))


def build(items: list[Item], backwards: bool = False) -> Automaton:
    steps: list[list[tuple[bytes | None, int]]] = [[]]
    free: list[list[int]] = [[]]

    def state() -> int:
        steps.append([])
        free.append([])
        return len(steps) - 1

    def chain(part: list[Item], at: int) -> int:
        for item in reversed(part) if backwards else part:
            if item[0] == "word":
                steps[at].append((item[1], to := state()))
                at = to
            elif item[0] == "any":
                end = state()
                for k in range(item[2]):
                    if k >= item[1]:
                        free[at].append(end)
                    steps[at].append((None, to := state()))
                    at = to
                free[at].append(end)
                at = end
            else:
                last = chain(item[1], at)
                free[at].append(end := state())
                free[last].append(end)
                at = end
        return at

    final = chain(items, 0)
    return Automaton(tuple(map(tuple, steps)), tuple(map(tuple, free)), final)


@dataclass(frozen=True)
class Template:
    label: str
    anchor: bytes  # words with a blank on both sides
    length: int
    before: Automaton
    after: Automaton


def compile_template(label: str, markup: str) -> Template:
    items = parse(markup)
    runs, start = [], None
    for i, item in enumerate([*items, ("end",)]):
        if item[0] == "word":
            start = i if start is None else start
        elif start is not None:
            runs.append((i - start, start))
            start = None
    if not runs:
        raise ValueError(f"{label}: a template needs mandatory wording")
    n, at = max(runs, key=lambda r: (r[0], -r[1]))
    anchor = b" " + b" ".join(i[1] for i in items[at : at + n]) + b" "
    return Template(label, anchor, n, build(items[:at], backwards=True), build(items[at + n :]))


def places(line: bytes, phrase: bytes) -> list[int]:
    """Starts, in words, of a phrase in a text of words with one blank before, between and after."""
    out, at, n, seen = [], line.find(phrase), 0, 0
    while at >= 0:
        n += line.count(b" ", seen, at)
        seen = at
        out.append(n)
        at = line.find(phrase, at + 1)
    return out


def negated(tokens: list[bytes], at: int) -> bool:
    """Whether the words before a notice deny it."""
    while at and tokens[at - 1] in BETWEEN and tokens[at - 1] not in NEGATIONS:
        at -= 1
    return at > 0 and tokens[at - 1] in NEGATIONS


def scan(text: str | None, phrases: dict[bytes, str], templates: list[Template]) -> tuple:
    tokens = words(text)
    line = b" " + b" ".join(tokens) + b" " if tokens else b""
    starts: list[int] = []
    base, more = set(), set()
    for phrase, label in phrases.items():
        if found := places(line, phrase):
            starts += found
            base.add(label)
    spans = []
    for t in templates:
        for at in places(line, t.anchor):
            back = t.before.longest(tokens, at - 1, -1)
            ahead = t.after.longest(tokens, at + t.length, 1)
            if back is not None and ahead is not None and not (t.label.endswith("-notice") and negated(tokens, at - back)):
                more.add(t.label)
                spans.append((at - back, at + t.length + ahead, t.label))
    score = 1.0 if more else 0.5 if base else 0.0
    return len(tokens), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score, ";".join(f"{a}:{b}:{x}" for a, b, x in sorted(spans))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, text: str = "text") -> DataFrame:
    """One row per row of docs: word count, base places and labels, labels with templates, score, matched word spans."""
    pick = {b" " + b" ".join(words(k)) + b" ": v for k, v in phrases.items()}
    made = [compile_template(k, v) for k, v in templates.items()]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a in range(0, batch.num_rows, 512):
                part = column.slice(a, 512)
                rows = [scan(part[i].as_py(), pick, made) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, 512), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
