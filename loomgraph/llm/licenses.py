"""License scans by template-markup matching with token automata."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm._shared import same_text, ship
from pyspark.sql import functions as F

#: Phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_NO_WARRANTY = """THIS SOFTWARE IS PROVIDED BY <<owner:12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
    FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<owner:12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
    LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
    LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """[[ Copyright [[ (c) ]] <<holder:40>> ]] Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    [[ 1 ]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    [[ 2 ]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

#: The wording of licences and of the notices that stand for one, by label.
#: ``<<name:n>>`` stands for any 0 to n words and ``<<name>>`` for any number (replaceable
#: regions), ``[[ ... ]]`` is an optional region and may hold others, all else is mandatory.
TEMPLATES = {
    "mit": """[[ [[ The ]] MIT License [[ (MIT) ]] ]] [[ Copyright [[ (c) ]] <<holder:40>> ]] Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        [[ (including the next paragraph) ]] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<owner:12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause": f"{_BSD} {_NO_WARRANTY}",
    "bsd-3-clause": f"""{_BSD} [[ 3 ]] Neither the name of <<owner:12>> nor the names of <<owner:4>> contributors may be used to endorse or promote products derived from this software without specific
        prior written permission. {_NO_WARRANTY}""",
    "isc": """[[ ISC License ]] [[ Copyright [[ (c) ]] <<holder:40>> ]] Permission to use, copy, modify, and [[ /or ]] distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<owner:12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<owner:12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
        OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache-2.0": """[[ Copyright [[ (c) ]] <<holder:40>> ]] Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-or-later": """[[ Copyright [[ (c) ]] <<holder:40>> ]] <<program:6>> is free software [[ : ]] you can redistribute it and/or modify it under the terms of the GNU [[ Lesser ]] General Public License as
        published by the Free Software Foundation, either version <<version:2>> of the License, or (at your option) any later version. <<program:6>> is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU [[ Lesser ]] General Public License for more details.
        [[ You should have received a copy of the GNU [[ Lesser ]] General Public License along with <<program:6>> [[ If not, see [[ http ]] [[ https ]] [[ www ]] gnu.org/licenses ]] ]]""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
        as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "apache-notice": "licensed under the Apache [[ Software ]] License [[ , version ]] 2.0",
    "mit-notice": "[[ is ]] <<released:1>> under the [[ terms of the ]] MIT license",
    "gpl-notice": "licensed under the [[ terms of the ]] GNU [[ Lesser ]] [[ Affero ]] General Public License [[ [[ , ]] version <<version:2>> ]]",
    "cc-notice": "licensed under [[ a ]] [[ the ]] [[ Creative Commons ]] [[ Attribution ]] CC BY [[ NC ]] [[ SA ]] [[ ND ]] [[ <<version:2>> [[ International ]] [[ License ]] ]]",
    "reserved-notice": "copyright [[ (c) ]] <<holder:40>> all rights reserved",
}

#: Word bytes after lower-casing: 0-9, a-z and all beyond ASCII; the rest part words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Automaton:
    """A position automaton over words, run on all starts at once.

    States are places in the template; a bounded replaceable region is a chain of
    skippable any-word states, an unbounded one a state that any word keeps, an
    optional region an empty move past its end (regions nest).
    ``anchor``: the longest mandatory run of words outside both; a text without
    it can't match, and a match must cover one of its places.
    """

    def __init__(self, template: str):
        skips: dict[int, set[int]] = {}
        words: list[bytes | None] = []  # None: any word
        self.loops: set[int] = set()
        opened: list[int] = []
        runs: list[list[bytes]] = [[]]
        starts: list[int] = [0]

        def part() -> None:
            runs.append([])
            starts.append(len(words))

        for t in re.findall(r"<<\w+(?::\d+)?>>|\[\[|\]\]|(?:(?!<<|\[\[|\]\]).)+", template, re.DOTALL):
            if t == "[[":
                opened.append(len(words))
                part()
            elif t == "]]":
                if not opened:
                    raise ValueError(f"an optional region ends that was not opened: {template}")
                skips.setdefault(opened.pop(), set()).add(len(words))
                part()
            elif t.startswith("<<"):
                name, _, most = t[2:-2].partition(":")
                for _ in range(int(most) if most else 1):
                    skips.setdefault(len(words), set()).add(len(words) + 1)
                    if not most:
                        self.loops.add(len(words))
                    words.append(None)
                part()
            else:
                for w in t.encode().translate(FOLD).split():
                    words.append(w)
                    if not opened:
                        runs[-1].append(w)
        if opened:
            raise ValueError(f"an optional region is left open: {template}")
        self.words, self.skips = words, skips
        best = max(range(len(runs)), key=lambda k: len(b" ".join(runs[k])))
        self.anchor = b" ".join(runs[best])
        if not self.anchor:
            raise ValueError(f"no mandatory words: {template}")
        #: Words of a match before its anchor at most; None where a region before it has no bound.
        self.lead = None if any(k < starts[best] for k in self.loops) else starts[best]

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for k in self.skips.get(todo.pop(), ()):
                if k not in states:
                    states.add(k)
                    todo.append(k)
        return states

    def match(self, text: list[bytes], start: int) -> int:
        """The end of the longest match from ``start``, or -1; mandatory words must be met one by one."""
        states, end = self.closure({0}), -1
        if len(self.words) in states:
            end = start
        for k in range(start, len(text)):
            w, after = text[k], set()
            for s in states:
                if s < len(self.words) and (self.words[s] is None or self.words[s] == w):
                    after.add(s + 1)
                    if s in self.loops:
                        after.add(s)
            states = self.closure(after)
            if not states:
                break
            if len(self.words) in states:
                end = k + 1
        return end


def _places(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase stands in words joined (and framed) by single spaces."""
    needle = b" " + phrase + b" "
    out, at, seen, from_ = [], line.find(needle), 0, 0
    while at >= 0:
        seen += line.count(b" ", from_, at)
        from_ = at
        out.append(seen)
        at = line.find(needle, at + 1)
    return out


RESULT = "doc_id long, n_words long, matches array<struct<label:string,kind:string,start:long,end:long>>"


def _scan(templates: dict[str, str], phrases: dict[str, str]):
    kind = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        automata = {label: Automaton(t) for label, t in templates.items()}
        for batch in batches:
            sizes, found = [], []
            for value in batch.column("text"):
                words = np.frombuffer(value.as_buffer(), np.uint8).tobytes().translate(FOLD).split()
                sizes.append(len(words))
                line = b" " + b" ".join(words) + b" "
                own = [{"label": label, "kind": "base", "start": k, "end": k + phrase.count(" ") + 1} for phrase, label in phrases.items() if phrase.encode() in line for k in _places(line, phrase.encode())]
                for label, a in automata.items():
                    covered = 0  # a match ends where the next may begin
                    for k in _places(line, a.anchor):
                        if k < covered:
                            continue
                        for start in range(covered if a.lead is None else max(covered, k - a.lead), k + 1):
                            end = a.match(words, start)
                            if end > k + a.anchor.count(b" "):
                                own.append({"label": label, "kind": "template", "start": start, "end": end})
                                covered = end
                                break
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "matches"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, matches) per row of ``docs`` (doc_id, text).

    Words are runs of digits, lower-cased letters and characters beyond ASCII of
    the whole text; ``start`` and ``end`` (exclusive) count them from 0.  A
    phrase matches wherever its words stand consecutively (kind ``base``).  A
    template matches where an automaton built from its markup accepts: all
    mandatory words one after another, optional regions whole or not at all,
    replaceable regions up to their number of words.  Only the places around a
    template's longest mandatory run are tried, the matches of one template don't
    overlap, and each is the longest from the first start that has one.

    Null and blank texts have no words and no matches, a null doc_id stays null;
    repeated rows come back as often as they came; very long texts are scanned
    whole; an empty table gives an empty result; other columns are ignored.  Each
    text is scanned alone, so skew in groups has no effect.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(same_text("text"), "UTF-8").alias("text"))
    return rows.mapInArrow(_scan(templates if templates is not None else TEMPLATES, phrases if phrases is not None else BASE_PHRASES), RESULT)


def license_labels(docs: DataFrame) -> DataFrame:
    """The summary columns of ``license_scan``: places, labels and a score of 0 to 1.

    The score grows with the evidence: n / (n + 1) for the n words of the longest
    match, 0 without one.  Texts without words have no places, empty labels and
    score 0; nulls, repeated rows and empty tables are as in ``license_scan``.
    """
    m = license_scan(docs)
    base = F.filter("matches", lambda x: x["kind"] == "base")
    label = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    start = F.transform(base, lambda x: x["start"])
    longest = F.coalesce(F.array_max(F.transform("matches", lambda x: x["end"] - x["start"])), F.lit(0))
    return m.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        label(base).alias("base_labels"),
        label(F.col("matches")).alias("labels"),
        (longest / (longest + 1)).alias("score"),
    )
