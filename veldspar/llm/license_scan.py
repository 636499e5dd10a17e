"""License scans: templates with optional and replaceable regions, matched as token automata.

Markup: `<<opt>> words <</opt>>` may be left out; `<<var N>>` stands for any 0 to N words. All other words
are mandatory and must match exactly, in order, one after another. A template is compiled into a
nondeterministic automaton over words; an accepted run starts at any word of a text. Words are runs of
ASCII letters and digits and of any non-ASCII characters, with A-Z lowered.

Runs start only where a word is one of the automaton's first words, which one regular expression finds, so
texts without any cost a single pass.

Defined results: a null text is an empty one, without labels and with score 0. Overlapping matches all
count as places; the score is the share of a text's words that accepted matches cover. Repeated rows are
scanned one by one; extra columns are kept, and columns of docs named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veldspar.llm._shared import carried

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of words; every byte of a non-ASCII character is one.
_IN_WORD = np.array([b >= 128 or chr(b).isdigit() or 97 <= b <= 122 for b in range(256)])


@dataclass(frozen=True)
class Template:
    """A named template; base ones are plain phrases whose places are counted."""

    label: str
    markup: str
    base: bool = False


BASE = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
#: Whole licenses and notices as their publishers word them. Names of holders, numbers of list items and the wordings
#: that publishers vary are regions; all other words are mandatory. A license's first sentence alone has a label of
#: its own, since what follows it may have been changed.
TEMPLATES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>> the software <</opt>> to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice <<opt>> including the next paragraph <</opt>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<opt>> non <</opt>> <<var 1>> "
        "in no event shall <<var 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<opt>> 1 <</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<opt>> 2 <</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "<<opt>> <<opt>> 3 <</opt>> neither the name of <<var 12>> nor the names of <<var 4>> contributors may be used to endorse or promote products derived from this software without specific prior written permission <</opt>> "
        "this software is provided by <<var 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall <<var 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    Template(
        "isc",
        "permission to use copy modify and <<opt>> or <</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<var 12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <<var 12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 <<opt>> the license <</opt>> you may not use this file except in compliance with the license you may obtain a copy of the license at <<var 8>> "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    Template("apache", "licensed under the apache license version 2 0"),
    Template(
        "gpl",
        "free software you can redistribute it and or modify it under the terms of the gnu <<opt>> lesser <</opt>> <<opt>> affero <</opt>> general public license as published by the free software foundation "
        "either version <<var 2>> of the license or at your option any later version",
    ),
    Template("gpl", "licensed under the gnu <<opt>> lesser <</opt>> <<opt>> affero <</opt>> general public license <<opt>> version <<var 1>> <</opt>>"),
    Template("mpl", "subject to the terms of the mozilla public license <<opt>> v 2 0 <</opt>>"),
    Template("cc-by-nc", "licensed under <<opt>> a <</opt>> <<opt>> the <</opt>> cc by nc <<opt>> 4 0 <</opt>>"),
    Template("cc-by-sa", "licensed under <<opt>> a <</opt>> <<opt>> the <</opt>> cc by sa <<opt>> 4 0 <</opt>>"),
    Template("cc-by", "licensed under a creative commons attribution <<var 3>> international license"),
    Template("all-rights-reserved", "copyright <<var 8>> all rights reserved"),
    Template("mit-opening", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>> the software <</opt>> to deal in the software without restriction"),
    Template("bsd-opening", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc-opening", "permission to use copy modify and <<opt>> or <</opt>> distribute this software for any purpose with or without fee is hereby granted"),
    Template("apache-opening", "licensed under the apache license <<opt>> version 2 0 <</opt>> <<opt>> the license <</opt>> you may not use this file except in compliance with the license"),
    Template("gpl-opening", "free software you can redistribute it and or modify it under the terms of the gnu <<opt>> lesser <</opt>> <<opt>> affero <</opt>> general public license as published by the free software foundation"),
)


class Automaton:
    """States are numbers; a state has word edges, empty edges and, for replaceable regions, an edge for any word."""

    def __init__(self, template: Template):
        self.label, self.base = template.label, template.base
        self.edges: list[tuple[bytes | None, int] | None] = []
        self.empty: list[list[int]] = []
        tokens = re.findall(r"<<opt>>|<</opt>>|<<var \d+>>|[^\s<>]+", template.markup)
        last, opened = self._state(), []
        for t in tokens:
            if t == "<<opt>>":
                opened.append(last)
            elif t == "<</opt>>":
                self.empty[opened.pop()].append(last)
            elif t.startswith("<<var"):
                skipped, n = [last], int(t[6:-2])
                for _ in range(n):
                    skipped.append(last := self._edge(last, None))
                for s in skipped[:-1]:
                    self.empty[s].append(last)
            else:
                last = self._edge(last, t.encode())
                continue
            # A region's ends get a state of their own, so that empty edges of neighbours do not mix.
            new = self._state()
            self.empty[last].append(new)
            last = new
        self.final = last
        self.start = self._closure({0})
        self.first = sorted({e[0] for s in self.start if (e := self.edges[s]) and e[0] is not None})
        if opened or not self.first or any((e := self.edges[s]) and e[0] is None for s in self.start):
            raise ValueError(f"a template starts with a word and closes its regions: {template.markup}")

    def _state(self) -> int:
        self.edges.append(None)
        self.empty.append([])
        return len(self.edges) - 1

    def _edge(self, at: int, word: bytes | None) -> int:
        to = self._state()
        self.edges[at] = (word, to)
        return to

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def run(self, words: Iterator[bytes]) -> int:
        """Words of the longest accepted run that starts here; 0 if there is none."""
        states, best = self.start, 0
        for n, w in enumerate(words, 1):
            states = self._closure({e[1] for s in states if (e := self.edges[s]) and (e[0] is None or e[0] == w)})
            if not states:
                break
            if self.final in states:
                best = n
        return best


class Scanner:
    """Automata of all templates, with one expression for the words at which runs can start."""

    def __init__(self, templates: tuple[Template, ...] = BASE + TEMPLATES):
        self.automata = [Automaton(t) for t in templates]
        self.by_first: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for w in a.first:
                self.by_first.setdefault(w, []).append(a)
        inner = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
        words = b"|".join(sorted(map(re.escape, self.by_first)))
        self.starts = re.compile(rb"(?<!" + inner + rb")(?:" + words + rb")(?!" + inner + rb")")

    def scan(self, text: str | None) -> dict:
        low = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        inside = _IN_WORD[np.frombuffer(low, np.uint8)]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        out = {"n_words": int(np.count_nonzero(begins)), "n_base": 0, "first_word": None, "last_word": None, "base": set(), "labels": set(), "matches": []}
        place, spans = None, []
        for m in self.starts.finditer(low):
            for a in self.by_first[m[0]]:
                n = a.run(w[0] for w in _WORD.finditer(low, m.start()))
                if not n:
                    continue
                place = np.flatnonzero(begins) if place is None else place
                at = int(np.searchsorted(place, m.start()))
                spans.append((at, at + n))
                out["labels"].add(a.label)
                out["matches"].append((a.label, at, n))
                if a.base:
                    out["n_base"] += 1
                    out["base"].add(a.label)
                    out["first_word"] = at if out["first_word"] is None else min(at, out["first_word"])
                    out["last_word"] = at if out["last_word"] is None else max(at, out["last_word"])
        covered, end = 0, 0
        for b, e in sorted(spans):
            covered += max(0, e - max(b, end))
            end = max(end, e)
        out["score"] = covered / out["n_words"] if covered else 0.0
        return out


MATCHES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType()), T.StructField("n", T.LongType())]))


def scan(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = BASE + TEMPLATES, keep: list[str] | None = None) -> DataFrame:
    """docs with counts, places, labels, score, and the matches as (label, first word, words)."""
    new = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(), "matches": MATCHES}
    kept = carried(docs, keep, new)
    source = docs.select(*kept, docs[text_col].alias("__text"))
    schema = T.StructType([*docs.select(*kept).schema.fields, *(T.StructField(n, t) for n, t in new.items())])
    matches = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [scanner.scan(t.as_py()) for t in part.column(len(kept))]
                columns = [pa.array([x[k] for x in found], pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")]
                columns += [pa.array([",".join(sorted(x[k])) for x in found], pa.string()) for k in ("base", "labels")]
                columns += [pa.array([x["score"] for x in found], pa.float64())]
                columns += [pa.array([[{"label": a, "word": b, "n": c} for a, b, c in x["matches"]] for x in found], matches)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*kept, *new])

    return source.mapInArrow(run, schema)
