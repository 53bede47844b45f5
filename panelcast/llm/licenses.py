r"""License scans by template markup.

A template is wording with two kinds of markup: `[[...]]` may be absent, and `{{name:0-12}}`
stands for any words within these bounds (a copyright holder), `{{name=a|b c}}` for one of the
listed wordings. All templates are compiled into one automaton over words; its states are sets of
template positions and are built when first reached. A match needs every mandatory word in order,
so nothing but marked regions may differ. Every place is tried at which a template can start, and
the longest reading of each template from there counts.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z in lower case.

Defined results: null and empty texts have no words, no matches and score 0; a null id stays null;
repeated rows are scanned each; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from panelcast.llm.common import map_texts

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases whose places are counted by themselves; a plain phrase is a template without markup.
BASE: list[tuple[str, str]] = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Public license wordings with their variable regions marked, whole texts to their end: a text with other mandatory wording
# anywhere in it (a further condition, a field of use left out) is not that license. Notices that only name a
# license follow. Fixed values.
MIT = """permission is hereby granted free of charge to any person obtaining a copy of this {{object=software|work}} and associated documentation
files the {{object=software|materials|work}} to deal in the {{object=software|materials|work}} without restriction including without limitation
the rights to use copy modify merge publish distribute sublicense and or sell copies of the {{object=software|materials|work}} and to permit
persons to whom the {{object=software|materials|work}} is furnished to do so subject to the following conditions the above copyright notice
and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the
{{object=software|materials|work}} the {{object=software is|materials are|work is}} provided as is without warranty of any kind express or implied
including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
{{who=the authors or copyright holders|the copyright holders|the authors|the x consortium}} be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the {{object=software|materials|work}} or the use
or other dealings in the {{object=software|materials|work}}"""
BSD_2 = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following
disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
disclaimer in the documentation and or other materials provided with the distribution"""
BSD_NAMES = """[[3]] neither the name of {{organisation:1-15}} nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission"""
BSD_END = """this software is provided by {{who=the copyright holders and contributors|the copyright holder and contributors|the regents and
contributors|the author and contributors}} as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{who=the copyright owner or
contributors|the copyright holder or contributors|the copyright holders or contributors|the regents or contributors|the author or contributors}}
be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in
contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
advised of the possibility of such damage"""
ISC = """permission to use copy modify {{and=and or|and}} distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
{{who=the author|the authors|isc}} {{disclaims=disclaims|disclaim}} all warranties with regard to this software including all implied warranties of
merchantability and fitness in no event shall {{who=the author|the authors|isc}} be liable for any special direct indirect or consequential
damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
tortious action arising out of or in connection with the use or performance of this software"""
APACHE_NOTICE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at {{scheme=http|https}} www apache org licenses license 2 0 unless required by applicable law or
agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any
kind either express or implied see the license for the specific language governing permissions and limitations under the license"""
UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the
software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the
warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim
damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the
use or other dealings in the software"""
TEMPLATES: list[tuple[str, str]] = [
    ("mit", f"[[the]] mit license [[mit]] [[copyright [[c]] {{{{holder:0-20}}}}]] [[all rights reserved]] {MIT}"),
    ("mit", MIT),
    ("apache-2", APACHE_NOTICE),
    ("bsd-3-clause", f"{BSD_2} {BSD_NAMES} {BSD_END}"),
    ("bsd-2-clause", f"{BSD_2} {BSD_END}"),
    ("isc", ISC),
    ("unlicense", UNLICENSE),
    ("mit", "{{verb=released|licensed|distributed|available}} under the [[terms of the]] [[expat]] mit license"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "licensed under the [[terms of the]] apache license [[version]] 2 [[0]]"),
    ("apache-2", "apache 2 0 license"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("bsd", "under [[the terms of]] {{article=a|the}} [[modified|revised|simplified]] [[{{n=2|3}} clause]] bsd [[style]] license"),
    ("gpl-3", "gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-2", "gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("lgpl", "gnu {{kind=lesser|library}} general public license"),
    ("mpl-2", "mozilla public license [[v]] [[version]] {{version=2 0|2}}"),
    ("cc0", "cc0 {{version=1 0}}"),
    ("cc-by", "cc by {{version=1 0|2 0|2 5|3 0|4 0}}"),
    ("cc-by-sa", "cc by sa {{version=1 0|2 0|2 5|3 0|4 0}}"),
    ("cc-by-nc", "[[licensed under]] [[a]] [[creative commons]] cc by nc [[{{version=1 0|2 0|2 5|3 0|4 0}}]]"),
    ("cc-by-nc", "creative commons attribution {{kind=non commercial|noncommercial}} [[{{version=1 0|2 0|2 5|3 0|4 0}}]]"),
    ("cc-by", "creative commons attribution {{version=1 0|2 0|2 5|3 0|4 0}}"),
]

MARK = re.compile(r"\[\[|\]\]|\||\{\{\w+:(\d+)-(\d+)\}\}|\{\{\w+=([^}]*)\}\}|[^\s|\[\]{}]+")
ANY = b""  # no word is empty


class Place(NamedTuple):
    """One match: template number, first word, end word (exclusive)."""

    template: int
    start: int
    end: int


class Automaton:
    """All templates as one automaton over words, made deterministic as it is used."""

    def __init__(self, templates: list[str]):
        self.steps: list[dict[bytes, list[int]]] = []  # per position: word -> next positions
        self.free: list[list[int]] = []  # positions reached without a word
        self.accepts: dict[int, int] = {}
        starts = []
        for number, wording in enumerate(templates):
            first = self._new()
            starts.append(first)
            self.accepts[self._wording(wording, first)] = number
        self.words = {w for s in self.steps for w in s if w != ANY}
        self.states: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.next: list[dict[bytes, int]] = []
        self.ends: list[list[int]] = []
        self.start = self._state(self._closed(starts))
        if self.ends[self.start] or any(ANY in self.steps[p] for p in self.sets[self.start]):
            raise ValueError("a template must begin with wording of its own")
        self.first = {w for p in self.sets[self.start] for w in self.steps[p]}

    def _new(self) -> int:
        self.steps.append({})
        self.free.append([])
        return len(self.steps) - 1

    def _word(self, at: int, word: bytes) -> int:
        to = self._new()
        self.steps[at].setdefault(word, []).append(to)
        return to

    def _wording(self, text: str, at: int) -> int:
        opened: list[tuple[int, list[int]]] = []  # optional regions: where they begin, ends of their alternatives
        for m in MARK.finditer(text):
            mark = m[0]
            if mark == "[[":
                opened.append((at, []))
            elif mark == "|":
                begin, ends = opened[-1]
                ends.append(at)
                at = begin
            elif mark == "]]":
                begin, ends = opened.pop()
                to = self._new()
                for end in [begin, at, *ends]:
                    self.free[end].append(to)
                at = to
            elif m[1]:
                low, high = int(m[1]), int(m[2])
                ends = [at] if low == 0 else []
                for n in range(1, high + 1):
                    at = self._word(at, ANY)
                    if n >= low:
                        ends.append(at)
                at = self._new()
                for end in ends:
                    self.free[end].append(at)
            elif m[3]:
                to = self._new()
                for choice in m[3].split("|"):
                    end = at
                    for w in choice.split():
                        end = self._word(end, w.encode())
                    self.free[end].append(to)
                at = to
            else:
                at = self._word(at, mark.encode())
        return at

    def _closed(self, positions) -> frozenset[int]:
        seen, todo = set(), list(positions)
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += self.free[p]
        return frozenset(seen)

    def _state(self, positions: frozenset[int]) -> int:
        if positions not in self.states:
            self.states[positions] = len(self.sets)
            self.sets.append(positions)
            self.next.append({})
            self.ends.append(sorted({self.accepts[p] for p in positions if p in self.accepts}))
        return self.states[positions]

    def step(self, state: int, word: bytes) -> int:
        """The state after a word, or -1. Words of no template are one class, so states stay few."""
        word = word if word in self.words else ANY
        known = self.next[state].get(word)
        if known is None:
            to = {q for p in self.sets[state] for w in {word, ANY} for q in self.steps[p].get(w, ())}
            known = self.next[state][word] = self._state(self._closed(to)) if to else -1
        return known

    def places(self, words: list[bytes]) -> list[Place]:
        found = []
        first = self.first
        for start in [i for i, w in enumerate(words) if w in first]:
            state, ends = self.start, {}
            for i in range(start, len(words)):
                state = self.step(state, words[i])
                if state < 0:
                    break
                for template in self.ends[state]:
                    ends[template] = i + 1
            found += [Place(t, start, e) for t, e in sorted(ends.items())]
        return found


@lru_cache(maxsize=8)
def compiled(templates: tuple[str, ...]) -> Automaton:
    return Automaton(list(templates))


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # of bytes: only A-Z change


def scan_licenses(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None,
    base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """`keep` (default doc_id), n_words, n_covered (words within matches) and
    matches array<struct<label, base, start, end>> by start, end, template."""
    every = [*base, *templates]
    wordings, labels = tuple(w for _, w in every), [name for name, _ in every]

    def work(texts: list[bytes]) -> list[list]:
        automaton = compiled(wordings)
        n_words, n_covered, matches = [], [], []
        for t in texts:
            words = words_of(t)
            places = sorted(automaton.places(words), key=lambda p: (p.start, p.end, p.template))
            reach = covered = 0
            for p in places:
                covered += max(0, p.end - max(p.start, reach))
                reach = max(reach, p.end)
            n_words.append(len(words))
            n_covered.append(covered)
            matches.append([{"label": labels[p.template], "base": p.template < len(base), "start": p.start, "end": p.end} for p in places])
        return [n_words, n_covered, matches]

    fields = "n_words bigint, n_covered bigint, matches array<struct<label: string, base: boolean, start: bigint, end: bigint>>"
    return map_texts(docs, text, keep or ["doc_id"], fields, work)


def license_summary(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    """Places of the base phrases, distinct labels, and as score the share of words within matches."""
    base = F.filter("matches", lambda m: m["base"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return scanned.select(
        id, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("matches")).alias("labels"),
        F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(0.0).alias("score"),
    )
