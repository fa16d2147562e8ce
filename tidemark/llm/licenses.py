"""License scans: templates with optional and replaceable regions as token automata over the words of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shape

#: A word of a license: a run of ASCII letters, digits and characters beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licenses and of the notices by which works name them.
# <<beginOptional>> ... <<endOptional>>: may be absent. <<var;match="a|b c">>: one of these wordings.
# <<var;match=".{m,n}">>: from m to n words of any kind.
TEMPLATES = [
    ("mit", '<<var;match="released|licensed|distributed|available">> under the <<beginOptional>>terms of the<<endOptional>> MIT License'),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;match="this software|this font software|.{1,6}">>
        and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=".{1,20}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution. <<beginOptional>>THIS SOFTWARE IS PROVIDED BY<<endOptional>>"""),
    ("bsd-3-clause", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. <<beginOptional>>3.<<endOptional>> Neither the name of <<var;match=".{1,20}">> nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("apache-2", '<<var;match="licensed|released|distributed|available">> under the <<beginOptional>>terms of the<<endOptional>> Apache <<beginOptional>>Software<<endOptional>> License <<var;match="version 2|2">> 0'),
    ("gpl", """<<beginOptional>><<var;match="this work|this program|this library">> is<<endOptional>> <<var;match="licensed|released|distributed|available">> under the
        <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> <<var;match="general public license|gpl">>"""),
    ("gpl-3", '<<var;match="licensed|released|distributed|available">> under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> <<var;match="general public license version 3|gpl version 3|gplv3|gpl 3">>'),
    ("gpl-2", '<<var;match="licensed|released|distributed|available">> under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> <<var;match="general public license version 2|gpl version 2|gplv2|gpl 2">>'),
    ("gpl-3", """is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version."""),
    ("gpl-2", """is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;
        either version 2 of the License, or (at your option) any later version."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""),
    ("cc-by-nc", '<<var;match="licensed|released|distributed|available">> under <<beginOptional>><<var;match="the|a">><<endOptional>> <<var;match="cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial">>'),
    ("cc-by-sa", '<<var;match="licensed|released|distributed|available">> under <<beginOptional>><<var;match="the|a">><<endOptional>> <<var;match="cc by sa|creative commons attribution sharealike|creative commons attribution share alike">>'),
    ("cc0", '<<var;match="licensed|released|dedicated|available">> under <<beginOptional>>the<<endOptional>> <<var;match="cc0|creative commons zero|creative commons cc0">>'),
]

_MARK = re.compile(r'<<beginOptional>>|<<endOptional>>|<<var;match="([^"]*)">>')
_ANY = re.compile(r"\.\{(\d+),(\d+)\}")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


@dataclass
class Region:
    """One of several wordings (``choices``, each a list of words and regions), or any words, ``least`` to ``most``."""

    choices: list[list] = field(default_factory=list)
    least: int = 0
    most: int = 0


def parsed(template: str) -> list:
    """Words (bytes) and Regions of a template's text."""
    stack: list[list] = [[]]
    at = 0
    for mark in _MARK.finditer(template):
        stack[-1] += words_of(template[at : mark.start()])
        at = mark.end()
        if mark[0] == "<<beginOptional>>":
            stack.append([])
        elif mark[0] == "<<endOptional>>":
            if len(stack) == 1:
                raise ValueError(f"an optional region ends that did not begin: {template[:60]}")
            inside = stack.pop()
            stack[-1].append(Region([inside, []]))
        else:
            choices = []
            for choice in mark[1].split("|"):
                some = _ANY.fullmatch(choice)
                choices.append([Region([], int(some[1]), int(some[2]))] if some else words_of(choice))
            stack[-1].append(Region(choices))
    if len(stack) > 1:
        raise ValueError(f"an optional region does not end: {template[:60]}")
    return stack[0] + words_of(template[at:])


class Automaton:
    """All templates as one automaton: states with moves by a word, by any word, and without a word."""

    def __init__(self, templates: list[list]):
        self.by_word: list[dict[bytes, list[int]]] = []
        self.by_any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.ends: dict[int, int] = {}
        self.starts = []
        for i, template in enumerate(templates):
            start = self._state()
            self.starts.append(start)
            end = self._sequence(template, start)
            if end == start or end in self._reached({start}):
                raise ValueError("a template has no mandatory word")
            self.ends[end] = i

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def _sequence(self, items: list, at: int) -> int:
        for item in items:
            after = self._state()
            if isinstance(item, bytes):
                self.by_word[at].setdefault(item, []).append(after)
            elif item.choices:
                for choice in item.choices:
                    self.free[self._sequence(choice, at)].append(after)
            else:
                for n in range(item.most):
                    if n >= item.least:
                        self.free[at].append(after)
                    following = self._state()
                    self.by_any[at].append(following)
                    at = following
                self.free[at].append(after)
            at = after
        return at

    def _reached(self, states: set[int]) -> frozenset[int]:
        """``states`` and all that are reached from them without a word."""
        todo, found = list(states), set(states)
        while todo:
            for after in self.free[todo.pop()]:
                if after not in found:
                    found.add(after)
                    todo.append(after)
        return frozenset(found)

    def begin(self) -> frozenset[int]:
        return self._reached(set(self.starts))

    def move(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        after = set()
        for s in states:
            after.update(self.by_word[s].get(word, ()), self.by_any[s])
        return self._reached(after)


#: Sets of states that a task keeps with their moves; beyond that it forgets them and finds them anew.
MOST_SETS = 20_000


class Scanner:
    """Finds phrases and templates in the words of a text: sets of the automaton's states are met once and kept.

    A search may begin at each word, so the starting states belong to every set. Where a template ends, the words
    are read backwards from there by the mirrored automaton, to the earliest word with which it may begin.
    """

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        bodies = [words_of(p) for p in phrases] + [parsed(t) for _, t in templates]
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.phrases = len(phrases)
        self.forward = Automaton(bodies)
        self.backward = [Automaton([mirrored(b)]) for b in bodies]
        self.known = {w for moves in self.forward.by_word for w in moves}
        self._forget()

    def _forget(self) -> None:
        start = self.forward.begin()
        self.numbers, self.sets = {start: 0}, [start]
        self.moves: list[dict[bytes | None, int]] = [{}]
        self.accepted: list[list[int]] = [[]]

    def _move(self, at: int, word: bytes | None) -> int:
        after = self.forward.move(self.sets[at], word or b"") | self.sets[0]
        if after not in self.numbers:
            self.numbers[after] = len(self.sets)
            self.sets.append(after)
            self.moves.append({})
            self.accepted.append(sorted(self.forward.ends[s] for s in after if s in self.forward.ends))
        self.moves[at][word] = self.numbers[after]
        return self.numbers[after]

    def _start(self, which: int, words: list[bytes], end: int) -> int:
        automaton, found = self.backward[which], end
        states = automaton.begin()
        for i in range(end, -1, -1):
            states = automaton.move(states, words[i])
            if not states:
                break
            if any(s in automaton.ends for s in states):
                found = i
        return found

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(phrase or template, first word, last word) of every end that is accepted."""
        found, at, known = [], 0, self.known
        if len(self.sets) > MOST_SETS:
            self._forget()
        moves, accepted = self.moves, self.accepted
        for i, word in enumerate(words):
            if word not in known:
                word = None
            after = moves[at].get(word)
            at = self._move(at, word) if after is None else after
            for which in accepted[at]:
                found.append((which, self._start(which, words, i), i))
        return found


def mirrored(items: list) -> list:
    """A template's words and regions from the last to the first."""
    return [r if isinstance(r, bytes) else Region([mirrored(c) for c in r.choices], r.least, r.most) for r in reversed(items)]


_FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, template: boolean, first: bigint, last: bigint>>"


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every whole text.

    Words are compared with A-Z in lower case. ``n_base`` counts the places of all phrases, first_word and
    last_word are the smallest and largest word (from 0) at which one begins, null without any. ``labels`` are
    those of phrases and of templates whose mandatory wording stands in the text word by word, with their optional
    and replaceable regions; both lists are distinct, sorted by code point and comma-joined. ``score`` is 1 with a
    template's wording, 0.5 with phrases alone, else 0. ``spans`` has a row for each phrase and each accepted end
    of a template, with the earliest word where that may begin. Null and empty texts have no words; null ids,
    repeated rows and other columns change nothing; an empty table gives an empty result. Each text is read by
    itself, so nothing is shuffled.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = shape(slim.select("id"), _FOUND)
    spans_type = pa.list_(pa.struct([("label", pa.string()), ("template", pa.bool_()), ("first", pa.int64()), ("last", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            out = [_row(scanner, text.as_py()) for text in batch.column("text")]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return slim.mapInArrow(run, schema)


def _row(scanner: Scanner, text: bytes | None) -> tuple:
    words = WORD.findall((text or b"").lower())
    places = scanner.places(words)
    base = [p for p in places if p[0] < scanner.phrases]
    label = scanner.labels
    score = 1.0 if len(base) < len(places) else 0.5 if base else 0.0
    first, last = (f((p[1] for p in base), default=None) for f in (min, max))
    spans = [{"label": label[w], "template": w >= scanner.phrases, "first": a, "last": b} for w, a, b in places]
    names = [",".join(sorted({label[p[0]] for p in some})) for some in (base, places)]
    return len(words), len(base), first, last, *names, score, spans


def as_pattern(items: list) -> str:
    """A template as a regular expression over words that stand between spaces of their own (`` a  b ``): what SQL is given."""
    out = ""
    for item in items:
        if isinstance(item, bytes):
            out += f" {item.decode()} "
        elif item.choices:
            out += f"(?:{'|'.join(as_pattern(c) for c in item.choices)})"
        else:
            out += f"(?: [^ ]+ ){{{item.least},{item.most}}}"
    return out


def sql() -> str:
    """The rows of scan() but for its spans, over ``documents``: templates as regular expressions."""
    def lists(pairs):
        return ", ".join(f"('{label}', '{body}')" for label, body in pairs)

    phrases = lists((label, phrase) for phrase, label in PHRASES.items())
    templates = lists((label, as_pattern(parsed(t))) for label, t in TEMPLATES)
    return f"""
WITH phrases(label, body) AS (SELECT label, string_split(body, ' ') FROM (VALUES {phrases}) t(label, body)),
templates(label, body) AS (VALUES {templates}),
split AS (
  SELECT row_number() OVER () AS id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
joined AS (SELECT *, CASE WHEN len(words) > 0 THEN ' ' || array_to_string(words, '  ') || ' ' ELSE '' END AS text FROM split),
candidates AS (SELECT id, label, words, body FROM joined JOIN phrases ON contains(text, ' ' || array_to_string(body, '  ') || ' ')),
places AS (SELECT id, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1:i + len(body)] = body)) AS place FROM candidates),
base AS (SELECT id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY id),
wordings AS (SELECT DISTINCT id, label FROM joined JOIN templates ON regexp_matches(text, body)),
both_ AS (SELECT DISTINCT id, label FROM (SELECT id, label FROM wordings UNION ALL SELECT id, label FROM places)),
named AS (SELECT id, string_agg(label, ',' ORDER BY label) AS labels FROM both_ GROUP BY id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN id IN (SELECT id FROM wordings) THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM joined LEFT JOIN base USING (id) LEFT JOIN named USING (id)
"""
