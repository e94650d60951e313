"""License scan: template markup compiled to token automata.

A template is text with optional regions <<optional>> ... <<end>> and replaceable regions <<any:n>> (up to n words).
It compiles to a nondeterministic automaton over words, which accepts a stretch of a document whose mandatory
words match exactly, in order, nothing between them. A template is tried only in texts that hold all its mandatory words.
Texts are whole licenses, or the whole notice that a long license asks to be put into files; one-line notices have labels of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

#: Phrases of the base rule and their labels: fixed values.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Word bytes: digits, a-z after folding A-Z, and all bytes of characters beyond ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors <<optional>>or copyright holders<<end>> be liable "
    "for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
    "the software or the use or other dealings in the software"
)
_DISCLAIMED = (
    "the software is provided as is and <<any:6>> disclaims all warranties with regard to this software including all implied warranties of "
    "merchantability and fitness in no event shall <<any:6>> be liable for any special direct indirect or consequential damages or any damages "
    "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
    "connection with the use or performance of this software"
)
_BSD_TAIL = (
    "this software is provided by <<any:12>> as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any:12>> be liable for any direct "
    "indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or "
    "tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
#: <<any:1>> before a clause stands for its list mark, whatever it is.
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<any:1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<any:1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution"
)
_LATER = "<<optional>>or at your option any later version<<end>>"


def _gnu(name: str, version: str) -> str:
    """The notice that the GNU licenses ask for."""
    return (
        f"is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation "
        f"either version {version} of the license {_LATER} <<any:4>> is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the "
        f"{name} for more details you should have received a copy of the {name} along with <<any:4>> if not"
    )


#: (label, markup) of license texts and of whole notices: their wording is fixed.
TEXTS = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and "
        "or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial "
        "portions of the software " + _AS_IS,
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies " + _DISCLAIMED,
    ),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted " + _DISCLAIMED),
    ("bsd-2-clause", _BSD_HEAD + " " + _BSD_TAIL),
    (
        "bsd-3-clause",
        _BSD_HEAD + " <<any:1>> neither the name of <<any:12>> nor the names of <<any:8>> contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission " + _BSD_TAIL,
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from "
        "the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
        "and redistribute it freely subject to the following restrictions <<any:1>> the origin of this software must not be misrepresented you must not "
        "claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be "
        "appreciated but is not required <<any:1>> altered source versions must be plainly marked as such and must not be misrepresented as being the "
        "original software <<any:1>> this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
        "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that "
        "recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we "
        "make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law " + _AS_IS,
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at <<any:10>> unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing "
        "permissions and limitations under the license",
    ),
    ("gpl-2", _gnu("gnu general public license", "2")),
    ("gpl-3", _gnu("gnu general public license", "3")),
    ("lgpl-2.1", _gnu("gnu lesser general public license", "2 1")),
    ("lgpl-3", _gnu("gnu lesser general public license", "3")),
    ("agpl-3", _gnu("gnu affero general public license", "3")),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can "
        "obtain one at",
    ),
    ("cc-by", "this work is licensed under a creative commons attribution <<any:2>> international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike <<any:2>> international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial <<any:2>> international license"),
)
_UNDER = "under <<optional>>a<<end>> <<optional>>the<<end>> <<optional>>terms of the<<end>> "
#: (label, markup) of notices that only name a license.
NOTICES = (
    ("mit-notice", _UNDER + "mit license"),
    ("apache-2-notice", _UNDER + "apache license <<optional>>version<<end>> 2 0"),
    ("gpl-notice", _UNDER + "gnu general public license"),
    ("lgpl-notice", _UNDER + "gnu lesser general public license"),
    ("agpl-notice", _UNDER + "gnu affero general public license"),
    ("mpl-2-notice", _UNDER + "mozilla public license <<optional>>v<<end>> <<optional>>version<<end>> 2 0"),
    ("cc-by-notice", _UNDER + "creative commons attribution <<optional>>4 0<<end>> <<optional>>3 0<<end>> <<optional>>international<<end>> license"),
    ("cc-by-sa-notice", _UNDER + "creative commons attribution sharealike <<optional>>4 0<<end>> <<optional>>3 0<<end>> <<optional>>international<<end>> license"),
    ("cc-by-nc-notice", _UNDER + "creative commons attribution noncommercial <<optional>>4 0<<end>> <<optional>>3 0<<end>> <<optional>>international<<end>> license"),
)
TEMPLATES = (*TEXTS, *NOTICES)
#: What the best that stands in a text is worth: a license text, a notice, a base phrase.
TEXT, NOTICE, PHRASE = 1.0, 0.75, 0.5
_NOTICED = frozenset(label for label, _ in NOTICES)


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case: runs of digits, a-z and characters beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


@dataclass
class Automaton:
    """States are numbered; a state has word edges, edges for any word, and silent edges."""

    label: str
    word: list[dict[bytes, list[int]]] = field(default_factory=list)
    anything: list[list[int]] = field(default_factory=list)
    silent: list[list[int]] = field(default_factory=list)
    accept: int = 0
    mandatory: tuple[bytes, ...] = ()
    first: frozenset[bytes] = frozenset()
    open_start: bool = False

    def state(self) -> int:
        self.word.append({})
        self.anything.append([])
        self.silent.append([])
        return len(self.word) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.silent[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, tokens: list[bytes], start: int) -> int | None:
        """End of the longest stretch accepted from start, or None."""
        now, best = self.closure({0}), None
        if self.accept in now:
            best = start
        for i in range(start, len(tokens)):
            after: set[int] = set()
            for s in now:
                after.update(self.word[s].get(tokens[i], ()))
                after.update(self.anything[s])
            if not after:
                break
            now = self.closure(after)
            if self.accept in now:
                best = i + 1
        return best


def compile_template(label: str, markup: str) -> Automaton:
    """Mandatory words outside optional regions; nested optional regions are allowed."""
    a = Automaton(label)
    at, stack, mandatory = a.state(), [], []
    for part in re.findall(r"<<optional>>|<<end>>|<<any:\d+>>|[^<]+", markup):
        if part == "<<optional>>":
            stack.append(at)
        elif part == "<<end>>":
            a.silent[stack.pop()].append(at)
        elif part.startswith("<<any:"):
            end = a.state()
            a.silent[at].append(end)
            for _ in range(int(part[6:-2])):
                nxt = a.state()
                a.anything[at].append(nxt)
                a.silent[nxt].append(end)
                at = nxt
            at = end
        else:
            for w in words(part):
                nxt = a.state()
                a.word[at].setdefault(w, []).append(nxt)
                at = nxt
                if not stack:
                    mandatory.append(w)
        if stack and part == "<<optional>>":
            inner = a.state()  # so that the way around starts before the region
            a.silent[at].append(inner)
            at = inner
    a.accept = at
    a.mandatory = tuple(dict.fromkeys(mandatory))
    start = a.closure({0})
    a.first = frozenset(w for s in start for w in a.word[s])
    a.open_start = any(a.anything[s] for s in start)
    return a


AUTOMATA = tuple(compile_template(*t) for t in TEMPLATES)
_PHRASES = tuple((p.encode().split(), label) for p, label in PHRASES)


def find_templates(tokens: list[bytes], automata: tuple[Automaton, ...] = AUTOMATA) -> list[tuple[int, int, str]]:
    """(first word, past the last word, label) of accepted stretches: for each template leftmost, longest, not overlapping."""
    have = set(tokens)
    out = []
    for a in automata:
        if not have.issuperset(a.mandatory):
            continue
        i = 0
        while i < len(tokens):
            if a.open_start or tokens[i] in a.first:
                end = a.match(tokens, i)
                if end is not None and end > i:
                    out.append((i, end, a.label))
                    i = end
                    continue
            i += 1
    return sorted(out)


def find_phrases(tokens: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase stands, overlapping ones too."""
    out = []
    for phrase, label in _PHRASES:
        k, at = len(phrase), -1
        rare = max(range(k), key=lambda i: len(phrase[i]))
        try:
            while True:
                at = tokens.index(phrase[rare], at + 1)
                s = at - rare
                if s >= 0 and tokens[s : s + k] == phrase:
                    out.append((s, label))
        except ValueError:
            continue
    return sorted(out)


SCHEMA = "doc_id long, n_words long, phrases array<struct<word:long,label:string>>, templates array<struct<start:long,end:long,label:string>>, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, phrases, templates, score) for every row.

    score is TEXT where a license text is accepted, else NOTICE or PHRASE where such a one stands, else 0. Null texts count as empty; whole
    texts are read; repeated rows come out alike; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrase = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        stretch = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
        for b in batches:
            n, ps, ts, scores = [], [], [], []
            for t in b.column(1).to_pylist():
                tokens = words(t)
                p, m = find_phrases(tokens), find_templates(tokens)
                n.append(len(tokens))
                ps.append([{"word": s, "label": x} for s, x in p])
                ts.append([{"start": s, "end": e, "label": x} for s, e, x in m])
                scores.append(max([TEXT if x not in _NOTICED else NOTICE for _, _, x in m] or [PHRASE if p else 0.0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ps, phrase), pa.array(ts, stretch), pa.array(scores, pa.float64())], ["doc_id", "n_words", "phrases", "templates", "score"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    places, base = F.col("phrases.word"), F.col("phrases.label")

    def listed(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, F.col("templates.label"))).alias("labels"),
        "score",
    )
