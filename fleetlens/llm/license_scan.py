"""License scan: templates with optional and replaceable regions, compiled to token automata.

A template is wording with markup: ``<<optional>> words <</optional>>``
may stand or be absent, ``<<any 0 4>>`` stands for 0 to 4 arbitrary words, ``<<like [0-9]{4}>>`` for
one word that the pattern matches as a whole. Wording is read as texts are: lower case, letters and digits. It
compiles to a nondeterministic automaton over words, in time linear in its length; a place in a text matches
if some run reads all mandatory wording exactly. Automata start only where one
of the template's possible first two words stand together, found by word-pair
hashes over the whole text, so a text is read once.

Phrases (plain words) are counted wherever they stand consecutively. A scan
with no shuffle; phrases and templates are a short list given by the caller
(``MAX_TEMPLATES`` bounds it).

Null and empty texts have no words, no labels and score 0. Repeated rows and null ids each
get their own row. Texts of any length are read whole. Other columns, whatever their names, are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import ALNUM_WORD, LOWER, short_batches, steps, text_bytes, window_hashes, word_hashes

MAX_TEMPLATES = 10_000

#: Phrases and labels of the base scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Licence notices and whole licences by label; the wording is that of the licences themselves.
AS_IS = ("THIS SOFTWARE IS PROVIDED BY <<any 1 12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
         "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any 1 12>> BE "
         "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
         "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
         "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
         "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
BSD_2 = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
         "conditions are met: <<optional>>1.<</optional>> Redistributions of source code must retain the above copyright notice, this "
         "list of conditions and the following disclaimer. <<optional>>2.<</optional>> Redistributions in binary form must reproduce the "
         "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
         "provided with the distribution. ")
TEMPLATES = {
    "mit": ["under the <<optional>>terms of the<</optional>> MIT license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software <<optional>>and associated "
            "documentation files (the \"Software\"),<</optional>> to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
            "and this permission notice <<optional>>(including the next paragraph)<</optional>> shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
            "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
            "EVENT SHALL <<any 1 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
            "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "apache-2": ["licensed under the Apache license <<optional>>version<</optional>> 2 <<optional>>0<</optional>>"],
    "cc-by-nc": ["licensed under <<any 0 4>> CC BY NC <<optional>><<like [1-4]>> 0<</optional>>"],
    "gpl-3": ["under the <<optional>>terms of the<</optional>> GNU general public license <<any 0 8>> version 3"],
    "gpl-2": ["under the <<optional>>terms of the<</optional>> GNU general public license <<any 0 8>> version 2"],
    "lgpl": ["under the <<optional>>terms of the<</optional>> GNU lesser general public license"],
    "isc": ["Permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
            "PROVIDED \"AS IS\" AND <<any 1 12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 1 12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
            "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
            "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "bsd-2-clause": [BSD_2 + AS_IS],
    "bsd-3-clause": [BSD_2 + "<<optional>>3.<</optional>> Neither the name of <<any 1 12>> nor the names of <<any 0 3>> contributors may be used "
                     "to endorse or promote products derived from this software without specific prior written permission. " + AS_IS],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will <<any 1 6>> be held liable for any "
             "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
             "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
             "<<optional>>1.<</optional>> The origin of this software must not be misrepresented; you must not claim that you wrote the "
             "original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
             "but is not required. <<optional>>2.<</optional>> Altered source versions must be plainly marked as such, and must not be "
             "misrepresented as being the original software. <<optional>>3.<</optional>> This notice may not be removed or altered from any "
             "source distribution."],
    "all-rights-reserved": ["all rights reserved <<optional>>copyright c <<like (19|20)[0-9]{2}>><</optional>>"],
}
_MARK = re.compile(r"<<optional>>|<</optional>>|<<any \d+ \d+>>|<<like .*?>>|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


@dataclass
class Automaton:
    """words[s]: word -> next states; wild[s]: states after any word; like[s]: (pattern, state after a word that it
    matches); skip[s]: states without a word."""

    label: str
    words: list[dict] = field(default_factory=list)
    wild: list[set] = field(default_factory=list)
    like: list[list] = field(default_factory=list)
    skip: list[set] = field(default_factory=list)
    accept: int = 0

    def state(self) -> int:
        self.words.append({})
        self.wild.append(set())
        self.like.append([])
        self.skip.append(set())
        return len(self.words) - 1

    def closure(self, states) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def step(self, states, word: str) -> set[int]:
        nxt: set[int] = set()
        for s in states:
            nxt |= self.words[s].get(word, set()) | self.wild[s] | {t for p, t in self.like[s] if p.fullmatch(word)}
        return self.closure(nxt)

    def finish(self) -> "Automaton":
        """left[s]: fewest words from s to the end; pairs: the first two words of any match."""
        n = len(self.words)
        back: list[list] = [[] for _ in range(n)]  # (state before, words read)
        for s in range(n):
            for t in self.skip[s]:
                back[t].append((s, 0))
            for t in (*(t for ts in self.words[s].values() for t in ts), *self.wild[s], *(t for _, t in self.like[s])):
                back[t].append((s, 1))
        self.left = [n + 1] * n
        self.left[self.accept] = 0
        todo = deque([self.accept])
        while todo:  # breadth first, what reads no word ahead of the rest: each state is settled once
            t = todo.popleft()
            for s, read in back[t]:
                if self.left[t] + read < self.left[s]:
                    self.left[s] = self.left[t] + read
                    (todo.append if read else todo.appendleft)(s)
        self.pairs = set()
        start = self.closure({0})
        for a in {w for s in start for w in self.words[s]}:
            after = self.step(start, a)
            if any(self.wild[s] or self.like[s] for s in start | after) or self.accept in after:
                raise ValueError(f"a template of {self.label} must begin with two fixed words")
            self.pairs |= {(a, b) for s in after for b in self.words[s]}
        return self

    def run(self, words, first: int) -> float:
        """1 if a match starts at words[first], else the largest part of it that is read."""
        states = self.closure({0})
        total = best = self.left[0]
        for i in range(first, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            best = min(best, min(self.left[s] for s in states))
            if not best:
                return 1.0
        return 1.0 - best / total


def compile_template(label: str, text: str) -> Automaton:
    a = Automaton(label)
    at = a.state()
    opened = []
    for mark in _MARK.findall(text):
        if mark == "<<optional>>":
            opened.append(at)
            fresh = a.state()
            a.skip[at].add(fresh)
            at = fresh
        elif mark == "<</optional>>":
            end = a.state()
            a.skip[at].add(end)
            a.skip[opened.pop()].add(end)
            at = end
        elif mark.startswith("<<any"):
            low, high = map(int, re.findall(r"\d+", mark))
            end = a.state()
            for i in range(high):
                fresh = a.state()
                if i >= low:
                    a.skip[at].add(end)
                a.wild[at].add(fresh)
                at = fresh
            a.skip[at].add(end)
            at = end
        elif mark.startswith("<<like"):
            fresh = a.state()
            a.like[at].append((re.compile(mark[len("<<like "):-2]), fresh))
            at = fresh
        else:
            fresh = a.state()
            a.words[at].setdefault(mark.translate(_LOWER), set()).add(fresh)
            at = fresh
    if opened:
        raise ValueError(f"an optional region of {label} is not closed")
    a.accept = at
    return a.finish()


def _hash_of(words) -> np.uint64:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    hashes, _, _, at = word_hashes(data, np.array([0, len(data)]), ALNUM_WORD)
    return window_hashes(hashes, at, len(words))[0][0]


def _scan(batches, phrases: dict, templates: list):
    by_length: dict[int, dict] = {}
    for phrase, label in phrases.items():
        own = tuple(phrase.split())
        by_length.setdefault(len(own), {})[int(_hash_of(own))] = (own, label)
    pairs: dict[int, list] = {}
    for a in templates:
        for pair in a.pairs:
            pairs.setdefault(int(_hash_of(pair)), []).append((pair, a))
    lengths = sorted({*by_length, 2} if pairs else by_length)
    wanted = {k: np.array(sorted({*by_length.get(k, ()), *(pairs if k == 2 else ())}), np.uint64) for k in lengths}
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        n = len(offsets) - 1
        n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first, last = [None] * n, [None] * n
        base, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
        for lo, hi in steps(offsets):
            text = LOWER[data[offsets[lo]: offsets[hi]]]
            hashes, starts, ends, at = word_hashes(text, offsets[lo: hi + 1] - offsets[lo], ALNUM_WORD)
            n_words[lo:hi] = np.diff(at)
            word = lambda i: text[starts[i]: ends[i]].tobytes().decode()
            for k in lengths:
                got, begin, _ = window_hashes(hashes, at, k)
                for x in np.flatnonzero(np.isin(got, wanted[k])).tolist():
                    w, h = int(begin[x]), int(got[x])
                    d = int(np.searchsorted(at, w, side="right")) - 1
                    here = tuple(word(w + j) for j in range(k))
                    own, label = by_length.get(k, {}).get(h, (None, None))
                    if here == own:
                        place = w - int(at[d])
                        n_base[lo + d] += 1
                        first[lo + d] = place if first[lo + d] is None else min(place, first[lo + d])
                        last[lo + d] = place if last[lo + d] is None else max(place, last[lo + d])
                        base[lo + d].add(label)
                        score[lo + d] = 1.0
                    for pair, a in pairs.get(h, ()) if k == 2 else ():
                        if here == pair:
                            got_part = a.run(_Words(word, int(at[d + 1])), w)
                            score[lo + d] = max(score[lo + d], got_part)
                            if got_part == 1.0:
                                labels[lo + d].add(a.label)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
             pa.array([",".join(sorted(x)) for x in base], pa.string()),
             pa.array([",".join(sorted(x | y)) for x, y in zip(base, labels)], pa.string()), pa.array(score)],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


class _Words:
    """The words of a document up to its end, read one at a time."""

    def __init__(self, word, end: int):
        self.word, self.end = word, end

    def __len__(self):
        return self.end

    def __getitem__(self, i):
        return self.word(i)


def scan_licenses(docs: DataFrame, phrases: dict | None = None, templates: dict | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every text.

    ``n_base`` counts all places of the phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start; ``labels`` joins the
    phrases' labels with those of accepted templates. ``score`` is 1 if any
    label holds, else the largest part of a template's wording that was read.
    """
    phrases = PHRASES if phrases is None else phrases
    compiled = [compile_template(label, t) for label, ts in (TEMPLATES if templates is None else templates).items() for t in ts]
    if len(compiled) + len(phrases) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} phrases and templates")
    short_batches(docs.sparkSession)
    src = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(lambda batches: _scan(batches, phrases, compiled),
                          "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                          "base_labels string, labels string, score double")
