"""License scans with a positional index of rare words.

Templates are sequences of words with mandatory key phrases in them: mentions and notices of one sentence, and whole
licence texts with several. The index files each key phrase under its rarest words (up to ``POSTINGS`` of them, highest
IDF over all documents): a word's postings name the phrases it is filed for and its place in them. A file's own licence
words are looked up from the highest IDF down. The first word of a phrase that is met opens it: its places in
the file, moved by its place in the phrase, are where the phrase may stand. Each further word intersects these relative
positions with its own. What is left when the last word has been seen is compared word by word. Every place of a
phrase is found, because the phrase holds all the words that it is filed under: ``Template`` insists on it.

A template stands where its first key phrase does, if each further one stands at its place too, give or take
``DRIFT`` words: copies of a text name other holders, leave a line out or put one in. The nearest place counts, of two
as near the earlier one; what lies between two key phrases is compared with the drift of the phrase before.

The three base phrases are templates as well, each wholly mandatory, so all of their places come from the
same index.

Score: 0 without a match; a base phrase alone, a mention, is 0.5; a notice or text is 0.5 and half of the share of its
words that stand where they should. The largest one counts.

Scale: two scans of the documents and no shuffle but the counts of the licence words (a fixed vocabulary of a
few hundred words) for the IDF; index and counts have the size of the templates, whatever the input. A file costs its
words and the postings of those that are licence words.

Defined cases: null text is empty: no words, no labels, score 0; a repeated row gives a row each; ties in IDF
go to the word that sorts first, which changes the work but never the result; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


#: Posting lists of a key phrase that are intersected.
POSTINGS = 4
#: Words by which a further key phrase of a template may be off its place: fewer than a clause of a licence has.
DRIFT = 16


@dataclass(frozen=True)
class Template:
    """text: the words looked for; keys: phrases of it that must stand at their place; base: a base phrase."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    def words(self) -> list[bytes]:
        return shared.alnum_words(self.text)

    def key_places(self) -> list[tuple[int, list[bytes]]]:
        words, out = self.words(), []
        for k in self.keys:
            phrase = shared.alnum_words(k)
            at = [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
            if not phrase or not at:
                raise ValueError(f"{self.label}: key phrase {k!r} isn't in the text")
            out.append((at[0], phrase))
        if out != sorted(out):
            raise ValueError(f"{self.label}: key phrases stand in another order in the text")
        return out


#: The base phrases and their labels.
BASE = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
)
#: Openings and notices of public licences, with what may not be missing in them.
TEMPLATES = BASE + (
    Template("mit-notice", "released under the mit license", ("under the mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    Template("gpl-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("of the license or at your option any later version",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Public licence texts, with phrases of each that no copy leaves out.
_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_AS_IS_MIT = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_CLAUSES_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_CLAUSE_3_BSD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_AS_IS_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {0}General Public License for more details."
)
_BSD_KEYS = ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice")
_DISCLAIMED = "merchantability and fitness for a particular purpose are disclaimed"
TEXTS = (
    Template(
        "mit-full",
        _GRANT_MIT + "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS_MIT,
        ("permission is hereby granted free of charge", "this permission notice shall be included in all copies or substantial portions", "the software is provided as is without warranty of any kind"),
    ),
    Template("mit-0", _GRANT_MIT.rsplit(", subject", 1)[0] + ". " + _AS_IS_MIT, ("permission is hereby granted free of charge", "furnished to do so the software is provided as is without warranty of any kind")),
    Template("bsd-2-full", _CLAUSES_BSD + _AS_IS_BSD, (*_BSD_KEYS, _DISCLAIMED)),
    Template("bsd-3-full", _CLAUSES_BSD + _CLAUSE_3_BSD + _AS_IS_BSD, (*_BSD_KEYS, "may be used to endorse or promote products derived from this software", _DISCLAIMED)),
    Template(
        "isc-full",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ("permission to use copy modify", "this permission notice appear in all copies", "disclaims all warranties with regard to this software"),
    ),
    Template(
        "0bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        ("permission to use copy modify", "hereby granted the software is provided as is", "disclaims all warranties with regard to this software"),
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
        "an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
        ("permission is granted to anyone to use this software for any purpose", "the origin of this software must not be misrepresented", "may not be removed or altered from any source distribution"),
    ),
    Template(
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "(the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
        "to whom the Software is furnished to do so, all subject to the following:",
        ("any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "to prepare derivative works of the software"),
    ),
    Template(
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("licensed under the apache license version 2 0", "except in compliance with the license", "unless required by applicable law or agreed to in writing", "specific language governing permissions and limitations"),
    ),
    *(
        Template(f"{label}-notice", _GNU.format(kind, version), (f"gnu {kind.lower()}general public license as published by the free software foundation", f"either version {version.replace('.', ' ')} of the license", "without even the implied warranty"))
        for label, kind, version in (("gpl-2", "", "2"), ("gpl-3", "", "3"), ("lgpl-2.1", "Lesser ", "2.1"), ("lgpl-3", "Lesser ", "3"), ("agpl-3", "Affero ", "3"))
    ),
    Template(
        "mpl-2.0-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file"),
    ),
    Template(
        "unlicense-full",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
        "the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        ("free and unencumbered software released into the public domain", "in jurisdictions that recognize copyright laws"),
    ),
    Template(
        "wtfpl",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. "
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
        ("changing it is allowed as long as the name is changed", "you just do what the fuck you want to"),
    ),
)
TEMPLATES += TEXTS


class Index:
    """Postings of key phrases by their rarest words. df: documents that have each word, of n."""

    def __init__(self, templates: tuple[Template, ...], df: dict[bytes, int], n: int):
        self.templates = templates
        self.words = [t.words() for t in templates]
        self.keys = [t.key_places() for t in templates]
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) for ws in self.words for w in ws}
        #: Distinct key phrases, and how many words each is filed under.
        self.phrases = sorted({tuple(phrase) for keys in self.keys for _, phrase in keys})
        self.filed: list[int] = []
        #: Of each filed word: the phrases, and its place in each.
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, phrase in enumerate(self.phrases):
            rarest = sorted(set(phrase), key=self._rarity)[:POSTINGS]
            self.filed.append(len(rarest))
            for w in rarest:
                self.postings.setdefault(w, []).append((k, phrase.index(w)))
        numbers = {phrase: k for k, phrase in enumerate(self.phrases)}
        self.members = [[(at, numbers[tuple(phrase)]) for at, phrase in keys] for keys in self.keys]
        self.opened: list[list[int]] = [[] for _ in self.phrases]  # templates by their first key phrase
        for t, members in enumerate(self.members):
            self.opened[members[0][1]].append(t)

    def _rarity(self, word: bytes) -> tuple[float, bytes]:
        return -self.idf[word], word

    def phrase_places(self, words: list[bytes]) -> dict[int, list[int]]:
        """Where each key phrase that stands in a file does, rising."""
        own = sorted(self.postings.keys() & set(words), key=self._rarity)
        if not own:
            return {}
        places: dict[bytes, list[int]] = {w: [] for w in own}
        for p, word in enumerate(words):
            if word in places:
                places[word].append(p)
        starts: dict[int, set[int]] = {}
        met: Counter = Counter()
        for w in own:  # the file's licence words, highest IDF first
            for k, q in self.postings[w]:
                if met[k] and not starts[k]:
                    continue
                here = {p - q for p in places[w] if p >= q}
                starts[k] = starts[k] & here if met[k] else here
                met[k] += 1
        out = {}
        for k, found in starts.items():
            phrase = list(self.phrases[k])
            if met[k] == self.filed[k] and (at := sorted(s for s in found if words[s : s + len(phrase)] == phrase)):
                out[k] = at
        return out

    def alignments(self, words: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """(template, start, share of its words in place) of each verified place; a start may be below 0 for a cut template."""
        found = self.phrase_places(words)
        for k in found:
            for t in self.opened[k]:
                (first, _), *rest = self.members[t]
                if not all(m in found for _, m in rest):
                    continue
                for p in found[k]:
                    drifts = [(0, 0)]
                    for at, m in rest:
                        if (drift := _nearest(found[m], p - first + at)) is None:
                            break
                        drifts.append((at, drift))
                    else:
                        yield t, p - first, self._share(t, words, p - first, drifts)

    def _share(self, t: int, words: list[bytes], start: int, drifts: list[tuple[int, int]]) -> float:
        """drifts: from which word of the template on it is off by how many words."""
        own, n, same = self.words[t], len(words), 0
        for (a, drift), (b, _) in zip(drifts, [*drifts[1:], (len(own), 0)]):
            same += sum(0 <= start + drift + i < n and words[start + drift + i] == own[i] for i in range(a, b))
        return same / len(own)

    def score(self, k: int, share: float) -> float:
        return 0.5 if self.templates[k].base else 0.5 + 0.5 * share

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, str, str, float, list[tuple[int, int, float]]]:
        """n_base, first_word, last_word, base_labels, labels, score and all alignments."""
        every = sorted((k, s, self.score(k, share)) for k, s, share in self.alignments(words))
        base = [s for k, s, _ in every if self.templates[k].base]
        base_labels = sorted({self.templates[k].label for k, _, _ in every if self.templates[k].base})
        labels = sorted({self.templates[k].label for k, _, _ in every})
        return len(base), min(base, default=None), max(base, default=None), ",".join(base_labels), ",".join(labels), max((s for _, _, s in every), default=0.0), every


def _nearest(places: list[int], wanted: int) -> int | None:
    """How far the nearest of the rising places is off, the earlier of two; None if it is more than DRIFT words."""
    i = bisect_left(places, wanted)
    best = min((p - wanted for p in places[max(0, i - 1) : i + 1]), key=lambda d: (abs(d), d), default=DRIFT + 1)
    return best if abs(best) <= DRIFT else None


def _document_counts(vocabulary: frozenset[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        df: Counter = Counter()
        for text in b["text"].to_pylist():
            df.update(vocabulary.intersection(shared.alnum_words(text)))
        df[b""] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in df], pa.string()), pa.array(list(df.values()), pa.int64())], ["word", "n"])


def build_index(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> Index:
    """An index with IDF over all documents."""
    vocabulary = frozenset(w for t in templates for w in t.words())
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(shared.lean(lambda it: _document_counts(vocabulary, it)), "word string, n long")
    df = {r["word"].encode(): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row for each template word
    return Index(templates, df, df.pop(b"", 0))


_SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, start: long, score: double>>"


def _scan(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = sent.value
    match = pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())])
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(match)]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    for b in batches:
        rows = []
        for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            words = shared.alnum_words(text)
            *row, every = index.scan(words)
            rows.append((i, len(words), *row, [{"label": index.templates[k].label, "start": s, "score": c} for k, s, c in every]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 9, kinds)], names)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each row of docs: base figures, labels, score, and every match with its place."""
    sent = docs.sparkSession.sparkContext.broadcast(build_index(docs, templates))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(shared.lean(lambda it: _scan(sent, it)), _SCAN)
