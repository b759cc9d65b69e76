"""License scan: places of known phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, one of the overlapping windows of a long line, or one of the overlapping windows of the whole text's words
across line ends, as notices are often wrapped. Windows are sized by the template: at least twice its words, half of which
the next window shares, so a notice lies whole in one of them however it is wrapped. The tokens of a notice are its words; those of a short
statement (fewer than ``SHORT`` words), whose words may well stand near each other by chance, are its pairs of consecutive words, and its windows are small. A template is
found in a block if at least ``THRESHOLD`` of the template's distinct tokens are among the block's. Notices of different licenses may share that many; so of
a template that another one with another label holds to the threshold, the tokens that the other lacks must all be there, and if it lacks
none, the other one is taken where a block meets both. A window of the whole text names a template only where
it holds more of it than every line block within.

Tokens are ordered by how often they occur in the whole
corpus, rarest first. A template is indexed by the prefix of its rarest tokens that any block meeting the
threshold must share (prefix filter); blocks with too few tokens are passed over (length filter), and so are pairs whose
tokens left after a match, in that order, can't reach the threshold (positional filter). What remains is compared
exactly, so no block that meets the threshold is missed. Templates are a parameter of fixed size and go to every task.

Words: A-Z lower-cased, then runs of ASCII letters and digits and of any character beyond ASCII. Defined cases: a null
text is empty: no words, empty labels, null first_word and last_word, score 0; null and repeated ``doc_id`` are scanned row
by row; of blocks or templates equal in containment all count; a text of any length is scanned whole, one at a time; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.words import WORD, released, slices

THRESHOLD = 0.9
#: Phrases of the base scan and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Templates of the similarity scan, and their labels: short statements, and public license notices as published.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa-4.0"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd-4.0"),
    ("this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "cc-by-nc-sa-4.0"),
    ("this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "cc-by-nc-nd-4.0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version",
        "gpl-2.0-or-later",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "gpl-3.0-or-later",
    ),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
        "either version 2 1 of the license or at your option any later version",
        "lgpl-2.1-or-later",
    ),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "agpl-3.0-or-later",
    ),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
        "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and "
        "contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
        "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not "
        "limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
        "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd",
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission",
        "bsd-3-clause",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies",
        "isc",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "zlib",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code "
        "form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
]
#: Words of a window at least, for statements of fewer than SHORT words and for notices; a window is a power of two, twice a template's words
#: or more, and the next begins half of it further on.
SHORT, SMALL_WINDOW, WINDOW = 16, 32, 128
SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"
BLOCKS = "doc_id long, first_word long, n_words long, label string, template int, containment double, text string"


def pairs(found: list[bytes]) -> list[bytes]:
    """Consecutive words, two by two."""
    return [a + b" " + b for a, b in zip(found, found[1:], strict=False)]


def template_sets(templates: list[tuple[str, str]]) -> list[frozenset[bytes]]:
    """The tokens of each template: pairs of words of a short one, words of others. A pair holds a blank, so the two are never the same."""
    found = [WORD.findall(t.encode().lower()) for t, _ in templates]
    return [frozenset(pairs(f) if 1 < len(f) < SHORT else f) for f in found]


def windows(templates: list[tuple[str, str]] = TEMPLATES) -> list[int]:
    """Size of each template's windows; those of short ones are smaller than all others."""
    sizes = [len(WORD.findall(t.encode())) for t, _ in templates]
    return [max(SMALL_WINDOW if n < SHORT else WINDOW, 1 << (2 * n - 1).bit_length()) for n in sizes]


def tokens(block: list[bytes], window: int) -> set[bytes]:
    """What a block is compared by: in small windows its words and its pairs of words."""
    return {*block, *pairs(block)} if window < WINDOW else set(block)


def rivals(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> tuple[list[frozenset[bytes]], set[tuple[int, int]]]:
    """Words that each template must have in a block besides the threshold, and pairs (template, one that is taken instead of it)."""
    sets = template_sets(templates)
    must, instead = [], set()
    for t, s in enumerate(sets):
        others = [u for u in range(len(sets)) if templates[u][1] != templates[t][1] and len(s & sets[u]) >= threshold * len(s) - 1e-9]
        must.append(frozenset().union(*(s - sets[u] for u in others)))
        instead |= {(t, u) for u in others if s < sets[u]}
    return must, instead


def cuts(n: int, window: int) -> range:
    """Where the windows of n words begin."""
    return range(0, max(1, n - window // 2), window // 2)


def corpus_order(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> dict[bytes, int]:
    """Place of each template word by its count over all texts, rarest first; one row a template word reaches the driver."""
    vocabulary = frozenset().union(*template_sets(templates))
    # a pair is only put together where its first word begins one of the templates'
    heads = {w.partition(b" ")[0] for w in vocabulary if b" " in w}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in (t for some in slices(batch, 0) for t in some.column(0).to_pylist()):
                found = WORD.findall((text or "").encode().lower())
                for w in filter(vocabulary.__contains__, found):
                    count[w] += 1
                for w in filter(vocabulary.__contains__, (a + b" " + b for a, b in zip(found, found[1:], strict=False) if a in heads)):
                    count[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count]), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = dict.fromkeys(vocabulary, 0) | {r["word"].encode(): r["n"] for r in found}
    return {w: k for k, w in enumerate(sorted(count, key=lambda w: (count[w], w)))}


class Scanner:
    def __init__(self, order: dict[bytes, int], templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD):
        self.order, self.labels = order, [label for _, label in templates]
        self.sets = template_sets(templates)
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.must, self.instead = rivals(templates, threshold)
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases]
        # by window size: the templates with each word in their prefix, and its place there
        self.index: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for t, (s, window) in enumerate(zip(self.sets, windows(templates), strict=True)):
            for i, w in enumerate(sorted(s, key=order.__getitem__)[: len(s) - self.need[t] + 1]):
                self.index.setdefault(window, {}).setdefault(w, []).append((t, i))

    def base(self, found: list[bytes]) -> list[tuple[int, str]]:
        """(word number, label) of every place where a phrase stands."""
        joined, places = b" " + b" ".join(found) + b" ", []
        for phrase, label in self.phrases:
            at, number, counted = joined.find(phrase), 0, 0
            while at >= 0:
                # words are counted on from the last place
                number, counted = number + joined.count(b" ", counted, at), at
                places.append((number, label))
                at = joined.find(phrase, at + 1)
        return places

    def block(self, found: list[bytes], window: int) -> list[tuple[int, float]]:
        """(template, containment) of the templates of a window size that a block meets."""
        index, own = self.index[window], tokens(found, window)
        if own.isdisjoint(index):
            return []
        ordered = sorted(own.intersection(self.order), key=self.order.__getitem__)
        n, shared = len(ordered), {}
        for j, w in enumerate(ordered):
            for t, i in index.get(w, ()):
                if n < self.need[t] or t in shared and shared[t] < 0:
                    continue
                held = shared.get(t, 0) + 1
                shared[t] = held if held + min(len(self.sets[t]) - i, n - j) - 1 >= self.need[t] else -1
        out = {}
        for t, held in shared.items():
            if held > 0 and (both := len(self.sets[t] & own)) >= self.need[t] and self.must[t] <= own:
                out[t] = both / len(self.sets[t])
        return [(t, c) for t, c in out.items() if not any((t, u) in self.instead for u in out)]

    def blocks(self, lines: list[list[bytes]], window: int) -> Iterator[tuple[int, list[bytes]]]:
        """(first word, words) of every block that lies in one line."""
        at = 0
        for found in lines:
            if 0 < len(found) <= window:
                yield at, found
            elif found:
                yield from ((at + a, found[a : a + window]) for a in cuts(len(found), window))
            at += len(found)

    def met(self, text: str, found: list[bytes]) -> list[tuple[int, list[bytes], int, float]]:
        """(first word, words, template, containment) of every block and template that it meets; ``found``: the text's words."""
        out, split = [], None
        for window, index in self.index.items():
            if index.keys().isdisjoint(found) and (window >= WINDOW or index.keys().isdisjoint(pairs(found))):
                continue
            split = [WORD.findall(line) for line in text.encode().lower().split(b"\n")] if split is None else split
            lines = [(a, b, *hit) for a, b in self.blocks(split, window) for hit in self.block(b, window)]
            starts = [a for a, *_ in lines]
            out += lines
            for a in cuts(len(found), window):
                b = found[a : a + window]
                if hits := self.block(b, window):
                    within = [(t, c) for at, own, t, c in lines[bisect_left(starts, a) : bisect_left(starts, a + len(b))] if at + len(own) <= a + len(b)]
                    out += [(a, b, t, c) for t, c in hits if not any(u == t and d >= c for u, d in within)]
        return out

    def scan(self, text: str | None) -> tuple:
        found = WORD.findall((text or "").encode().lower())
        places = self.base(found)
        met = [(a, t, c) for a, _, t, c in self.met(text or "", found)]
        base = sorted({label for _, label in places})
        more = {self.labels[t] for _, t, _ in met}
        starts = [a for a, _ in places]
        score = 1.0 if places else max((c for *_, c in met), default=0.0)
        return len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(more | set(base))), score, len({a for a, *_ in met})


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its words, base places and labels, all labels and score."""
    scanner = Scanner(corpus_order(docs, options.get("templates", TEMPLATES)), **options)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()]
    names = [c.split()[0] for c in SCANNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (s for batch in batches for s in slices(batch, 1)):
            rows = [scanner.scan(t) for t in some.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), SCANNED)


def license_blocks(docs: DataFrame, **options) -> DataFrame:
    """One row per block and template met: where the block is, its label, containment and words."""
    scanner = Scanner(corpus_order(docs, options.get("templates", TEMPLATES)), **options)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.string()]
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (s for batch in batches for s in slices(batch, 1)):
            rows = [(d, a, len(b), scanner.labels[t], t, c, b" ".join(b).decode()) for d, text in zip(*(some.column(k).to_pylist() for k in (0, 1)), strict=True) for a, b, t, c in scanner.met(text or "", WORD.findall((text or "").encode().lower()))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), BLOCKS)


def oracle() -> str:
    """The scan by brute force: every block against every template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES)
    must, instead = rivals()
    names = [sorted(w.decode() for w in s) for s in must]
    sets = [sorted(w.decode() for w in s) for s in template_sets(TEMPLATES)]
    templates = ", ".join(f"({k}, {sets[k]!r}, {names[k]!r}::VARCHAR[], '{label}', {window})" for k, ((_, label), window) in enumerate(zip(TEMPLATES, windows(), strict=True)))
    others = ", ".join(str(x) for x in sorted(instead))
    return f"""
WITH p(phrase, label) AS (VALUES {phrases}),
t(template, words, must, label, size) AS (VALUES {templates}),
o(template, other) AS (VALUES {others}),
z AS (SELECT DISTINCT size FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS low FROM documents),
w AS (SELECT r, doc_id, low, regexp_extract_all(low, '{word}') AS words FROM d),
b AS (
  SELECT r, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(phrase)] = phrase)) AS pos FROM w, p
),
base AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY r),
l AS (SELECT r, regexp_extract_all(unnest(string_split(low, chr(10))), '{word}') AS words FROM d),
k AS (
  SELECT r, size, words AS block FROM l, z WHERE len(words) BETWEEN 1 AND size
  UNION ALL
  SELECT r, size, words[a + 1 : a + size] FROM (SELECT r, size, words, unnest(range(0, len(words) - size // 2, size // 2)) AS a FROM l, z WHERE len(words) > size)
  UNION ALL
  SELECT r, size, words[a + 1 : a + size] FROM (SELECT r, size, words, unnest(range(0, greatest(1, len(words) - size // 2), size // 2)) AS a FROM w, z)
),
n AS (
  SELECT row_number() OVER () AS id, r, size,
    list_distinct(CASE WHEN size < {WINDOW} THEN list_concat(block, list_transform(range(1, len(block)), lambda i: block[i] || ' ' || block[i + 1])) ELSE block END) AS block FROM k
),
m AS (
  SELECT id, r, template, label, len(list_intersect(words, block)) / len(words) AS c FROM n JOIN t USING (size)
  WHERE len(list_intersect(words, block)) >= ceil({THRESHOLD} * len(words) - 1e-9) AND list_has_all(block, must)
),
f AS (SELECT r, label, c FROM m WHERE NOT EXISTS (FROM o JOIN m q ON q.template = o.other WHERE o.template = m.template AND q.id = m.id)),
met AS (SELECT r, max(c) AS c FROM f GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM f UNION SELECT r, label FROM b) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN met USING (r) LEFT JOIN every USING (r)
"""
