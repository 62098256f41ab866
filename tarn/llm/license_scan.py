"""License scans with a positional rare-token index over licence templates.

Index: word -> postings (template, position, IDF) of the template's rarest words: positions of highest IDF over templates, until they
hold the share 1 - `least` of the template's IDF mass and VOTES more. A label needs an alignment of file and template on which words of
at least the share `least` of that mass agree, so words of at most 1 - `least` of it differ, and indexed words of at least VOTES must
agree: no such alignment is missed. A scan looks up the words of all files of a call in the index at once and sums IDF by (file,
template, file position minus template position); only alignments with enough votes are scored over the whole template. A label also
needs every mandatory key phrase of the template inside the alignment, as consecutive words. The cost grows with the postings that a
file's words have, not with the number of templates. Templates are the bodies of short licences, the standard notices of long ones, their
first sentences, and one-line notices. Plain base phrases give labels of their own.

Defined cases: a null text counts as empty; texts of any length are scanned whole; texts without words have null positions, empty
labels and score 0; score is 1 with a base label, else the greatest share on an alignment with enough votes, or 0; of alignments that tie
any may give the label; ids are passed through, null and repeated ones too; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.tokens import as_bytes, chunks, slices, words

#: Share of a template's IDF mass on which indexed words must agree before the whole template is looked at.
VOTES = 0.15
#: Alignments scored at once.
ALIGNMENTS = 4096

#: Base phrases and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, words of the template, mandatory key phrases; first sentences, then one-line notices, then whole bodies.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("related or neighboring rights",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license 2 0", ("apache license 2 0",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("bsd", "licensed under the bsd 2 clause license", ("bsd 2 clause",)),
    ("bsd", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    ("gpl", "gnu general public license version", ("gnu general public license",)),
    ("lgpl", "gnu lesser general public license version", ("gnu lesser general public license",)),
    ("mpl-2.0", "licensed under the mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    ("mpl-2.0", "licensed under the mozilla public license 2 0", ("mozilla public license 2 0",)),
    ("isc", "released under the isc license", ("isc license",)),
    ("cc0", "released under cc0 1 0", ("cc0 1 0",)),
    ("unlicense", "released under the unlicense", ("the unlicense",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("permission is hereby granted free of charge",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", ("with or without fee is hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", ("redistribution and use in source and binary forms",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache license version 2 0",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses", ("gnu general public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain", ("free and unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution", ("the origin of this software must not be misrepresented",)),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor", ("to any person or organization",)),
)


@dataclass(frozen=True)
class Index:
    """Sorted word hashes with their spelling; templates as (label, words, IDF of each, key phrases); the postings of word w are
    begins[w] to begins[w + 1] of (template, position, IDF); need: IDF on which a template's postings must agree; base phrases."""

    vocabulary: np.ndarray
    spelling: tuple[bytes, ...]
    templates: tuple
    phrases: tuple
    begins: np.ndarray
    template: np.ndarray
    position: np.ndarray
    weight: np.ndarray
    need: np.ndarray


@lru_cache(maxsize=4)
def build_index(templates: tuple = TEMPLATES, phrases: tuple = BASE_PHRASES, least: float = 0.6) -> Index:
    texts = [t for _, t, _ in templates] + [k for _, _, keys in templates for k in keys] + [p for p, _ in phrases]
    spelled: dict[bytes, int] = {}
    for text in texts:
        w = words([text.encode()])
        for i in range(len(w.starts)):
            spelled[w.word(i)] = int(w.hashes[i])
    ordered = sorted(spelled, key=spelled.get)
    number = {w: i for i, w in enumerate(ordered)}
    vocabulary = np.array([spelled[w] for w in ordered], np.uint64)
    frequency = np.zeros(len(ordered))
    numbered = [np.array([number[w] for w in text.encode().split()]) for _, text, _ in templates]
    for t in numbered:
        frequency[np.unique(t)] += 1
    idf = np.log((1 + len(templates)) / (1 + frequency)) + 1
    built, postings, need = [], [], []
    for k, ((label, _, keys), t) in enumerate(zip(templates, numbered, strict=True)):
        mass = idf[t].sum()
        rarest = np.argsort(-idf[t], kind="stable")
        held = np.cumsum(idf[t][rarest])
        rarest = rarest[: np.searchsorted(held, (1 - least + VOTES) * mass) + 1]
        postings += [(int(t[i]), k, int(i)) for i in rarest]
        need.append(idf[t][rarest].sum() - (1 - least) * mass - 1e-9 * mass)
        built.append((label, t, idf[t], tuple(tuple(number[w] for w in key.encode().split()) for key in keys)))
    word, template, position = np.array(sorted(postings)).T
    begins = np.searchsorted(word, np.arange(len(ordered) + 1))
    base = tuple((tuple(number[w] for w in p.encode().split()), label) for p, label in phrases)
    return Index(vocabulary, tuple(ordered), tuple(built), base, begins, template, position, idf[word], np.array(need))


def _phrase_at(ids: np.ndarray, phrase: tuple[int, ...]) -> np.ndarray:
    """Places where the phrase's words stand consecutively."""
    n = len(phrase)
    if len(ids) < n:
        return np.zeros(0, np.int64)
    hit = ids[: len(ids) - n + 1] == phrase[0]
    for d in range(1, n):
        hit &= ids[d : len(ids) - n + 1 + d] == phrase[d]
    return np.flatnonzero(hit)


def candidates(texts: list[np.ndarray], index: Index) -> dict[int, list[tuple[int, np.ndarray]]]:
    """For each text (words as numbers of the index, -1 for others), (template, shifts) of the alignments with enough votes."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    every = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    known = np.flatnonzero(every >= 0)
    word = every[known]
    n = index.begins[word + 1] - index.begins[word]
    known, word, n = known[n > 0], word[n > 0], n[n > 0]
    if not len(known):
        return {}
    text = np.repeat(np.arange(len(texts)), lengths)[known]
    place = known - (np.cumsum(lengths) - lengths)[text]
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(index.begins[word], n)
    longest = max(len(t[1]) for t in index.templates)
    span = int(lengths.max()) + longest
    key = (np.repeat(text, n) * len(index.templates) + index.template[at]) * span + np.repeat(place, n) - index.position[at] + longest
    key, which = np.unique(key, return_inverse=True)
    votes = np.bincount(which, index.weight[at])
    pair, shift = key // span, key % span - longest
    keep = votes >= index.need[pair % len(index.templates)]
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    pair, shift = pair[keep], shift[keep]
    cuts = np.flatnonzero(pair[1:] != pair[:-1]) + 1
    for some in np.split(np.arange(len(pair)), cuts) if len(pair) else ():
        out.setdefault(int(pair[some[0]]) // len(index.templates), []).append((int(pair[some[0]]) % len(index.templates), shift[some]))
    return out


def scores(ids: np.ndarray, template: tuple, shifts: np.ndarray) -> np.ndarray:
    """Of each alignment the share of the template's IDF mass on which file and template agree."""
    _, wanted, weight, _ = template
    out = np.zeros(len(shifts))
    for low in range(0, len(shifts), ALIGNMENTS):
        at = shifts[low : low + ALIGNMENTS, None] + np.arange(len(wanted))
        same = (at >= 0) & (at < len(ids)) & (ids[np.clip(at, 0, len(ids) - 1)] == wanted)
        out[low : low + ALIGNMENTS] = same @ weight / weight.sum()
    return out


def _has_phrases(ids: np.ndarray, template: tuple, shifts: np.ndarray) -> bool:
    """Whether all key phrases stand inside one of the alignments."""
    size = len(template[1])
    for shift in shifts.tolist():
        inside = ids[max(shift, 0) : max(shift + size, 0)]
        if all(len(_phrase_at(inside, k)) for k in template[3]):
            return True
    return False


def scan_text(ids: np.ndarray, found: list[tuple[int, np.ndarray]], index: Index, least: float) -> tuple:
    """(n_base, first, last, base labels, labels, score) of a text and its candidates()."""
    places, base = [], set()
    present = np.bincount(ids[ids >= 0], minlength=len(index.vocabulary)) > 0
    for phrase, label in index.phrases:
        if all(present[w] for w in phrase):
            at = _phrase_at(ids, phrase)
            if len(at):
                places.append(at)
                base.add(label)
    labels, score = set(base), 1.0 if base else 0.0
    for k, shifts in found:
        template = index.templates[k]
        shares = scores(ids, template, shifts)
        score = max(score, float(shares.max()))
        if template[0] not in labels and _has_phrases(ids, template, shifts[shares >= least]):
            labels.add(template[0])
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    return len(at), int(at.min()) if len(at) else None, int(at.max()) if len(at) else None, ",".join(sorted(base)), ",".join(sorted(labels)), round(min(score, 1.0), 6)


def number_words(texts: list[bytes], index: Index) -> list[np.ndarray]:
    """For each text, its words as numbers of the index or -1; a word whose hash matches is compared with the spelling."""
    out = []
    spelled = np.frombuffer(b"".join(index.spelling), np.uint8)
    sizes = np.array([len(x) for x in index.spelling])
    begins = np.cumsum(sizes) - sizes
    for low, high in chunks(texts):
        w = words(texts[low:high])
        at = np.minimum(np.searchsorted(index.vocabulary, w.hashes), len(index.vocabulary) - 1)
        ids = np.where(index.vocabulary[at] == w.hashes, at, -1)
        ids[(ids >= 0) & (sizes[ids] != w.ends - w.starts)] = -1
        known = np.flatnonzero(ids >= 0)
        if len(known):
            n = sizes[ids[known]]
            first = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(first, n)
            same = np.frombuffer(w.data, np.uint8)[np.repeat(w.starts[known], n) + inside] == spelled[np.repeat(begins[ids[known]], n) + inside]
            ids[known[~np.logical_and.reduceat(same, first)]] = -1
        out += np.split(ids, w.first[1:-1])
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, phrases: tuple = BASE_PHRASES, least: float = 0.6) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build_index(templates, phrases, least)
        for batch in slices(batches):
            numbered = number_words(as_bytes(batch.column(1)), index)
            found = candidates(numbered, index)
            made = [(len(ids), *(scan_text(ids, found.get(i, []), index, least) if (ids >= 0).any() else (0, None, None, "", "", 0.0))) for i, ids in enumerate(numbered)]
            columns = list(zip(*made, strict=True)) if made else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
