"""Licence scanning: a trained paragraph classifier whose predictions a template comparison confirms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import kernels

# Notices of each licence family, one paragraph each.
TEMPLATES = {
    "mit": (
        "MIT License",
        "The MIT License",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is available under the terms of the MIT License.",
        "Distributed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Apache License 2.0",
        "Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl": (
        "GNU General Public License",
        "GNU GPL",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is licensed under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "agpl": (
        "GNU Affero General Public License",
        "GNU AGPL",
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "lgpl": (
        "GNU Lesser General Public License",
        "GNU LGPL",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "bsd": (
        "BSD License",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "3-Clause BSD License",
        "2-Clause BSD License",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-clause license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "isc": (
        "ISC License",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "boost": (
        "Boost Software License",
        "Boost Software License 1.0",
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "epl": (
        "Eclipse Public License",
        "Eclipse Public License 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "unlicense": (
        "The Unlicense",
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain.",
    ),
    "mpl": (
        "Mozilla Public License",
        "Mozilla Public License 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "CC BY-NC 4.0",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "cc-by-sa": (
        "CC BY-SA 4.0",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by": (
        "CC BY 4.0",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc0": (
        "CC0 1.0",
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Dedicated to the public domain under the Creative Commons Zero license.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) by the authors. All rights reserved.",
        "Copyright 2024 Example Inc. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
# Identifiers of each family in licence expressions.
IDENTIFIERS = {
    "mit": ("MIT",),
    "apache": ("Apache-2.0",),
    "gpl": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv2", "GPLv3"),
    "agpl": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3"),
    "lgpl": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPLv2", "LGPLv3"),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "isc": ("ISC",),
    "boost": ("BSL-1.0",),
    "epl": ("EPL-1.0", "EPL-2.0"),
    "unlicense": ("Unlicense",),
    "mpl": ("MPL-1.1", "MPL-2.0"),
    "cc-by-nc": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"),
    "cc-by-sa": ("CC-BY-SA-4.0",),
    "cc-by": ("CC-BY-4.0",),
    "cc0": ("CC0-1.0",),
}
# Words that name a family. A notice that has such words in its template needs them in the text.
NAMES = {
    "mit": ("mit",),
    "apache": ("apache",),
    "gpl": ("gnu general public", "gpl", "gplv2", "gplv3"),
    "agpl": ("affero general public", "agpl", "agplv3"),
    "lgpl": ("lesser general public", "lgpl", "lgplv2", "lgplv3"),
    "bsd": ("bsd",),
    "isc": ("isc",),
    "boost": ("boost software", "bsl"),
    "epl": ("eclipse public", "epl"),
    "unlicense": ("unlicense",),
    "mpl": ("mozilla public", "mpl"),
    "cc-by-nc": ("by nc", "attribution noncommercial"),
    "cc-by-sa": ("by sa", "attribution sharealike"),
    "cc-by": ("cc by", "commons attribution"),
    "cc0": ("cc0", "commons zero"),
    "proprietary": ("rights reserved",),
}
#: What may not follow a name of this family, as it would be another's.
NOT_AFTER = {"cc-by": ("nc", "sa", "noncommercial", "sharealike")}
for _family, _ids in IDENTIFIERS.items():  # notices that are made of identifiers; a single word says nothing alone
    for _id in _ids:
        _more = (f"Licensed under {_id}", f"Released under {_id}", f"SPDX-License-Identifier: {_id}", f"License: {_id}", *((_id,) if re.search("[0-9]", _id) else ()))
        TEMPLATES[_family] = tuple(dict.fromkeys([*TEMPLATES[_family], *_more]))
FAMILIES = tuple(TEMPLATES)
UNKNOWN = len(FAMILIES)
FEATURES = 1 << 16
#: Paragraphs of the corpus that the classifier learns as unknown, and the documents they come from (by smallest hash).
NEGATIVES, NEGATIVE_DOCS, NEGATIVE_BYTES = 4000, 200, 1 << 14
VARIANTS, STEPS, RATE, DECAY = 24, 300, 4.0, 1e-4
#: Share of held-back unknown paragraphs that the calibrated limit lets pass, and the share of a template's word pairs
#: (or of the paragraph's, where it is the shorter) that confirms a prediction.
FALSE_SHARE, CONFIRM = 0.001, 0.6
#: Word pairs that must be shared; a line or template with fewer is confirmed only by the same words in the same order.
LEAST_PAIRS = 3
#: Words around a name that a stretch may have more than its template, words between copyright and "all rights reserved", and
#: bytes of a sentence that is compared as a whole.
SLACK, HOLDER, SHORT_BYTES = 3, 14, 80
#: What every notice has at least: a word of a name, an identifier or a licence's text.
_HINT = re.compile(
    rb"licen[sc]e|rights reserved|copyright|permission|redistribut|warrant|unencumbered|public domain|free software|obligation"
    rb"|\b(?:a?gpl\w*|lgpl\w*|apache|cc0|cc[ -]by|bsd|mpl|epl|bsl|unlicense|gnu)\b|\b(?:mit|isc)\s+(?:or|and|with)\s"
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of single words and pairs of neighbours, for each row after the other, and the rows' offsets."""
    starts, ends, first = kernels.words(buf, offsets, _OUTSIDE)
    h = kernels.mix(kernels.span_hash(kernels.prefix_hash(buf), starts, ends) + (ends - starts).astype(np.uint64))
    both = np.zeros(2 * len(h), np.int64)
    both[::2] = (h % np.uint64(FEATURES)).astype(np.int64)
    pairs = np.zeros(len(h), np.int64)
    if len(h) > 1:
        pairs[:-1] = (kernels.mix(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(FEATURES)).astype(np.int64)
    last = first[1:][np.diff(first) > 0] - 1
    pairs[last] = both[2 * last]  # a row's last word has no pair: it counts twice
    both[1::2] = pairs
    return both, 2 * first


def _plain(buf: np.ndarray) -> np.ndarray:
    """Lower-cased for A-Z, in one spelling of licence; every byte keeps its place."""
    return np.frombuffer(kernels.lower_ascii(buf).tobytes().replace(b"licence", b"license"), np.uint8)


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = kernels.flatten(pa.array(texts, pa.string()))
    return _plain(buf), offsets


def _sums(weights: np.ndarray, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean weight row of each text's features."""
    total = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights[features], 0, np.float64)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _examples(negatives: list[str]) -> tuple[list[str], np.ndarray]:
    """Templates with words dropped or added around them, and the negatives; deterministic."""
    rng = np.random.default_rng(7)
    texts, classes = [], []
    filler = " ".join(negatives[:200]).split() or ["word"]
    for k, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            words = template.split()
            texts.append(template)
            classes.append(k)
            for _ in range(VARIANTS):
                # a template too short for a comparison of pairs keeps all its words
                kept = [w for w in words if len(words) <= LEAST_PAIRS or rng.random() > 0.08] or words
                around = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 1 + max(1, len(words) // 3)))]
                cut = rng.integers(0, len(around) + 1)
                texts.append(" ".join([*around[:cut], *kept, *around[cut:]]))
                classes.append(k)
    return [*texts, *negatives], np.array([*classes, *[UNKNOWN] * len(negatives)])


def train(negatives: list[str]) -> dict:
    """Multinomial logistic regression on sparse word and word-pair counts: full-batch gradient steps from zero.

    A fifth of the examples is held back: the limit is the smallest probability of any family (0.5 at least) that lets at
    most FALSE_SHARE of the held-back unknown paragraphs pass. Families that look alike share it, and the likeliest is taken.
    """
    texts, classes = _examples(negatives)
    features, offsets = _features(*_bytes(texts))
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    used, number = np.unique(features, return_inverse=True)
    size = np.maximum(np.diff(offsets), 1)
    held = np.arange(len(texts)) % 5 == 4
    k = len(FAMILIES) + 1
    target = np.eye(k)[classes]
    share = 1 / np.bincount(classes[~held], minlength=k).clip(1)
    importance = np.where(held, 0, share[classes] / k)[:, None]
    weights, scale = np.zeros((k, len(used))), 30.0
    for _ in range(STEPS):
        z = np.stack([np.bincount(rows, w[number], len(texts)) for w in weights], 1)
        push = (target - _softmax(scale * z / size[:, None])) * importance / size[:, None]
        step = np.stack([np.bincount(number, column[rows], len(used)) for column in push.T.copy()])
        weights += RATE * (scale * step - DECAY * weights)
    full = np.zeros((FEATURES, k), np.float32)
    full[used] = scale * weights.T
    p = _softmax(_sums(full, features, offsets))
    others = np.sort(1 - p[held & (classes == UNKNOWN)][:, UNKNOWN]) if (held & (classes == UNKNOWN)).any() else np.zeros(1)
    limit = max(0.5, float(others[min(len(others) - 1, int(np.ceil((1 - FALSE_SHARE) * len(others))))]))
    return {"weights": full, "limit": limit}


def sample(docs: DataFrame) -> list[str]:
    """At most NEGATIVES paragraphs, without licence words and unlike all templates, of the NEGATIVE_DOCS different texts of at most NEGATIVE_BYTES
    bytes with the smallest hashes: the bounded sample that the unknown class is fitted on. Hashes are chosen first, so
    that few texts reach the driver."""
    hashed = docs.filter(F.octet_length("__text") <= NEGATIVE_BYTES).select(F.xxhash64("__text").alias("h"), "__text")
    chosen = hashed.select("h").distinct().orderBy("h").limit(NEGATIVE_DOCS)
    found = hashed.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.min("__text").alias("__text"))
    lines = [x for r in sorted(found.collect()) for x in r["__text"].split("\n") if len(x.split()) > 1]
    lines = [x for x in lines if not re.search("licen[sc]|copyright|rights reserved|creative commons|gnu|spdx", x, re.I)][:NEGATIVES]
    templates = _known()
    return [x for x in lines if not any(confirmed(x.lower().encode(), f, templates) for f in range(UNKNOWN))]


def _pairs(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words[:-1], words[1:], strict=True))


def _known() -> list[list[tuple[list[bytes], set]]]:
    """The words and word pairs of each family's templates."""
    words = [[_WORD.findall(t.lower().encode()) for t in TEMPLATES[f]] for f in FAMILIES]
    return [[(w, _pairs(w)) for w in of_family] for of_family in words]


def confirmed(line: bytes, family: int, templates: list[list[tuple[list[bytes], set]]]) -> bool:
    """Whether enough of a template's word pairs are in the lower-cased line, or of the line's in the template; where
    either has too few pairs, whether the words are the same."""
    words = _WORD.findall(line)
    mine = _pairs(words)
    for theirs, pairs in templates[family]:
        shared, least = len(mine & pairs), min(len(mine), len(pairs))
        if (shared >= max(CONFIRM * least, LEAST_PAIRS)) if least >= LEAST_PAIRS else words == theirs:
            return True
    return False


class Notices:
    """Templates as words, where they have a family's name or else words that few texts have, and what each name begins with."""

    def __init__(self):
        split = lambda t: _WORD.findall(_plain(np.frombuffer(t.encode(), np.uint8)).tobytes())
        self.names = {f: [tuple(n.encode().split()) for n in names] for f, names in NAMES.items()}
        self.known = _known()
        #: By first word: (family, the other words of the name or anchor, of template words and pairs those that have it, with its place in them).
        self.starts: dict[bytes, list] = {}
        self.short: dict[tuple, set[int]] = {}
        for k, family in enumerate(FAMILIES):
            anchored: dict[tuple, list] = {}
            for text in TEMPLATES[family]:
                words = split(text)
                pairs = _pairs(words)
                if len(pairs) < LEAST_PAIRS:
                    self.short.setdefault(tuple(words), set()).add(k)
                    continue
                found = {(n, at) for n in self.names[family] for at in range(len(words)) if tuple(words[at : at + len(n)]) == n}
                # A text of a licence that does not name it is looked for at each pair of longer words.
                found = found or {((a, b), at) for at, (a, b) in enumerate(zip(words[:-1], words[1:], strict=True)) if min(len(a), len(b)) >= 5}
                for anchor, at in found:
                    anchored.setdefault(anchor, []).append((words, pairs, at))
            for anchor, uses in anchored.items():
                self.starts.setdefault(anchor[0], []).append((k, anchor, uses))
        ids = {i.lower(): k for k, f in enumerate(FAMILIES) for i in IDENTIFIERS.get(f, ())}
        self.ids = {i.encode(): k for i, k in ids.items()}
        one = "(?:" + "|".join(re.escape(i) for i in sorted(ids, key=len, reverse=True)) + ")"
        link = r"\s+(?:or|and|with)\s+"
        self.expression = re.compile(rf"^\W*(?:spdx-license-identifier\s*:|licen[cs]e\s*:)?\s*\(*{one}\)*(?:{link}\(*{one}\)*)+\W*$".encode())
        self.id = re.compile(rf"(?<![\w.-]){one}(?![\w-])".encode())

    def candidates(self, words: list[bytes], used: set[bytes]):
        """(family, first word, end) of the stretches of a paragraph in which enough of a template's word pairs are."""
        for i, word in enumerate(words):
            if word not in used:
                continue
            for k, anchor, uses in self.starts[word]:
                if tuple(words[i : i + len(anchor)]) != anchor or words[i + len(anchor) : i + len(anchor) + 1] and words[i + len(anchor)].decode("latin1") in NOT_AFTER.get(FAMILIES[k], ()):
                    continue
                for theirs, pairs, at in uses:
                    first, end = max(0, i - at - SLACK), min(len(words), i - at + len(theirs) + SLACK)
                    here = [p for p in zip(words[first : end - 1], words[first + 1 : end], strict=True)]
                    hit = [j for j, p in enumerate(here) if p in pairs]
                    if len({here[j] for j in hit}) >= max(CONFIRM * len(pairs), LEAST_PAIRS):
                        yield k, first + hit[0], first + hit[-1] + 2
                        break
        for i in range(len(words) - 2):
            if words[i : i + 3] == [b"all", b"rights", b"reserved"] and b"copyright" in words[max(0, i - HOLDER) : i]:
                yield FAMILIES.index("proprietary"), i, i + 3


def _blocks(text: bytes) -> Iterator[tuple[int, int]]:
    """Begin and end of the paragraphs: lines between blank ones."""
    at = 0
    for gap in re.finditer(rb"\n[ \t\r]*\n", text):
        if gap.start() > at:
            yield at, gap.start()
        at = gap.end()
    if at < len(text):
        yield at, len(text)


def notices(text: bytes, model: dict, known: Notices) -> list[tuple[int, int, int]]:
    """(family, start, end) of the notices of a text, given lower-cased; ends are those of the lines that they lie in.

    A stretch counts if a template confirms it and the classifier finds the same family in it. Sentences and lines of few words are
    compared as wholes; identifiers in a licence expression are each read as if alone; a licence that an "or" or "and" joins to a
    found one needs its short name only.
    """
    found: set[tuple[int, int, int]] = set()
    begins = lambda at: text.rfind(b"\n", 0, at) + 1
    ends = lambda at: len(text) if (n := text.find(b"\n", at)) < 0 else n

    def agreed(phrases: list[bytes], families: list[int]) -> list[bool]:
        p = _softmax(_sums(model["weights"], *_features(*_bytes([x.decode("utf-8", "replace") for x in phrases]))))
        return [1 - q[UNKNOWN] >= model["limit"] and int(q[:UNKNOWN].argmax()) == k for q, k in zip(p, families, strict=True)]

    guesses: dict[tuple[int, int, int], bytes] = {}
    for s, e in _blocks(text):
        part = text[s:e]
        if not _HINT.search(part):
            continue
        spans = [(m.start() + s, m.end() + s) for m in _WORD.finditer(part)]
        words = [text[a:b] for a, b in spans]
        used = known.starts.keys() & set(words)
        stretches = list(known.candidates(words, used)) if used else []
        for k, first, end in stretches:
            guesses[k, spans[first][0], spans[end - 1][1]] = b" ".join(words[first:end])
        for piece in re.finditer(rb"[^\n]+", part):
            line, at = piece.group(), piece.start() + s
            if known.expression.match(line):
                for m in known.id.finditer(line):
                    guesses[known.ids[m.group()], at, at + len(line)] = b"spdx license identifier " + m.group()
            for x in re.finditer(rb"(?:[^.;!?]|[.;!?](?=\S))+", line):
                if 0 < len(x.group()) <= SHORT_BYTES:
                    for k in known.short.get(tuple(_WORD.findall(x.group())), ()):
                        guesses[k, at + x.start(), at + x.end()] = x.group()
        for k, first, end in stretches:  # "… or <short name>" beside a stretch, on either side
            for size in (2, 3, 4):
                for a, b, near in ((end, end + SLACK + size, words[end : end + SLACK + size]), (first - SLACK - size, first, words[max(0, first - SLACK - size) : first])):
                    for j in range(len(near) - size + 1):
                        joined = b"or" in near or b"and" in near
                        for other in known.short.get(tuple(near[j : j + size]), ()) if joined else ():
                            start = max(a, 0) + j
                            if other != k and FAMILIES[other] != "proprietary":
                                guesses[other, spans[start][0], spans[start + size - 1][1]] = b" ".join(near[j : j + size])
    if guesses:
        for (k, a, b), good in zip(guesses, agreed(list(guesses.values()), [g[0] for g in guesses]), strict=True):
            if good:
                found.add((k, begins(a), ends(b)))
    return sorted(found, key=lambda f: (f[1], f[2], f[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licence families that each text's notices declare: (id_col, licenses, n_paragraphs, spans), one row for each
    input row.

    See notices() for what counts as one. licenses lists the families in name order (null if none), n_paragraphs counts
    the lines or runs of lines that hold a family's notice, spans lists family:start:end in UTF-8 bytes of these. Null and
    empty texts have none; a text of any length is read whole, paragraph by paragraph; a null id stays null; repeated rows are scanned
    each; other columns are ignored. An empty table trains without corpus negatives and returns nothing.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(sample(docs)))

    def run(batches: Iterator[pa.RecordBatch]):
        model, known = sent.value, Notices()
        for part in kernels.slices(batches, "__text"):
            buf, offsets = kernels.flatten(kernels.column(part, "__text"))
            low, rows = _plain(buf).tobytes(), []
            for s, e in zip(offsets[:-1], offsets[1:], strict=True):
                hits = notices(low[s:e], model, known) if _HINT.search(low, s, e) else []
                names = ",".join(sorted({FAMILIES[f] for f, _, _ in hits})) or None
                rows.append((names, len(hits), ",".join(f"{FAMILIES[f]}:{a}:{b}" for f, a, b in hits)))
            columns = zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [kernels.column(part, "__id"), *(pa.array(c, t) for c, t in columns)], names=[id_col, "licenses", "n_paragraphs", "spans"]
            )

    return docs.mapInArrow(run, f"`{id_col}` long, licenses string, n_paragraphs long, spans string")
