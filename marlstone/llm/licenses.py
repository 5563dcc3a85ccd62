"""Licence scans: a trained paragraph classifier whose predictions a template comparison confirms.

A softmax regression over sparse word n-grams (1 to 3 words) sorts paragraphs into licence
families, "unknown" (reads like a licence, of no listed family) and "none". It is trained
on the notices below with words dropped, added and changed, on notices of invented
licences, and on ordinary sentences with licence words. A temperature fitted on held-out
variants calibrates its probabilities; a family below LEAST_PROBABILITY is unknown, and so
is one of which no notice shares enough word pairs with the paragraph.

A paragraph is a line, or a window of WINDOW words of a longer one, each starting half a
window on; and, as notices are often wrapped, a block of lines without an empty one between
them, joined, with the same windows. Blocks only add families to what their lines gave, and
unknown lines inside a paragraph of a family are part of its notice. A paragraph is looked
at if it has one of the SIGNS, one of the NAMES or a word of the notices of which any
paragraph that shares enough word pairs with a notice has one. So no listed family that the
classifier would accept is passed over; "unknown" needs a sign or a name, since the
classifier alone takes some text of invented words for licences. Where it finds no family in
a paragraph that names a licence, the first name says it (AGPL is unknown). MIT and ISC
count as names beside "licence" or "Lizenz", or as the whole paragraph.

Defined results: null text is empty; a text of any length is scanned whole; documents
without licences get an empty string; every row is scanned on its own, so null or repeated
doc_ids don't matter; columns besides doc_id and text are not read, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import text_or_empty
from marlstone.shipping import ship

# Customary short notices of public licences.
NOTICES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the GPL v2.",
    ),
    "lgpl": (
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "bsd": (
        "Distributed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
}
# Fixed values end.
ORDINARY = (
    "The driver showed a license to the officer.", "A fishing license is sold at the counter.", "The permission to build was granted in spring.", "Copyright law is taught in the second year.",
    "All rights reserved.", "The public domain of the town lies by the river.", "We hold a licence to serve drinks.", "The foundation gave free software to schools.", "Version 2.0 of the plan was released.",
    "The apache tribe and the gnu in the park.", "Students at mit work under a grant.", "The general public was admitted.", "The source of the river is public.", "Attribution of the painting is doubtful.",
)
OTHER = (
    "Licensed under the {} License.", "Released under the {} License, version {}.", "This work is licensed under the {} Public License.", "Distributed under the terms of the {} licence agreement.",
    "Use is subject to the {} Commercial License.", "SPDX-License-Identifier: {}-{}.0", "Copyright (c) the {} authors. All rights reserved under the {} license.",
)
SIGNS = r"(?i)licen[sc]|lizen[sz]|copyright|permission|redistribut|public domain|creative commons|\bcc[ -]by|\bgpl|\bspdx|\bcc0"
NONE, UNKNOWN = "none", "unknown"
_LICENCE = r"(?:[ -](?:public[ -])?(?:licen[sc]e|lizenz))"
#: Bare names, as manifests and German texts have them.
NAMES = {
    "apache-2.0": rf"\bapache(?:[ -]software)?(?:{_LICENCE}?,?[ -](?:version |v\.? ?)?2(?:\.0)?\b|{_LICENCE})",
    "mpl-2.0": rf"\bmpl[ -]?(?:version |v\.? ?)?2(?:\.0)?\b|\bmozilla{_LICENCE}",
    "bsd": rf"\bbsd(?:[ -][0234][ -]clause|{_LICENCE})|\b[0234][ -]clause[ -]bsd\b",
    UNKNOWN: r"\bagpl|\baffero\b",
    "lgpl": r"\blgpl",
    "gpl": r"\bgpl",
    "mit": rf"\bmit{_LICENCE}",
    "isc": rf"\bisc{_LICENCE}",
}
#: Every name has one of these.
_HINTS = ("apache", "mpl", "mozilla", "bsd", "gpl", "affero", "mit", "isc")
_NAMED = [*((f, re.compile(r, re.I)) for f, r in NAMES.items()), ("mit", re.compile(r"^\W*MIT\W*$")), ("isc", re.compile(r"^\W*ISC\W*$"))]
CLASSES = (NONE, UNKNOWN, *NOTICES)
WINDOW = 60
LEAST_PROBABILITY, LEAST_SHARED = 0.5, 0.6
VARIANTS = 60


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())


def grams(text: str) -> set[str]:
    w = ["^", *words(text)]
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def training_paragraphs(seed: int = 3) -> list[tuple[str, str]]:
    r, out = random.Random(seed), []
    filler = lambda: "".join(r.choice("aeiostrnlmd") for _ in range(r.randint(2, 9)))

    def varied(text: str) -> str:
        w = [x for x in text.split() if r.random() > 0.06]
        if r.random() < 0.3 and w:
            w[r.randrange(len(w))] = filler()
        lead, tail = [filler() for _ in range(r.choice((0, 0, 0, 2, 6)))], [filler() for _ in range(r.choice((0, 0, 3, 10)))]
        return " ".join([*lead, *w, *tail])

    for family, notices in NOTICES.items():
        out += [(family, varied(r.choice(notices))) for _ in range(VARIANTS)]
    out += [(UNKNOWN, varied(r.choice(OTHER).format(filler().title(), r.randint(1, 9)))) for _ in range(4 * VARIANTS)]
    out += [(NONE, varied(r.choice(ORDINARY))) for _ in range(4 * VARIANTS)]
    out += [(NONE, " ".join(filler() for _ in range(r.randint(3, 40)))) for _ in range(2 * VARIANTS)]
    return out


def named(paragraph: str) -> str | None:
    """The family (or unknown) of the first licence name in the paragraph."""
    low = paragraph.lower()
    if not any(h in low for h in _HINTS):
        return None
    found = [(m.start(), f) for f, r in _NAMED if (m := r.search(paragraph))]
    return min(found)[1] if found else None


def covering(pairs: set[tuple[str, str]]) -> set[str]:
    """The longest words that are in so many of the pairs that less than LEAST_SHARED of them have none."""
    chosen: set[str] = set()
    for w in sorted({w for p in pairs for w in p}, key=lambda w: (-len(w), w)):
        if sum(not chosen & set(p) for p in pairs) < LEAST_SHARED * len(pairs):
            break
        chosen.add(w)
    return chosen


class Classifier:
    """Trained on the driver, in seconds, on the fixed recipe above; no corpus text enters."""

    def __init__(self):
        rows = training_paragraphs()
        random.Random(5).shuffle(rows)
        bags = [grams(t) for _, t in rows]
        seen: dict[str, int] = {}
        for bag in bags:
            for g in bag:
                seen[g] = seen.get(g, 0) + 1
        self.places = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 8))}
        x = np.array([self._row(b) for b in bags], np.float32)
        y = np.array([CLASSES.index(c) for c, _ in rows])
        held = np.arange(len(y)) % 4 == 0
        self.weights, self.bias = self._fit(x[~held], y[~held])
        scores = x[held] @ self.weights + self.bias
        loss = lambda t: -np.log(self._soft(scores / t)[np.arange(held.sum()), y[held]] + 1e-12).mean()
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
        self.held_out = float((scores.argmax(1) == y[held]).mean())
        self.pairs = {f: [self._pairs(n) for n in notices] for f, notices in NOTICES.items()}
        self.clues = sorted({w for notices in self.pairs.values() for n in notices for w in covering(n)})
        #: What every paragraph has that is anything but none.
        names = [h for h in _HINTS if h not in ("mit", "isc")]  # these have a sign beside them or a line to themselves
        self.hints = re.compile("|".join([SIGNS, *names, r"(?m:^[^\w\n]*(?:mit|isc)[^\w\n]*$)", *map(re.escape, self.clues)]))

    def _row(self, bag: set[str]) -> np.ndarray:
        row = np.zeros(len(self.places), np.float32)
        at = [self.places[g] for g in bag if g in self.places]
        row[at] = 1.0 / np.sqrt(max(len(at), 1))
        return row

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, target = np.zeros((x.shape[1], len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32), np.eye(len(CLASSES), dtype=np.float32)[y]
        speed_w, speed_b, ahead = np.zeros_like(w), np.zeros_like(b), 0.9
        for _ in range(150):
            gap = (self._soft(x @ w + b) - target) / len(y)
            speed_w = ahead * speed_w - 12.0 * (x.T @ gap + 1e-5 * w)
            speed_b = ahead * speed_b - 12.0 * gap.sum(axis=0)
            w, b = w + speed_w, b + speed_b
        return w, b

    @staticmethod
    def _pairs(text: str) -> set[tuple[str, str]]:
        w = words(text)
        return set(zip(w, w[1:], strict=False)) or {(x, "") for x in w}

    def __call__(self, paragraph: str) -> tuple[str, float]:
        """The class and its calibrated probability."""
        p = self._soft((self._row(grams(paragraph)) @ self.weights + self.bias) / self.temperature)
        best = int(p.argmax())
        name = CLASSES[best]
        if name == NONE:
            return name, float(p[best])
        if name != UNKNOWN:
            if p[best] < LEAST_PROBABILITY or self.shared(paragraph, name) < LEAST_SHARED:
                name = UNKNOWN
        return name, float(p[best])

    def shared(self, paragraph: str, family: str) -> float:
        """The largest share of the word pairs of one of the family's notices that the paragraph has."""
        own = self._pairs(paragraph)
        return max(len(own & t) / len(t) for t in self.pairs[family])


def _windows(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the part of a text, or of its windows if it has more than WINDOW words."""
    found = [m.span() for m in re.compile(r"\S+").finditer(text, start, end)] if end - start > WINDOW else []
    if len(found) <= WINDOW:
        yield start, end
        return
    for k in range(0, len(found) - WINDOW // 2, WINDOW // 2):
        yield found[k][0], found[min(k + WINDOW, len(found)) - 1][1]


def paragraphs(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is a block of lines) of all paragraphs."""
    block: list[tuple[int, int]] = []

    def blocks() -> Iterator[tuple[int, int, bool]]:
        if len(block) > 1:
            yield from ((*w, True) for w in _windows(text, block[0][0], block[-1][1]))
        block.clear()

    for line in re.finditer(r"[^\n]*\n?", text):
        start, end = line.start(), line.start() + len(line[0].removesuffix("\n"))
        if not any(c.isalnum() for c in line[0]):
            yield from blocks()
            continue
        yield from ((*w, False) for w in _windows(text, start, end))
        block.append((start, end))
    yield from blocks()


def judged(paragraph: str, classifier: Classifier) -> tuple[str, float]:
    """The family, unknown or none, and how much of a notice of the family it has: what the classifier says, or else a sign or a name."""
    paragraph = re.sub(r"-[^\S\n]*\n\W*", "-", paragraph)  # a word that was parted at the end of a line
    name, _ = classifier(paragraph)
    if name in (NONE, UNKNOWN):
        return named(paragraph) or (name if re.search(SIGNS, paragraph) else NONE), 1.0
    return name, classifier.shared(paragraph, name)


def settled(found: Iterable[tuple[int, int, bool, str, float]]) -> list[tuple[int, int, str]]:
    """(start, end, family or unknown) from judged paragraphs (start, end, block, name, share).

    A line whose notice is less whole than that of a block of another family around it is
    part of the block's notice. Of overlapping paragraphs of a family the first counts,
    lines before blocks; unknown lines count outside of families.
    """
    some = [x for x in found if x[3] != NONE and not (x[2] and x[3] == UNKNOWN)]
    around = [x for x in some if x[2]]
    some = [x for x in some if x[2] or x[3] == UNKNOWN or not any(b[0] < x[1] and x[0] < b[1] and b[3] != x[3] and b[4] > x[4] for b in around)]
    spans: dict[str, list[tuple[int, int]]] = {}
    kept: list[tuple[int, int, str]] = []
    meets = lambda name, start, end: any(s < end and start < e for s, e in spans.get(name, ()))
    for start, end, _, name, _ in sorted(some, key=lambda x: (x[3] == UNKNOWN, x[2], x[0])):
        if not any(meets(n, start, end) for n in ([*spans] if name == UNKNOWN else [name])):
            kept.append((start, end, name))
        spans.setdefault(name, []).append((start, end))
    return sorted(kept)


def scan(text: str, classifier: Classifier) -> list[tuple[int, int, str]]:
    """(start, end, family or unknown) of licence paragraphs."""
    hints = [m.start() for m in classifier.hints.finditer(text)]
    looked_at = lambda start, end: bisect.bisect_left(hints, start) < bisect.bisect_left(hints, end)
    return settled((start, end, block, *judged(text[start:end], classifier)) for start, end, block in (paragraphs(text) if hints else ()) if looked_at(start, end))


def _scan(classifier: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = pc.match_substring_regex(batch["text"], classifier.hints.pattern).to_pylist()
            rows = []
            for at, some in enumerate(signed):
                found = scan(batch["text"][at].as_py(), classifier) if some else []
                known = sorted({f for _, _, f in found if f != UNKNOWN})
                rows.append((",".join(known), len(found), sum(f == UNKNOWN for _, _, f in found), ",".join(f"{f}:{s}:{e}" for s, e, f in found)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "licenses", "n_found", "n_unknown", "spans"])

    return run


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, n_found, n_unknown, spans): licenses are the families found, sorted; spans are family:start:end."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(_scan(Classifier()), "doc_id long, licenses string, n_found long, n_unknown long, spans string")
