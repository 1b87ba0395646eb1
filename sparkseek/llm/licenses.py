"""Licence scans by a positional index of rare words.

Templates are lower-case words (runs of letters and digits).  A word's IDF is taken over the templates; each template is indexed by its RARE words
of highest IDF, with their positions.  Each text's words are looked up in the index; a hit at position p of a word that a template
has at position q votes for a beginning at p - q.  A place is a candidate where at least SHARE of a template's indexed
positions vote within SLACK words of it; it is a finding where, besides, every mandatory phrase of the template occurs
in the stretch it covers.  Of overlapping candidates of one template, that with the most votes, then the first, counts.

Defined results: null, empty and blank texts have no findings; texts of any length are scanned whole; a text with several
licences, or one several times, has a finding for each; repeated rows each get theirs; an empty table gives an empty
result; other columns are kept and columns of the operator's names are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hidden, small_batches
from .text import lean, parts, utf8, word_hashes

RARE, SHARE, SLACK = 8, 0.75, 3

_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_GNU = "you should have received a copy of the gnu {} along with this program"

#: name: (text, mandatory phrases)
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "MIT": (_MIT, ("permission is hereby granted free of charge", "without restriction", "sublicense")),
    "MIT-notice": ("released under the MIT License", ("mit license",)),
    "MIT-notice-2": ("licensed under the MIT License", ("licensed under the mit license",)),
    "ISC": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted", "appear in all copies")),
    "BSD": (_BSD, ("redistribution and use in source and binary forms", "are permitted provided that")),
    "BSD-notice": ("licensed under the BSD 3 Clause License", ("bsd 3 clause",)),
    "Apache-2.0": ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses license 2 0")),
    "Apache-2.0-notice": ("licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    "GPL-3.0": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("terms of the gnu general public license", "version 3 of the license")),
    "GPL-2.0": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("terms of the gnu general public license", "version 2 of the license")),
    "GPL-3.0-notice": ("licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    "GPL-2.0-notice": ("licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    "LGPL": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("terms of the gnu lesser general public license",)),
    "LGPL-notice": ("licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    "AGPL-3.0": ("under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3 of the license")),
    "AGPL-notice": ("licensed under the GNU Affero General Public License", ("gnu affero general public license",)),
    "GNU-copy": (_GNU.format("general public license"), ("a copy of the gnu general public license",)),
    "MPL-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    "EPL-2.0": ("this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    "Unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("unencumbered software released into the public domain",)),
    "Zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "in no event will the authors be held liable")),
    "BSL-1.0": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy", "covered by this license")),
    "WTFPL": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", ("changing it is allowed",)),
    "CC0-1.0": ("to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights", ("associated cc0 with this work",)),
    "CC-BY-4.0": ("licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    "CC-BY-SA-4.0": ("licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4 0",)),
    **{f"CC-{c.replace(' ', '-').upper()}-4.0-notice": (f"licensed under cc {c} 4 0", (f"cc {c} 4 0",)) for c in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")},
    "All-rights-reserved": ("all rights reserved", ("all rights reserved",)),
}

_SPLIT = np.full(256, 32, np.uint8)
_SPLIT[128:] = np.arange(128, 256)
for _c in range(128):
    if chr(_c).isalnum():
        _SPLIT[_c] = ord(chr(_c).lower())


def split(text: str) -> list[str]:
    """Lower-case runs of ASCII letters and digits and of whatever isn't ASCII."""
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def hashed(words: list[str]) -> list[int]:
    raw = " ".join(words).encode()
    return word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()


class Index:
    """Postings of each template's rarest words."""

    def __init__(self, templates: tuple, rare: int):
        self.names = [n for n, _ in templates]
        texts = [split(t) for _, (t, _) in templates]
        self.sizes = [len(t) for t in texts]
        self.phrases = [[hashed(split(p)) for p in ps] for _, (_, ps) in templates]
        df = Counter(w for t in texts for w in set(t))
        self.idf = {w: math.log((1 + len(texts)) / (0.5 + n)) for w, n in df.items()}
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.indexed = []
        for i, t in enumerate(texts):
            chosen = set(sorted(set(t), key=lambda w: (-self.idf[w], w))[:rare])
            places = [q for q, w in enumerate(t) if w in chosen]
            self.indexed.append(len(places))
            for q, h in zip(range(len(t)), hashed(t)):
                if t[q] in chosen:
                    self.postings[h].append((i, q))
        self.keys = np.array(sorted(self.postings), np.uint64)

    def scan(self, words: np.ndarray, at: list[int], share: float, slack: int) -> list[tuple[int, int, int]]:
        """(template, first word, votes) of the findings in one text, given the places of indexed words."""
        begins: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in at:
            for i, q in self.postings[int(words[p])]:
                begins[i].append((p - q, q))
        out = []
        for i, own in begins.items():
            need = math.ceil(share * self.indexed[i] - 1e-9)
            if len({q for _, q in own}) < need:
                continue
            own.sort()
            candidates = []
            for b in sorted({b for b, _ in own}):
                votes = len({q for c, q in own[_least(own, b - slack) : _least(own, b + slack + 1)]})
                if votes >= need:
                    candidates.append((-votes, b))
            taken: list[int] = []
            for votes, b in sorted(candidates):
                if all(abs(b - c) >= self.sizes[i] for c in taken) and self.holds(i, words, b - slack, b + self.sizes[i] + slack):
                    taken.append(b)
                    out.append((i, max(b, 0), -votes))
        return sorted(out, key=lambda f: (f[1], self.names[f[0]]))

    def holds(self, i: int, words: np.ndarray, a: int, b: int) -> bool:
        """Whether every mandatory phrase of template i occurs among words a to b."""
        stretch = words[max(a, 0) : b].tolist()
        return all(any(stretch[k : k + len(p)] == p for k in range(len(stretch) - len(p) + 1)) for p in self.phrases[i])


def _least(own: list[tuple[int, int]], b: int) -> int:
    from bisect import bisect_left

    return bisect_left(own, (b, -1))


@lru_cache(4)
def index(templates: tuple, rare: int) -> Index:
    return Index(templates, rare)


def _scanner(templates: tuple, rare: int, share: float, slack: int):
    def scan(column: pa.Array) -> pa.Array:
        own = index(templates, rare)
        data, off = utf8(column)
        counts, rows = [0], []
        for i, j, d, o in parts(data, off):
            words, _, _, bounds = word_hashes(_SPLIT[d], o)
            where = np.minimum(np.searchsorted(own.keys, words), max(len(own.keys) - 1, 0))
            hit = np.flatnonzero(own.keys[where] == words) if len(own.keys) else np.zeros(0, np.int64)
            cut = np.searchsorted(hit, bounds)
            for k in range(j - i):
                a, b = int(cut[k]), int(cut[k + 1])
                found = own.scan(words[bounds[k] : bounds[k + 1]], (hit[a:b] - bounds[k]).tolist(), share, slack) if b > a else []
                rows += [{"license": own.names[t], "first_word": p, "votes": v, "rare_words": own.indexed[t]} for t, p, v in found]
                counts.append(len(found))
        kind = pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("votes", pa.int32()), ("rare_words", pa.int32())])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.array(rows, kind))

    return F.arrow_udf(lean(scan), "array<struct<license:string,first_word:int,votes:int,rare_words:int>>")


def licenses(df: DataFrame, text: str = "text", templates: dict | None = None, rare: int = RARE, share: float = SHARE, slack: int = SLACK) -> DataFrame:
    """A row per finding: df's columns but the text, license, first_word, votes, rare_words; one narrow stage, no shuffle."""
    own = tuple((TEMPLATES if templates is None else templates).items())
    names = ("license", "first_word", "votes", "rare_words")
    others = [c for c in df.columns if c != text and c not in names]
    small_batches(df.sparkSession)
    name = hidden(df, "f")
    rows = df.select(*others, F.explode(_scanner(own, rare, share, slack)(F.col(text).cast("string"))).alias(name))
    return rows.select(*others, *(F.col(name)[c].alias(c) for c in names))
