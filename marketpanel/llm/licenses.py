"""License scan by conditional compression.

Blocks of words around a cue are compressed alone and with each license notice as a zstandard raw dictionary.
Notices are ranked by how much smaller the block becomes; those that save enough are aligned with it word
by word, and a notice is confirmed only if its names and version numbers are all there and few words differ.
A block is as wide as its notices are long. What lies beside a match is scanned again, until nothing is found.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.llm.common import query, slices, table

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted"
_BSD_CONDITIONS = (
    " provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,"
    " this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
    " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_ADVERTISING = (
    " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement:"
    " This product includes software developed by the organization."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"


_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word in lower case, start, end); marks around words do not count."""
    return [(m[0].lower(), *m.span()) for m in _WORD.finditer(text)]


# Identifiers of the SPDX list that are told by their own line.
SPDX = (
    "Apache-2.0", "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0", "Unlicense", "Zlib", "BSL-1.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
)


def _spdx() -> list[tuple[str, str, str]]:
    """The line of each identifier; all words of the identifier are needed."""
    return [(name, f"SPDX-License-Identifier: {name}", "spdx " + " ".join(w for w, _, _ in words_of(name))) for name in SPDX]


def _creative_commons() -> tuple[tuple[str, str, str], ...]:
    """The long and short notices of the six Creative Commons licenses."""
    out = []
    for kind, names in (
        ("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-ND", "-NoDerivatives"),
        ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives"),
    ):
        needed = kind.lower().replace("-", " ")
        out += [
            (f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons Attribution{names} 4.0 International License.",
             f"creative commons attribution {names.lower().replace('-', ' ')} 4.0"),
            (f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.", f"cc {needed} 4.0"),
            (f"CC-{kind}-4.0", f"License: CC {kind} 4.0", f"cc {needed} 4.0"),
        ]
    return tuple(out)


# Usual notices, as (license, wording, words that must be there). The opening of the BSD licenses
# alone does not tell which of them it is.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License.", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "hereby granted charge obtaining"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero general public 3"),
    ("BSD", _BSD, "redistribution source binary permitted"),
    ("BSD-2-Clause", _BSD + _BSD_CONDITIONS + _BSD_DISCLAIMER, "retain reproduce provided disclaimer"),
    ("BSD-3-Clause", _BSD + _BSD_CONDITIONS + " 3." + _BSD_NAMES + _BSD_DISCLAIMER, "retain reproduce neither endorse promote"),
    ("BSD-4-Clause", _BSD + _BSD_CONDITIONS + _BSD_ADVERTISING + " 4." + _BSD_NAMES + _BSD_DISCLAIMER, "retain reproduce advertising neither endorse promote"),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License.", "3 bsd"),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License.", "2 bsd"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2.0"),
    *_creative_commons(),
    *_spdx(),
)
# An added one of these, or one right before a notice, says that the notice does not hold.
NEGATIONS = frozenset({"not", "never", "no", "cannot", "isn", "aren", "wasn", "weren"})
CUE = re.compile(r"licen[cs]|spdx|hereby granted|redistribution and use", re.IGNORECASE)
REACH = 24  # words of a block on each side of a cue, at least; longer notices have wider blocks
LEAST_REDUCTION = 0.12  # bytes saved, against the notice's own compressed size
MOST_CHANGED = 0.2  # words missing or added, against those of the notice
LEVEL = 13  # finds matches of short words
SLICE = 8 << 20

class Notices:
    """The notices with a compressor for each."""

    def __init__(self, templates=TEMPLATES):
        import zstandard

        self.rows = []
        for name, wording, needed in templates:
            words = [w for w, _, _ in words_of(wording)]
            held = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.rows.append((name, words, set(needed.split()), zstandard.ZstdCompressor(level=LEVEL, dict_data=held)))
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.sizes = [len(self.plain.compress(" ".join(words).encode())) for _, words, _, _ in self.rows]
        # Notices by the reach of their blocks: one with words added fits on either side of its cue.
        self.reaches: dict[int, list[int]] = {}
        long = [math.ceil(len(words) * (1 + MOST_CHANGED)) for _, words, _, _ in self.rows]
        for k, n in enumerate(long):
            self.reaches.setdefault(REACH if n <= REACH else max(long), []).append(k)

    def ranked(self, block: list[str], notices: list[int] | None = None) -> list[tuple[float, int]]:
        """(reduction, notice) of the notices that make the block smaller, the best first: bytes saved against
        the compressed size of the notice, so that long blocks don't hide short notices."""
        data = " ".join(block).encode()
        alone = len(self.plain.compress(data))
        kept = range(len(self.rows)) if notices is None else notices
        sizes = [((alone - len(self.rows[k][3].compress(data))) / self.sizes[k], k) for k in kept]
        return sorted((x for x in sizes if x[0] >= LEAST_REDUCTION), key=lambda x: (-x[0], x[1]))

    def aligned(self, notice: int, block: list[str]) -> tuple[int, int, int, str] | None:
        """(first word, end, equal words, differences) of the notice in the block if the wording confirms it."""
        _, words, needed, _ = self.rows[notice]
        matcher = SequenceMatcher(None, words, block, autojunk=False)
        parts = [p for p in matcher.get_matching_blocks() if p.size]
        if not parts:
            return None
        # Stray matches far from the longest part are left out; long notices may drift more.
        longest, drift = max(parts, key=lambda p: p.size), max(2, int(MOST_CHANGED * len(words)))
        parts = [p for p in parts if abs((p.b - p.a) - (longest.b - longest.a)) <= drift]
        first, end = parts[0].b, parts[-1].b + parts[-1].size
        found = {w for p in parts for w in words[p.a:p.a + p.size]}
        kept = {k for p in parts for k in range(p.a, p.a + p.size)}
        inside = {k for p in parts for k in range(p.b, p.b + p.size)}
        missing = [w for k, w in enumerate(words) if k not in kept]
        added = [block[k] for k in range(first, end) if k not in inside]
        if NEGATIONS & {*added, *block[max(0, first - 2):first]}:
            return None
        if not needed <= found or len(missing) + len(added) > MOST_CHANGED * len(words):
            return None
        return first, end, len(kept), " ".join([f"-{w}" for w in missing] + [f"+{w}" for w in added])

    def best(self, words: list[str], at: int, low: int, high: int) -> tuple[int, float, int, int, str] | None:
        """(notice, reduction, first word, end, differences) of the best notice around the word `at`, between
        the words `low` and `high`: most equal words less differences, then fewest differences, then best ranked."""
        best = None
        for reach, notices in self.reaches.items():
            lo, hi = max(low, at - reach), min(high, at + reach + 1)
            block = words[lo:hi]
            for reduction, k in self.ranked(block, notices):
                if place := self.aligned(k, block):
                    first, end, equal, differences = place
                    changed = len(differences.split())
                    key = (changed - equal, changed, -reduction)
                    if best is None or key < best[0]:
                        best = (key, (k, reduction, lo + first, lo + end, differences))
        return best and best[1]


def scan(notices: Notices, text: str) -> tuple[int, list[dict]]:
    """(candidate blocks, confirmed matches) of a text, matches in its order and apart from each other."""
    if not CUE.search(text):
        return 0, []
    places = words_of(text)
    words, starts = [w for w, _, _ in places], [s for _, s, _ in places]
    candidates, out = 0, []
    taken: list[tuple[int, int]] = []  # matches as words, in order
    for cue in CUE.finditer(text):
        at = max(0, bisect_right(starts, cue.start()) - 1)
        # A block ends at the matches beside it; it is scanned until its cue is in a match or nothing is found.
        while True:
            k = bisect_right(taken, (at, len(words)))
            low, high = taken[k - 1][1] if k else 0, taken[k][0] if k < len(taken) else len(words)
            if at < low:
                break
            candidates += 1
            found = notices.best(words, at, low, high)
            if found is None:
                break
            notice, reduction, first, end, differences = found
            insort(taken, (first, end))
            out.append({
                "license": notices.rows[notice][0], "start": places[first][1], "end": places[end - 1][2],
                "reduction": round(reduction, 4), "differences": differences,
            })
    return candidates, sorted(out, key=lambda m: m["start"])


_MATCHES = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("differences", pa.string())]))


def find_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_candidates, matches) of each row of `docs` (doc_id, text); spans are in code points.

    A null or empty text has none. Texts are scanned one by one and whole, so nulls and repeats in doc_id do
    no harm; an empty table gives an empty result. Several notices in a text are found each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = Notices(templates)
        for batch in slices(batches, "text", SLICE):
            found = [scan(notices, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found], _MATCHES)],
                names=["doc_id", "n_candidates", "matches"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(
        run, "doc_id bigint, n_candidates bigint, matches array<struct<license:string,start:bigint,end:bigint,reduction:double,differences:string>>"
    )


@query("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string")))
    return found.select(
        "doc_id", "n_candidates", F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"), F.array_join(F.transform("matches", lambda m: m["differences"]), "|").alias("differences"),
    )
