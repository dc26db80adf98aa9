"""License scans: MinHash bands over overlapping windows, verified by exact containment.

Method: a template's set is its distinct five-word shingles (a template of fewer words is
one shingle). For each size class of templates (at most ``m`` shingles, a power of two) a
document is read in windows of ``2 * m`` shingles that start every ``m / 2``, so an occurrence stretched
by up to a half lies whole in one. A window that contains a template of ``s > m / 2``
shingles to 0.8 has a similarity of at least 0.8 * s / (2 * m + 0.2 * s), over 0.19; with
``BANDS`` bands of one MinHash value the chance that no band meets is (1 - 0.19)**BANDS,
about 1e-6. Only windows that hold some shingle of a template can meet in a band
of one value, so others are not hashed. Every retrieved window is verified by exact containment of
the template's shingles.

The templates are notices by which a license is declared, common wordings, and whole
texts of short licenses. They are broadcast with the task (a parameter of the call, at most ``TEMPLATES``
of at most ``TEMPLATE_WORDS`` words). Words are lower-cased runs of letters, digits and
bytes beyond ASCII.

Defined cases: null, empty and wordless texts have no license; a template without words
is refused; a document that holds a template several times is reported once, with the
best containment; rows keep their multiplicity; rows without id are reported with it null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .near_dup import _mix

WIDTH, THRESHOLD = 5, 0.8
BANDS = 64
TEMPLATES, TEMPLATE_WORDS = 10_000, 20_000

# Notices by which licenses are declared
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "reserved": "All rights reserved. No part of this publication may be reproduced",
    "reserved-short": "All rights reserved.",
}
# Common wordings by family; of at most eight words, so that each word (a version, say) must be there
WORDINGS = {
    "MIT": ("under the MIT License", "under an MIT License", "under MIT License", "under the terms of the MIT License", "under the X11 License", "The MIT License (MIT)"),
    "Apache-2.0": ("under the Apache License 2.0", "under the Apache 2.0 License", "under Apache License 2.0", "under Apache 2.0", "of the Apache License, Version 2.0", "under the Apache-2.0 License"),
    "Apache-1.1": ("under the Apache License, Version 1.1", "The Apache Software License, Version 1.1"),
    "BSD-2-Clause": ("under the BSD 2-Clause", "under the 2-Clause BSD", "BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("under the BSD 3-Clause", "under the 3-Clause BSD", "BSD 3-Clause License", "under the New BSD License", "under the modified BSD License"),
    "BSD": ("under the BSD License", "under a BSD License", "under a BSD-style License", "under the terms of the BSD License"),
    "ISC": ("under the ISC License", "of the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Zlib": ("under the zlib License", "under the zlib/libpng License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    "MPL-1.1": ("under the Mozilla Public License 1.1", "the Mozilla Public License Version 1.1", "under the MPL 1.1"),
    "MPL-2.0": ("under the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0", "the Mozilla Public License, Version 2.0", "under the MPL 2.0"),
    "EPL-1.0": ("the Eclipse Public License v1.0", "the Eclipse Public License 1.0", "the Eclipse Public License, Version 1.0"),
    "EPL-2.0": ("the Eclipse Public License v2.0", "the Eclipse Public License 2.0", "the Eclipse Public License v. 2.0", "the Eclipse Public License, Version 2.0"),
    "CDDL": ("the Common Development and Distribution License",),
    "Artistic": ("under the Artistic License", "of the Artistic License"),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "under the Boost Software License"),
    "Unlicense": ("under the Unlicense", "This is free and unencumbered software released into the public domain"),
    "WTFPL": ("under the WTFPL", "Do What The Fuck You Want To Public License"),
    "public-domain": ("released into the public domain", "dedicated to the public domain", "placed in the public domain", "This work is in the public domain"),
    "CC0-1.0": ("CC0 1.0 Universal", "under CC0", "under the CC0", "under Creative Commons Zero", "under a Creative Commons CC0"),
    "GFDL": ("the GNU Free Documentation License", "under the GFDL"),
    "OFL-1.1": ("the SIL Open Font License", "under the Open Font License"),
    "ODbL": ("the Open Database License", "under the ODbL"),
    "Python": ("the Python Software Foundation License", "under the PSF License"),
}
# The GNU licenses, as named and with their versions
GNU = {"GPL": ("General Public License", ("1", "2", "3")), "LGPL": ("Lesser General Public License", ("2.1", "3")), "AGPL": ("Affero General Public License", ("3",))}
# The Creative Commons licenses, as named
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
# Further identifiers that SPDX lines name
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "Unlicense", "WTFPL", "CC0-1.0", "OFL-1.1", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CDDL-1.0", "Artistic-2.0")


def _wordings() -> dict[str, str]:
    """Every wording as a template, named by its license and its number."""
    found = {name: list(texts) for name, texts in WORDINGS.items()}
    for short, (full, versions) in GNU.items():
        found[short] = [f"under the GNU {full}", f"of the GNU {full}", f"under the GNU {short}", f"under the {short}"]
        for v in versions:
            found[f"{short}-{v if '.' in v else v + '.0'}"] = [f"{lead}{full}{at}{v}" for lead in ("the GNU ", "GNU ") for at in (", version ", " v", " v.", " ")] + [f"{at}{short}{sep}{v}" for at in ("under the ", "under ", "under the GNU ") for sep in (" version ", " v", "v", "-", "")]
    for short, full in COMMONS.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            found[f"CC-{short}-{v}"] = [f"under CC {short} {v}", f"under a CC {short} {v}", f"under the CC {short} {v}", f"Commons {full} {v}", f"SPDX-License-Identifier: CC-{short}-{v}"]
    for name in SPDX:
        found.setdefault(name, []).append(f"SPDX-License-Identifier: {name}")
    return {f"{name}-wording-{i}": text for name, texts in found.items() for i, text in enumerate(texts, 1)}


NOTICES |= _wordings() | {f"{name}-text": text for name, text in TEXTS.items()}

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_PERMUTE = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The hashes of the text's word shingles in order; none where there are fewer words."""
    raw = _FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    if not raw.size:
        return np.zeros(0, np.uint64)
    word = _WORD[raw]
    edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if starts.size < width:
        return np.zeros(0, np.uint64)
    first = np.zeros(raw.size, np.int64)
    first[starts] = starts
    offset = np.arange(raw.size) - np.maximum.accumulate(first)
    power = np.full(int(offset.max()) + 1, _M, np.uint64)
    power[0] = 1
    value = np.where(word, _BYTE[raw] * np.cumprod(power)[offset], np.uint64(0))
    w = _mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
    out = np.zeros(w.size - width + 1, np.uint64)
    for k in range(width):
        out = _mix(out * _M + w[k : k + out.size])
    return out


class Index:
    """Templates by size class, with their sets and MinHash values."""

    def __init__(self, templates: dict[str, str], width: int = WIDTH, threshold: float = THRESHOLD):
        if len(templates) > TEMPLATES:
            raise ValueError(f"more than {TEMPLATES} templates")
        self.threshold, self.classes = threshold, {}
        for name, text in sorted(templates.items()):
            words = next((n for n in range(width, 0, -1) if shingles(text, n).size), 0)
            own = np.unique(shingles(text, words)) if words else np.zeros(0, np.uint64)
            if not words or own.size > TEMPLATE_WORDS:
                raise ValueError(f"template {name!r} has no words or too many")
            size = 1 << int(own.size - 1).bit_length()
            self.classes.setdefault((words, size), []).append((name, own, self.minima(own)))
        self.known = {key: np.unique(np.concatenate([t[1] for t in group])) for key, group in self.classes.items()}

    @staticmethod
    def minima(values: np.ndarray) -> np.ndarray:
        return (values[:, None] * _PERMUTE).min(0)

    def scan(self, text: str | None) -> dict[str, float]:
        """The best containment of each template that the text holds to the threshold."""
        found: dict[str, float] = {}
        ordered: dict[int, np.ndarray] = {}
        for (words, size), group in self.classes.items():
            if words not in ordered:
                ordered[words] = shingles(text, words)
            s = ordered[words]
            if not s.size:
                continue
            known = self.known[words, size]
            hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, s), known.size - 1)] == s)
            if not hits.size:
                continue
            step, span = max(1, size // 2), 2 * size
            starts = {int(b) for h in hits for b in range(max(0, (h - span) // step + 1) * step, h + 1, step)}
            for b in sorted(starts):
                window = np.unique(s[b : b + span])
                low = self.minima(window)
                for name, own, minima in group:
                    if (low == minima).any():
                        share = np.isin(own, window, assume_unique=True).sum() / own.size
                        if share >= self.threshold - 1e-9:
                            found[name] = max(found.get(name, 0.0), float(share))
        return found


def scan(docs: DataFrame, templates: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, license, containment for every document that holds a license notice."""
    index = Index(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, name, share) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for name, share in sorted(index.scan(text.as_py()).items())]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["doc_id", "license", "containment"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, license string, containment double")
