"""License scan by sentence rules.

Text is cut into sentences, sentences are normalised and mapped to identifiers of known
licence sentences, and the sequence of identifiers is matched against ordered rules:
the first rule that fits at a place names the licence and uses its sentences up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every pattern of SENTENCES needs one of these or a SHORT word. Each lies in one word, so no
#: line break or comment leader divides it, and the written text can be tested.
KEYS = (
    "licen", "copyright", "warrant", "redistribut", "permission", "domain", "reserved", "commons", "gpl", "liab", "endorse",
    "acknowledg",
)
SHORT = re.compile(r"(?<![a-z0-9])(?:mpl|cc0?)(?![a-z0-9])")

VERSION = r"v?\.? ?(\d+(?:\.\d+)*)"
LATER = r"(?: (?:or|and) (?:\(?at your option\)? )?any later(?: version)?| or later)?"

#: Identifier and pattern of the normalised sentence. Groups: version, later.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("SpdxTag", r"spdx-license-identifier (?P<name>[a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*)"),
    ("ApacheGrant", rf"licensed under the apache(?: software)? license(?:,? version)?,? {VERSION}(?: the license)?"),
    ("ApacheComply", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("MitGrant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MitAsIs", r"the software is provided as is, without warranty of any kind, express or implied"),
    ("MitLiability", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability"),
    ("MitRef", r"(?:released|licensed|distributed|available|provided) under (?:the terms of )?(?:the |an )?mit(?:/x11| \(mit\))? license"),
    ("IscGrant", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("IscAsIs", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("IscRef", r"(?:released|licensed|distributed) under (?:the terms of )?the isc license"),
    ("BsdGrant", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"),
    ("BsdAdvert", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("BsdEndorse", r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products"),
    ("BsdAsIs", r"this software is provided by the .{1,80}? as is and any express or implied warranties"),
    ("BsdRef", r"(?:released|licensed|distributed|available) under (?:the terms of )?(?:the |a )?(?:(?P<kind>[234])-clause |new |simplified |modified )?bsd(?: (?P<kind2>[234])-clause)?(?:-style)? license"),
    ("GplGrant", rf"it under the terms of the gnu (?P<which>lesser |library |affero )?general public license as published by the free software foundation,? either version {VERSION} of the license,? or (?:\(at your option\) |at your option )?any later version"),
    ("GplGrantOnly", rf"it under the terms of the gnu (?P<which>lesser |library |affero )?general public license(?: as published by the free software foundation)?,? version {VERSION}"),
    ("GplWarranty", r"this (?:program|library) is distributed in the hope that it will be useful, but without any warranty"),
    ("GplReceive", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with this (?:program|library)"),
    ("GplRef", rf"(?:released|licensed|distributed|available) under (?:the terms of )?(?:the )?(?:gnu )?(?P<which>lesser |library |affero )?(?:general public license|gpl),? ?(?:version )?{VERSION}(?P<later>{LATER})"),
    ("LgplRef", rf"(?:released|licensed|distributed|available) under (?:the terms of )?(?:the )?(?:gnu )?(?P<abbr>lgpl|agpl),? ?(?:version )?{VERSION}(?P<later>{LATER})"),
    ("MplGrant", rf"this source code form is subject to the terms of the mozilla public license,? {VERSION}"),
    ("MplRef", rf"(?:released|licensed|distributed|available) under (?:the terms of )?the mozilla public license,?(?: version)? {VERSION}"),
    ("MplCopy", r"if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("CcRef", r"(?:licensed|released|distributed|available|provided) under (?:the terms of )?(?:an? |the )?(?:creative commons )?cc[ -](?P<cc>by(?:-(?:nc|nd|sa))*) ?(?P<v>\d\.\d)"),
    ("CcLong", r"(?:licensed|released|distributed|available|provided) under (?:the terms of )?(?:an? |the )?creative commons (?P<long>attribution(?:[- ](?:noncommercial|non-commercial|noderivatives|noderivs|sharealike|share alike))*) (?P<v>\d\.\d)"),
    ("Cc0", r"(?:creative commons zero|cc0)(?: (?P<v>1\.0))?(?: universal)?"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("PublicDomain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("ZlibGrant", r"this software is provided as-is, without any express or implied warranty"),
    ("ZlibTerms", r"permission is granted to anyone to use this software for any purpose, including commercial applications"),
    ("Reserved", r"all rights reserved"),
    ("CopyrightLine", r"copyright (?:\(c\) |© )?(?:\d{4}|by )"),
)
UNKNOWN = "Unknown"
#: Written form of the names that a tag may give.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0",
    "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT",
    "MPL-2.0", "Unlicense", "Zlib", "AND", "OR", "WITH",
)
NAMES = {x.lower(): x for x in SPDX}

#: Ordered rules: identifiers (``?`` optional) and the licence; the first that fits wins.
RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("SpdxTag",), "{name}"),
    (("ApacheGrant", "ApacheComply?", "ApacheCopy?", "ApacheAsIs?", "ApacheSee?"), "Apache-{version}"),
    (("MitGrant", "MitNotice?", "MitAsIs", "MitLiability?"), "MIT"),
    (("MitRef",), "MIT"),
    (("IscGrant", "IscAsIs?"), "ISC"),
    (("IscRef",), "ISC"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse?", "BsdAsIs?"), "BSD-4-Clause"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs?"), "BSD-3-Clause"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs?"), "BSD-2-Clause"),
    (("BsdRef",), "{bsd}"),
    (("GplGrant", "GplWarranty?", "GplReceive?"), "{gpl}-{version}-or-later"),
    (("GplGrantOnly", "GplWarranty?", "GplReceive?"), "{gpl}-{version}-only"),
    (("GplRef",), "{gpl}-{version}-{only}"),
    (("LgplRef",), "{abbr}-{version}-{only}"),
    (("MplGrant", "MplCopy?"), "MPL-{version}"),
    (("MplRef",), "MPL-{version}"),
    (("CcRef",), "CC-{cc}-{v}"),
    (("CcLong",), "CC-{cc}-{v}"),
    (("Cc0",), "CC0-1.0"),
    (("Unlicense", "PublicDomain?"), "Unlicense"),
    (("ZlibGrant", "ZlibTerms"), "Zlib"),
    (("PublicDomain",), "LicenseRef-public-domain"),
    (("Reserved",), "LicenseRef-all-rights-reserved"),
)

COMPILED = tuple((name, re.compile(rf"(?<![a-z0-9])(?:{p})(?![a-z0-9])")) for name, p in SENTENCES)
MARK = r"(?://+|#+|\*+|--+|;+|%+|rem\b)?"
#: A full stop ends a sentence before white space, but not in "v. 2", wrapped or not.
SENTENCE = re.compile(
    rf"(?:[^.!?\n]|[.!?](?=[^\s])|(?<![A-Za-z0-9][vV])(?<=[vV])\.(?=[ \t]*(?:\r?\n[ \t]*{MARK}[ \t]*)?\d)|\n(?!\s*\n))+[.!?]*"
)
LEADER = re.compile(rf"\n[ \t]*{MARK}[ \t]*")
DROP = re.compile(r"[\"'`“”‘’*_:()\[\]<>]+(?=\s|$)|(?<!\S)[\"'`“”‘’*_(\[<]+|(?<=\w)[\"'”’)\]]+(?=[,;])")


def normalised(sentence: str) -> str:
    """Lower case, comment leaders, quotes and colons dropped, white space single, one spelling."""
    s = LEADER.sub(" ", "\n" + sentence.lower())
    s = s.replace("licence", "license").replace("(c)", "©")
    s = DROP.sub(" ", s)
    return " ".join(s.split()).rstrip(".!?;, ").replace(" ,", ",")


@lru_cache(maxsize=4096)
def identify(sentence: str) -> tuple[tuple[str, tuple[tuple[str, str], ...]], ...]:
    """Identifiers of a normalised sentence, in order of place, with their parameters."""
    found = []
    for name, pattern in COMPILED:
        for m in pattern.finditer(sentence):
            if any(m.start() < e and s < m.end() for s, e, _, _ in found):
                continue  # an earlier pattern of the list has this place
            groups = {k: v.strip() for k, v in m.groupdict().items() if v}
            plain = [v for i, v in enumerate(m.groups(), 1) if v and i not in m.re.groupindex.values()]
            if plain:
                groups["version"] = plain[0]
            found.append((m.start(), m.end(), name, tuple(sorted(groups.items()))))
    return tuple((n, g) for _, _, n, g in sorted(found))


def parameters(groups: dict[str, str]) -> dict[str, str]:
    """Values for a rule's licence name."""
    out = dict(groups)
    v = groups.get("version", "")
    out["version"] = v if "." in v else f"{v}.0"
    out["gpl"] = {"lesser": "LGPL", "library": "LGPL", "affero": "AGPL"}.get(groups.get("which", ""), "GPL")
    out["abbr"] = groups.get("abbr", "").upper()
    out["only"] = "or-later" if groups.get("later") else "only"
    out["name"] = " ".join(NAMES.get(w, w) for w in groups.get("name", "").split())
    out["bsd"] = f"BSD-{groups.get('kind') or groups.get('kind2') or '3'}-Clause"
    out["cc"] = groups.get("cc", "").upper()
    if "long" in groups:
        words = re.split(r"[- ]", groups["long"].replace("non-commercial", "noncommercial").replace("share alike", "sharealike"))
        short = {"attribution": "BY", "noncommercial": "NC", "noderivatives": "ND", "noderivs": "ND", "sharealike": "SA"}
        out["cc"] = "-".join(short[w] for w in words)
    return out


def fits(rule: tuple[str, ...], ids: list[str], at: int) -> int:
    """How many identifiers from ``at`` the rule uses; 0 if it does not fit. Unknown ones are stepped over."""
    k = at
    for want in rule:
        j = k
        while j < len(ids) and ids[j] in (UNKNOWN, "CopyrightLine") and j > at:
            j += 1
        if j < len(ids) and ids[j] == want.rstrip("?"):
            k = j + 1
        elif not want.endswith("?"):
            return 0
    return k - at


def keyed(low: str) -> bool:
    """Whether lower-case text may hold a sentence of the list."""
    return any(k in low for k in KEYS) or (("mpl" in low or "cc" in low) and SHORT.search(low) is not None)


def scan(text: str | None) -> tuple[list[str], list[str], list[dict]]:
    """Licences in order without repeats, sentence identifiers in order, and places.

    A place has the licence and the code points of its first to last sentence.
    """
    if not text:
        return [], [], []
    if not keyed(text.lower()):
        return [], [], []
    ids: list[str] = []
    groups: list[dict[str, str]] = []
    spans: list[tuple[int, int]] = []
    for m in SENTENCE.finditer(text):
        raw = m.group()
        lowered = raw.lower()
        if not keyed(lowered):
            continue
        got = identify(normalised(raw))
        for name, g in got:
            ids.append(name)
            groups.append(dict(g))
            spans.append(m.span())
        if not got and ("license" in lowered or "licence" in lowered):
            ids.append(UNKNOWN)
            groups.append({})
            spans.append(m.span())
    found: list[dict] = []
    at = 0
    while at < len(ids):
        for rule, name in RULES:
            n = fits(rule, ids, at)
            if n:
                found.append({"license": name.format(**parameters(groups[at])), "start": spans[at][0], "end": spans[at + n - 1][1]})
                at += n
                break
        else:
            at += 1
    return list(dict.fromkeys(x["license"] for x in found)), ids, found


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``licenses``, ``sentence_ids`` and ``found`` (licence, start, end).

    ``Unknown`` marks a sentence that speaks of a licence but is in no list. Null and empty
    texts have none; long texts are read whole; repeated rows have equal results; a null id
    passes through; an empty table gives an empty result. Other columns are ignored.
    """
    place = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.list_(pa.string())
        for b in batches:
            rows = [scan(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((names, names, place))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "licenses", "sentence_ids", "found"])

    schema = "doc_id long, licenses array<string>, sentence_ids array<string>, found array<struct<license:string,start:long,end:long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
