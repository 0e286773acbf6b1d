from __future__ import annotations

import pytest

from tickloom.llm import licenserules

APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.
"""
CASES = [
    (APACHE, ["Apache-2.0"]), (MIT, ["MIT"]), (BSD, ["BSD-2-Clause"]),
    (BSD + "3. Neither the name of the Foo Group nor the names of its contributors may be used to endorse or promote products.", ["BSD-3-Clause"]),
    ("Released under the MIT License.", ["MIT"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("It is distributed under the GNU Lesser General Public Licence version 2.1 or later.", ["LGPL-2.1-or-later"]),
    ("some prose\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.\nmore", ["MIT", "Apache-2.0"]),
    ("# SPDX-License-Identifier: GPL-2.0-or-later OR MIT\n", ["GPL-2.0-or-later OR MIT"]), ("All rights reserved.", ["LicenseRef-all-rights-reserved"]),
    ("We issue a licence to fish here.", []), ("", []), (None, []), ("no such words", []), ("the MIT campus and the Apache people", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_known_texts(text, want):
    names, ids, found = licenserules.scan(text)
    assert names == want
    assert all(0 <= x["start"] < x["end"] <= len(text) for x in found)
    if text and "fish" in text:
        assert ids == ["Unknown"]


#: One example of each known sentence, in the list's order.
EXAMPLES = {
    "SpdxTag": "SPDX-License-Identifier: MIT", "ApacheGrant": "Licensed under the Apache License, v. 2.0",
    "ApacheComply": "you may not use this file except in compliance with the License", "ApacheCopy": "You may obtain a copy of the License at",
    "ApacheAsIs": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS',
    "ApacheSee": "See the License for the specific language governing permissions and limitations under the License",
    "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "MitAsIs": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "MitLiability": "in no event shall the authors or copyright holders be liable for any claim, damages or other liability",
    "MitRef": "available under the MIT license", "IscRef": "Released under the ISC licence",
    "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "IscAsIs": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE',
    "BsdGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer",
    "BsdAdvert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "BsdEndorse": "Neither the name of Foo nor the names of its contributors may be used to endorse or promote products",
    "BsdAsIs": "THIS SOFTWARE IS PROVIDED BY THE AUTHORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES", "BsdRef": "under a licence: available under the BSD license",
    "GplGrant": "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GplGrantOnly": "it under the terms of the GNU Affero General Public License, version 3", "GplRef": "Distributed under the GNU GPL 3.0 or later",
    "GplWarranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "GplReceive": "You should have received a copy of the GNU General Public License along with this program", "LgplRef": "available under the LGPL 2.1",
    "MplGrant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "MplRef": "released under the Mozilla Public License, v. 2.0",
    "MplCopy": "If a copy of the MPL was not distributed with this file, You can obtain one at", "CcRef": "Provided under CC BY-SA 4.0",
    "CcLong": "Available under Creative Commons Attribution-ShareAlike 4.0", "Cc0": "dedicated by CC0 1.0",
    "Unlicense": "This is free and unencumbered software released into the public domain", "PublicDomain": "it is placed in the public domain",
    "ZlibGrant": "This software is provided as-is, without any express or implied warranty",
    "ZlibTerms": "Permission is granted to anyone to use this software for any purpose, including commercial applications",
    "Reserved": "All rights reserved", "CopyrightLine": "Copyright (c) 2020 Foo",
}


@pytest.mark.parametrize("name", [n for n, _ in licenserules.SENTENCES])
def test_wrapped_sentences_pass_the_filter(name):
    """Each known sentence, broken at any one space over two comment lines."""
    words = EXAMPLES[name].split(" ")
    for k in range(1, len(words)):
        for mark in ("", "# ", " * ", "// "):
            text = f"{mark}{' '.join(words[:k])}\n{mark}{' '.join(words[k:])}.\n"
            assert licenserules.scan(text)[1] == [name], text


@pytest.mark.parametrize(("text", "want"), [
    ("Released under the GPL v3.", ["GPL-3.0-only"]), ("Distributed under the GNU GPL 3.0 or later.", ["GPL-3.0-or-later"]),
    ("It is available under the LGPL 2.1.", ["LGPL-2.1-only"]), ("All rights\nreserved.", ["LicenseRef-all-rights-reserved"]),
    ("# software released into the public\n# domain.", ["LicenseRef-public-domain"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
])
def test_sentences_without_common_words(text, want):
    assert licenserules.scan(text)[0] == want


def test_order_of_rules():
    """The BSD rules differ in one sentence each; the fuller rule wins, wherever it lies."""
    for pad in ("", "Foo bar baz. ", "This licence has its own text.\n\n"):
        assert licenserules.scan(pad + CASES[3][0])[0] == ["BSD-3-Clause"]


def test_table(spark):
    """The planted lines, found by plain search over the whole texts."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"MIT": "Released under the MIT License", "Apache-2.0": "Licensed under the Apache License, Version 2.0", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0"}
    lines |= {"GPL-3.0-only": "licensed under the GNU General Public License, version 3", "LicenseRef-all-rights-reserved": "All rights reserved"}
    got = {r.doc_id: set(r.licenses) for r in licenserules.licences(docs).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        assert got[r.doc_id] == {k for k, v in lines.items() if re.search(re.escape(v), r.text, re.I)}


def test_odd_rows(odd, none, odd_rows):
    out = licenserules.licences(odd).collect()
    assert len(out) == len(odd_rows) and all(r.licenses == [] for r in out)
    assert licenserules.licences(none).count() == 0
