"""Licence scans on hand-written texts."""

from clausegrid.llm import licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software.
The above copyright notice and this permission notice shall be included in all copies.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD3 = """Redistribution and use in source and binary forms are permitted; Redistributions of source code must retain the above copyright notice.
Redistributions in binary form must reproduce the above copyright notice.
Neither the name of X nor Y may be used to endorse or promote products. This software is provided by X "as is"."""


def test_rules(spark):
    texts = {
        1: MIT, 2: BSD3, 3: BSD3.split("Neither")[0], 4: "x.\nReleased under the MIT License.\ny", 5: "Licensed under CC BY-NC 4.0.",
        6: "This work is licensed under the GNU General Public License, version 3.", 7: "Licensed under the Apache License, Version 2.0.",
        8: None, 9: "", 10: "We talk about licence plates. Nothing is copyrighted here", 11: "licensed under the Foo.", 12: MIT + "\n" + MIT,
        13: "version 2 of the License, or (at your option) any later version.", 14: "x" * 200_000 + ". Public domain.", 15: "RELEASED UNDER THE MIT LICENSE!!",
    }
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()] + [(4, texts[4], "x", 1), (None, "cc0", "x", 1)], "doc_id long, text string, licence string, n_0 int")
    got = {}
    for r in licences.recognise(docs).collect():
        got.setdefault(r.doc_id, []).append((r.licence, r.matches))
    assert got == {
        1: [("MIT", 1)], 2: [("BSD-3-Clause", 1)], 3: [("BSD-2-Clause", 1)], 4: [("MIT", 1), ("MIT", 1)], 5: [("CC-BY-NC-4.0", 1)], 6: [("GPL-3.0", 1)],
        7: [("Apache-2.0", 1)], 11: [("Unknown", 1)], 12: [("MIT", 2)], 14: [("Public-Domain", 1)], 15: [("MIT", 1)], None: [("CC0-1.0", 1)],
    }
    assert licences.recognise(docs.limit(0)).count() == 0
    places = [(r.sentence, r.identifier) for r in licences.licence_sentences(docs.where("doc_id = 1")).collect()]
    assert places == [(0, "MIT_GRANT"), (1, "MIT_NOTICE"), (2, "MIT_AS_IS")]


GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
BSD3_WRAPPED = """Copyright (c) 2020, X
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
    * Redistributions of source code must retain the above copyright
      notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright
      notice, this list of conditions and the following disclaimer in the
      documentation and/or other materials provided with the distribution.
    * Neither the name of the <organization> nor the
      names of its contributors may be used to endorse or promote products
      derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
MIT_WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining a
copy of this software, to deal in the Software without restriction.

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED.
"""


def test_wrapped_texts(spark):
    agpl = GPL3.replace("GNU General Public License as published by", "GNU Affero General Public License as published by")
    gpl2 = GPL3.replace("Foundation, either version 3", "Foundation; either version 2")
    lgpl3 = GPL3.replace("GNU General Public License as published by\n    the", "GNU Lesser\n    General Public License as published by the")
    gplx = GPL3.replace("GNU General Public License as published by\n    the", "GNU General Public\n    License as published by the")
    c = "/*\n" + "".join(f" * {x.strip()}\n" for x in GPL3.splitlines()) + " */\n"
    texts = {
        1: GPL3, 2: gpl2, 3: agpl, 4: lgpl3, 5: LGPL21, 6: BSD3_WRAPPED, 7: APACHE, 8: MIT_WRAPPED, 9: gplx, 10: c,
        11: "\n".join(f"# {x.strip()}" for x in gpl2.splitlines()), 12: GPL3.replace("\n", "\r\n"),
        13: "Released under the MIT License\nApache License 2.0\ncc0\npublic domain",
        14: "Redistribution and use in source and binary forms, with or without\nmodification, are permitted:\n1. Redistributions in binary form must reproduce the above copyright\nnotice.",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in licences.recognise(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.licence, r.matches))
    want = {
        1: "GPL-3.0-or-later", 2: "GPL-2.0-or-later", 3: "AGPL-3.0", 4: "LGPL-3.0", 5: "LGPL-2.1", 6: "BSD-3-Clause", 7: "Apache-2.0", 8: "MIT",
        9: "GPL-3.0-or-later", 10: "GPL-3.0-or-later", 11: "GPL-2.0-or-later", 12: "GPL-3.0-or-later", 14: "BSD-2-Clause",
    }
    assert {k: got[k] for k in want} == {k: {(v, 1)} for k, v in want.items()}
    assert got[13] == {("MIT", 1), ("Apache-2.0", 1), ("CC0-1.0", 1), ("Public-Domain", 1)}
