"""Licence files that hold a full text, and what reserved rights count for."""

from provenir.llm import licenses

FULL = dict(licenses.TEXTS)


def held(name, holder="2019 Ada and the others"):
    return FULL[name].replace("<year>", holder).replace("<copyright holders>", "").replace("<copyright holder>", "")


def untitled(text):
    return text[text.index("Copyright") :]


def test_full_texts_are_licence_files(spark):
    files = [
        (1, "mit/terms", held("MIT")),
        (2, "mit/src/code", "no notice here"),
        (3, "bsd3/terms", untitled(held("BSD-3-Clause"))),
        (4, "bsd3/code", "nor here"),
        (5, "bsd2/terms", untitled(held("BSD-2-Clause", "1999 Bob"))),
        (6, "gpl/terms", held("GPL-3.0")),
        (7, "apache/terms", held("Apache-2.0").upper()),
        (8, "long/code", held("MIT") + "and other words of a program " * 400),
        (9, "named/LICENSE.txt", "MIT License\n" + "some words of ours " * 30),
        (10, "named/code", "none"),
        (11, "both/code", "All rights reserved.\nLicensed under the BSD 3-Clause License.\n" + "word " * 60),
        (12, "own/code", "All rights reserved.\n" + "word " * 60),
    ]
    rows = licenses.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in rows}
    assert len(rows) == len(files)
    assert got[1] == ("MIT", "file") and got[2] == ("MIT", "inherited")
    assert got[3] == ("BSD-3-Clause", "file") and got[4] == ("BSD-3-Clause", "inherited") and got[5] == ("BSD-2-Clause", "file")
    assert got[6] == ("GPL-3.0", "file") and got[7] == ("Apache-2.0", "file")
    assert got[8][1] != "file"
    assert got[9] == ("MIT", "file") and got[10] == ("MIT", "inherited")
    assert got[11] == ("BSD-3-Clause", "header") and got[12] == ("Proprietary", "header")


def commented(text, mark="// "):
    return "\n".join(mark + x for x in text.split("\n")) + "\n\nint main() { return 0; }\n" + "call(this, that);\n" * 200


MIT_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
GPL_HEADER = """gadget - does things
Copyright (C) 2021 Somebody

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
ISC_TEXT = """Copyright 2017 Someone

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_STYLE = "Copyright (c) 2020, A. All rights reserved. Use of this source code is governed by a BSD-style license"


def test_blocks_and_texts_as_others_write_them(spark):
    files = [
        (1, "gpl/main.c", commented(GPL_HEADER)),
        (2, "gpl2/main.c", "/* " + GPL_HEADER + " */\ncode" + " word" * 300),
        (3, "mit/main.py", "#!/usr/bin/env python\n" + commented(MIT_PERMISSION, "# ")),
        (4, "mitfile/LICENSE", MIT_PERMISSION),
        (5, "mitfile/src/a.c", "no notice"),
        (6, "isc/LICENSE", ISC_TEXT),
        (7, "isc/a.c", "nothing"),
        (8, "bsd/a.go", "// " + BSD_STYLE + "\ncode" + " word" * 100),
        (9, "apache/a.java", "/*\n * Licensed under the Apache License, Version 2.0;\n * you may not use this file except in compliance with the License.\n */\n" + "code " * 100),
        (10, "cc/a.md", "Creative Commons Attribution-NonCommercial 4.0 International License\n" + "word " * 100),
        (11, "mitline/a.c", "MIT licensed.\n" + "word " * 100),
        (12, "plain/a.sql", "-- a comment about the warranty of nothing\n" * 9 + "select 1"),
        (13, "plain/b.c", "// a driver for the public domain of this computer\n" + "// " + "some words that tell what it does and why it was made so " * 5 + "\ncode"),
        (14, "free/UNLICENSE", "This is free and unencumbered software released into the public domain.\n" + FULL["Unlicense"].split("\n", 2)[2]),
        (15, "long/a.c", "// " + "x " * 400_000 + "\n// warranty\n" * 3000),
        (16, None, None),
    ]
    rows = licenses.license_scan(spark.createDataFrame([(*f, 1, "x") for f in files], "doc_id long, path string, text string, n long, licence string")).collect()
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in rows}
    assert len(rows) == len(files)
    assert got[1] == got[2] == ("GPL-3.0", "header") and got[3] == ("MIT", "header")
    assert got[4] == ("MIT", "file") and got[5] == ("MIT", "inherited") and got[6] == ("ISC", "file") and got[7] == ("ISC", "inherited")
    assert got[8] == ("BSD-3-Clause", "header") and got[9] == ("Apache-2.0", "header") and got[10][0] == "CC-BY-NC-4.0" and got[11] == ("MIT", "header")
    assert got[12][1] == got[13][1] == got[15][1] == got[16][1] == "none" and got[14][0] == "Unlicense"


def test_every_template_has_a_term_that_marks_texts():
    import re

    for _, text in [*licenses.TEXTS, *licenses.HEADERS, *licenses.TEMPLATES]:
        assert re.search(licenses.MARKED, text.lower()) or text.startswith("Licensed under")
