import textwrap
from pathlib import Path

from prismatica.llm import license_scan
from prismatica.llm.license_texts import FULL, HEADERS

HEADER = HEADERS["GPL-3.0"][0]
APACHE = HEADERS["Apache-2.0"][0]
PROSE = "\n".join(f"the license of line {i} is a matter of course and of the people who read version {i} of the work" for i in range(60))


def wrapped(text, mark="# ", width=70):
    return "\n".join(mark + line for line in textwrap.wrap(" ".join(text.split()), width))


def scanned(spark, files, **options):
    df = spark.createDataFrame(files, "path string, text string")
    return {r.path: (r.license, r.how) for r in license_scan.scan(df, **options).collect()}


def test_whole_texts(spark):
    files = [(f"{name}/any.txt", "Copyright (c) 2020 Jane Doe\n\n" + text) for name, text in FULL.items()]
    files += [(f"{name}/one-line", " ".join(text.split())) for name, text in FULL.items()]
    got = scanned(spark, files + [(f"{name}/x.py", "code") for name in FULL] + [("p/q", PROSE)], texts_are_files=True)
    for name in FULL:
        assert got[f"{name}/any.txt"] == got[f"{name}/one-line"] == (name, "own") and got[f"{name}/x.py"] == (name, "inherited"), name
    assert got["p/q"] == (None, "none")


def test_headers_and_joined_lines(spark):
    code = "\n\nimport os\n\n" + "\n".join(f"def f{i}(x):\n    return x + {i}" for i in range(80))
    files = {
        "gpl.py": ("GPL-3.0", "#!/usr/bin/env python\n# Copyright (C) 2019 Some One <a@b.org>\n#\n" + wrapped(HEADER) + code),
        "gpl.c": ("GPL-3.0", "/* foo.c\n" + wrapped(HEADER, " * ") + "\n */" + code),
        "gpl2.c": ("GPL-2.0", "/*\n" + wrapped(HEADERS["GPL-2.0"][0], " * ") + "\n */" + code),
        "agpl.c": ("AGPL-3.0", "/*\n" + wrapped(HEADERS["AGPL-3.0"][0], " * ") + "\n */" + code),
        "apache.js": ("Apache-2.0", "// Copyright 2020 The Authors. All rights reserved.\n//\n" + wrapped(APACHE, "// ", 60) + code),
        "middle.txt": ("Apache-2.0", code + "\n" + wrapped(APACHE, "    ", 100) + code),
        "mpl.rs": ("MPL-2.0", wrapped(HEADERS["MPL-2.0"][1], "// ") + code),
        "split.txt": ("MPL-2.0", code + "\nThis Source Code Form is subject to the terms\nof the Mozilla Public License, v. 2.0.\n" + code),
        "bsd.h": ("BSD-3-Clause", "/*\n" + FULL["BSD-3-Clause"] + "*/" + code),
        "mit.h": ("MIT", "/*\n" + FULL["MIT"] + "*/" + code),
        "short.py": ("MIT", "# Copyright 2020 Jane Doe. Licensed under the MIT License." + code),
        "spdx.py": ("MIT", "# SPDX-License-Identifier: MIT" + code),
        "spdx.c": ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */" + code),
        "none.py": (None, "# SPDX-License-Identifier: Other-1.0" + code),
        "prose": (None, PROSE),
        "empty": (None, ""),
    }
    got = scanned(spark, [(f"{i}/{path}", text) for i, (path, (_, text)) in enumerate(files.items())])
    assert {p.split("/")[1]: name for p, (name, _) in got.items()} == {p: name for p, (name, _) in files.items()}


def test_registered_query_takes_whole_texts_as_files(spark):
    text = FULL["GPL-3.0"]
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, "code", "en", "s"), (3, PROSE, "en", "t")], "doc_id long, text string, lang string, source string")
    files = license_scan.documents_as_files(docs)
    rows = license_scan.scan(files, license_file_column="is_license_file", keep_text=False, texts_are_files=True).collect()
    assert {r.doc_id: (r.license, r.how, r.from_dir) for r in rows} == {1: ("GPL-3.0", "own", None), 2: ("GPL-3.0", "inherited", "s/en/g0"), 3: (None, "none", None)}


def test_texts_of_this_machine(spark):
    files = [(str(p), p.read_text("utf-8")) for p in [Path("/usr/share/common-licenses") / n for n in ("GPL-3", "Apache-2.0", "BSD", "Artistic", "CC0-1.0", "GFDL-1.3")] if p.exists()]
    got = scanned(spark, [(f"{i}/x", t) for i, (_, t) in enumerate(files)] + [("z/z", "y")])
    named = {p.rsplit("/", 1)[1]: got[f"{i}/x"][0] for i, (p, _) in enumerate(files)}
    assert named == {k: v for k, v in {"GPL-3": "GPL-3.0", "Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "Artistic": None, "CC0-1.0": None, "GFDL-1.3": None}.items() if k in named}
