"""Notices as projects write them, not made from the scan's tables."""

import pytest

from skein.llm import license_scan

BSD = """Copyright 2014 {owner}. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
THIRD = """   * Neither the name of {owner} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
GNU = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful."
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
CASES = [
    (BSD.format(owner="Google Inc", third=THIRD.format(owner="Google Inc.")), {"BSD-3-Clause"}),
    (BSD.format(owner="The Regents", third="3. " + THIRD.format(owner="the University").strip()), {"BSD-3-Clause"}),
    (BSD.format(owner="Ann", third="   * The name of the author may not be used to endorse or promote products\nderived from this software without specific prior written permission."), {"BSD-3-Clause"}),
    (BSD.format(owner="Somebody", third=""), {"BSD-2-Clause"}),
    (MIT, {"MIT"}), (GNU, {"GPL-3.0-or-later"}),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0", {"MIT", "Apache-2.0"}),
    ("/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause) AND Zlib */", {"GPL-2.0-only", "BSD-3-Clause", "Zlib"}),
    ("// SPDX-License-Identifier: GPL-2.0+", {"GPL-2.0-or-later"}), ("// SPDX-License-Identifier: GPL-2.0-or-later", {"GPL-2.0-or-later"}), ("// SPDX-License-Identifier: GPL-2.0", {"GPL-2.0"}),
    ("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", {"GPL-2.0-only"}), ("SPDX-License-Identifier: LGPL-2.1-or-later OR MIT", {"LGPL-2.1-or-later", "MIT"}),
    ("This crate is dual licensed under the MIT License and the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}),
    ("Available under either the MIT license or Apache License 2.0, at your option.", {"MIT", "Apache-2.0"}),
    ("This file is not under the MIT License.", set()), ("It was never released under the Apache License 2.0 but under the ISC License.", {"ISC"}),
    ("No longer licensed under the MIT license; now licensed under the Mozilla Public License 2.0", {"MPL-2.0"}), ("Not only under the MIT License, also under the GPLv3.", {"MIT", "GPL-3.0"}),
    ("Licensed under MIT", {"MIT"}), ("License: MIT", {"MIT"}), ("Licence : Apache License, Version 2.0", {"Apache-2.0"}), ("License: MIT or Apache-2.0", {"MIT", "Apache-2.0"}), ("license: none of your business, MIT people", set()),
    ("Distributed under the terms of the GNU General Public License v2 or later.", {"GPL-2.0-or-later"}), ("Distributed under the terms of the GNU GPL v2 only.", {"GPL-2.0-only"}),
    ("Released under the GNU Lesser General Public License version 2.1 or (at your option) any later version", {"LGPL-2.1-or-later"}),
    ("Under the MIT License, which is compatible with the Apache License 2.0.", {"MIT"}), ("We studied under Mit Licensey at the academy.", set()), ("License", set()), ("MIT", set()), ("mit or isc", set()),
    ("Das Programm steht ueber uns, under the sun, sous licence MIT.", set()), ("Überall. Licensed under MIT. Voilà", {"MIT"}), ("words and words. " * 40_000 + "Licensed under MIT. " + "more words " * 40_000, {"MIT"}),
]


def test_notices_as_written(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    found = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) - {"LicenseRef-reserved"} for r in license_scan.scan(frame).collect()}
    for i, (text, want) in enumerate(CASES):
        assert found[i] == want, text[:300]


def test_notices_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(CASES)])
    names = ["doc_id", "n_sentences", "sentences", "rules", "licenses"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({license_scan.oracle()})").fetchall())
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    assert sorted(tuple(r[n] for n in names) for r in license_scan.scan(frame).collect()) == want


@pytest.mark.parametrize("name", list(license_scan.NAMES))
def test_every_licence_is_told_from_its_expression_and_name(spark, name):
    texts = [f"SPDX-License-Identifier: {name}", f"Provided under {name}.", f"License: {name}", f"x\n SPDX-License-Identifier:{name}\ny"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("cast(1 as long) as doc_id", "text")
    assert {r["licenses"] for r in license_scan.scan(frame).collect()} == {name}
