"""Real headers, notices and tags with the licenses they name, written by hand from the texts, not from the scan's tables."""

import duckdb
import pytest

from rankweave.llm import licenses

G = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
S1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
S2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."


def names(x):
    return f"3. Neither the name of {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


AD = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University of California, Berkeley and its contributors."
TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'


def gnu(t, v, later=True):
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {t} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version." if later else f"This program is free software; you can redistribute it and/or modify it under the terms of the {t} version {v} as published by the Free Software Foundation."


ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ASF = 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n   http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
CASES = [
    ("BSD-2-Clause", f"Copyright (c) 2020, Someone\nAll rights reserved.\n\n{G}\n\n{S1}\n{S2}\n\n{TAIL}"),
    ("BSD-3-Clause", f"Copyright 2008 Google Inc.  All rights reserved.\n\n{G}\n\n{S1}\n{S2}\n{names('Google Inc.')}\n\n{TAIL}"),
    ("BSD-3-Clause", f"{G}\n{S1}\n{S2}\n{names('the copyright holder')}"),
    ("BSD-3-Clause", f"{G}\n{S1}\n{S2}\n{names('the University of California, Berkeley')}"),
    ("BSD-3-Clause", f"{G}\n{S1}\n{S2}\n{names('Foo & Bar GmbH (Berlin)')}"),
    ("BSD-3-Clause", f"{G}\n{S1}\n{S2}\n3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", f"{G}\n{S1}\n{S2}\n3. The names of Jane Q. Roe and others may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", f"{G}\n{S1}\n{S2}\n{AD}\n4. {names('the University')[3:]}\n{TAIL}"),
    ("BSD-4-Clause", f"{G}\n{S1}\n{S2}\n{AD}\n4. Nobody may use the name for anything at all."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MIT", "## License\n\nDistributed under the MIT license"),
    ("MIT", "Licensed under the MIT License (the same as others)."),
    ("MIT", "// Licensed under the MIT license. See LICENSE file in the project root."),
    ("MIT", "This software and its documentation are released under the terms of the MIT licence."),
    ("MIT", "It is available under the Expat license."),
    ("MIT", "Released under MIT."),
    ("", "We know that it was released under the MIT License yesterday."),
    ("", "This project is not licensed under the MIT License."),
    ("", "The band released under the MIT dome a license to sing."),
    ("", "No longer licensed under the MIT License."),
    ("", "MIT-style licenses are short."),
    ("Apache-2.0", ASF),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."),
    ("Apache-2.0", "This library is licensed under the Apache 2.0 license."),
    ("Apache-2.0", "Licensed under Apache-2.0"),
    ("Apache-2.0", "The code in this repository is distributed under the Apache License v2.0."),
    ("GPL-2.0-only", gnu("GNU General Public License", "2", False)),
    ("GPL-3.0-or-later", gnu("GNU General Public License", "3")),
    ("GPL-2.0-or-later", gnu("GNU General Public License", "2")),
    ("LGPL-2.1-or-later", gnu("GNU Lesser General Public License", "2.1")),
    ("AGPL-3.0-or-later", gnu("GNU Affero General Public License", "3")),
    ("LGPL-3.0-only", gnu("GNU Lesser General Public License", "3", False)),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License version 3."),
    ("GPL-3.0-only", "Licensed under the GNU GPL v3."),
    ("GPL-3.0-or-later", "Released under the GPLv3 or later."),
    ("GPL-2.0-or-later", "This program is distributed under the GNU General Public License, version 2 or (at your option) any later version."),
    ("LGPL-2.1-only", "Licensed under the LGPL 2.1."),
    ("AGPL-3.0-only", "The server is licensed under the GNU Affero General Public License v3.0."),
    ("GPL-2.0-or-later", "Licensed under GPL-2.0+\n"),
    ("GPL-3.0-only", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."),
    ("ISC", f'{ISC}\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT'),
    ("ISC", f'Copyright (c) 2004 Internet Systems Consortium, Inc. ("ISC")\n\n{ISC}\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT'),
    ("ISC", "This package is available under the ISC license."),
    ("CC-BY-4.0", "Attribution 4.0 International\n\n=====\n\nCreative Commons Attribution 4.0 International Public License\n\nBy exercising the Licensed Rights"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License\n\nBy exercising"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "This module is licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Distributed under the 2-clause BSD license."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("Unlicense", "Released under the Unlicense."),
    ("BSL-1.0", "// Distributed under the Boost Software License, Version 1.0.\n"),
    ("GPL-2.0-only", "SPDX: GPL-2.0"),
    ("GPL-2.0-only", "// SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0-or-later", "/* SPDX-License-Identifier: GPL-2.0+ */"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception"),
    ("BSD-3-Clause,MIT", "SPDX-License-Identifier: MIT AND BSD-3-Clause"),
    ("Apache-2.0,ISC,MIT", "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC"),
    ("MIT", "-- SPDX-License-Identifier: MIT."),
    ("GPL-2.0-only,MIT", "SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT"),
    ("MIT", "SPDX-License-Identifier: LicenseRef-Own OR MIT"),
    ("", "SPDX-License-Identifier: NOASSERTION"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, text) for i, (_, text) in enumerate(CASES)]
    return {r.doc_id: (r.licenses, r.rules) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_real_texts(found, i):
    assert found[i][0] == CASES[i][0], CASES[i][1]


def test_sql_reads_them_alike(found):
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", [(i, text) for i, (_, text) in enumerate(CASES)])
    assert {r[0]: (r[1], r[2]) for r in base.execute(licenses.oracle()).fetchall()} == found


def test_the_scan_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Exchange"))
