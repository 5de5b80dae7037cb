"""Licence notices as real files have them: expressions, wrapped texts, long lines, several families, and wordings of no template."""

import re

import numpy as np
import pytest

from cadenza.llm import licenses
from cadenza.session import table

REAL = {
    "MIT OR Apache-2.0": "apache,mit", "Apache-2.0": "apache", "GPLv3": "gpl", "licensed under GPL-2.0-only": "gpl", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause": "apache,bsd,mit",
    "Copyright (c) 2019 Jane Doe. All rights reserved.": "proprietary", "word " * 60 + "so. Released under the MIT License. " + "more text " * 60: "mit",
    "This manual is available under the terms of the GNU Free Documentation License": None, "either of Apache License, Version 2.0 or MIT license": "apache,mit",
    "MIT": None, "The MIT professor reads with an apache in the public library.": None, "rights reserved": None, "She had the permission of the public to copy this.": None,
    "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files, to deal in the Software\n# without restriction, including without limitation the rights to use, copy,\n# modify, merge, publish, distribute, sublicense, and/or sell copies.": "mit",
    "This program is licensed under the GNU\n General Public License, version 3.": "gpl", "This program is licensed under the GNU\n\n General store, version 3.": None,
}
PARAPHRASES = [
    ("mit", "The code is released under the MIT license, see the file."), ("mit", "Distributed under the MIT License; read it first"), ("mit", "It is licensed under the terms of the MIT License"),
    ("apache", "This library is licensed under the Apache License, Version 2.0 as well."), ("apache", "We are Licensed under the Apache License 2.0"), ("apache", "Released under the Apache License, version 2.0"),
    ("gpl", "You may use it under the terms of the GNU General Public License version 2"), ("gpl", "It is licensed under the GNU General Public License, version 2 or later"), ("gpl", "Released under GPL-3.0-only, as before"),
    ("agpl", "The server is licensed under the GNU Affero General Public License version 3"), ("lgpl", "The library is licensed under the GNU Lesser General Public License, version 3"),
    ("bsd", "Our tools are released under the BSD 3-Clause License"), ("bsd", "Code licensed under the BSD 2-clause license today"), ("isc", "Files are licensed under the ISC License"),
    ("boost", "Parts are distributed under the Boost Software License, Version 1.0"), ("epl", "It is made available under the terms of the Eclipse Public License 2.0"),
    ("mpl", "The source is subject to the terms of the Mozilla Public License, v. 2.0"), ("cc-by", "The text is licensed under CC BY 4.0 by its authors"), ("cc-by-sa", "Pictures are licensed under CC BY-SA 4.0 here"),
    ("cc-by-nc", "The book is licensed under CC BY-NC 4.0 only"), ("cc0", "The data are dedicated to the public domain under the Creative Commons Zero license"), ("proprietary", "Copyright 2021 by the Smith Company Ltd, London. All rights reserved."),
]


@pytest.fixture(scope="module")
def found(spark):
    """A scan with a model whose unknown class is the corpus's."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    model, known = licenses.train(licenses.sample(docs.withColumnRenamed("text", "__text"))), licenses.Notices()

    def names(text):
        low = licenses._plain(np.frombuffer(text.encode(), np.uint8)).tobytes()
        hits = licenses.notices(low, model, known) if licenses._HINT.search(low) else []
        return ",".join(sorted({licenses.FAMILIES[f] for f, _, _ in hits})) or None

    return names


def test_real_notices(found):
    assert {x: found(x) for x in REAL} == REAL
    assert {x: found(f"Some words here\n\n{x}\n\nand more of them") for x in REAL} == REAL


def test_paraphrases(found):
    right = [found(text) == family for family, text in PARAPHRASES]
    assert sum(right) >= 0.9 * len(right), [p for p, ok in zip(PARAPHRASES, right, strict=True) if not ok]


def test_ordinary_texts_have_no_family(spark, found):
    texts = [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    plain = [t for t in texts if not re.search("licen[sc]|rights reserved|copyright|MIT|GNU|CC BY", t, re.I)]
    assert len(plain) > 300 and not [t[:80] for t in plain if found(t)]
