"""Published forms of the known licences."""

import os

import pytest

from tidemark.llm import licenses

LONG = "/usr/share/common-licenses"


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r.license_id, r.notice_ids) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_published_forms(spark):
    mit, bsd, isc = (licenses.TEXTS[i] for i in ("MIT", "BSD-3-Clause", "ISC"))
    wrapped = mit.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS")
    bullets = bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    texts = [f"MIT License\n\nCopyright (c) 2020 A\n\n{mit}", f"The MIT License (MIT)\n\nCopyright A and others\n\n{wrapped}", f"BSD 3-Clause License\n\nCopyright (c) 2020, A\nAll rights reserved.\n\n{bullets}", f"ISC License\n\n{isc}", f"Copyright B\n\n{bsd}", licenses.UNLICENSE, "x\nThis file is licensed under the MIT License.\n", f"MIT License\n\n{mit}\nand more"]
    assert found(spark, texts) == [("MIT", None), ("MIT", None), ("BSD-3-Clause", None), ("ISC", None), ("BSD-3-Clause", None), ("Unlicense", None), (None, "MIT"), (None, None)]


@pytest.mark.skipif(not os.path.isdir(LONG), reason="no long licence texts here")
def test_long_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    assert [i for i, _ in found(spark, [open(f"{LONG}/{n}").read() for n in names])] == list(names.values())


def test_texts_as_a_table(spark, monkeypatch):
    """Whole licences planted with changed case, holder, punctuation and spelling; of equal texts the first id; with and without a broadcast."""
    text = "Copyright (c) 1999 B\n\nYou may use the colour tables, whilst this licence is kept, at https://example.org/x.\nNo warranty: none." + " More terms follow here." * 500
    changed = "COPYRIGHT 2024 Someone Else Ltd.\n" + text.split("\n", 2)[2].upper().replace("COLOUR", "color").replace(",", " --").replace("LICENCE", "License").replace("HTTPS", "http")
    table = spark.createDataFrame([("B-1", text), ("A-1", text), ("C-1", "Another text."), ("D-1", None)], "license_id string, text string")
    docs = spark.createDataFrame([(1, changed, "x"), (2, changed + " or not", "x"), (3, "Another\ttext", "x")], "doc_id long, text string, digest string")
    for small in (100, 0):
        monkeypatch.setattr(licenses, "SMALL", small)
        assert {r.doc_id: r.license_id for r in licenses.scan(docs, texts=table).collect()} == {1: "A-1", 2: None, 3: "C-1"}
