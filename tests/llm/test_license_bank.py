"""Licenses of like wording are told apart."""

import duckdb
import pytest

from plenumlens.llm import licenses
from plenumlens.llm.oracles import ORACLES

NOTICE = ("This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as "
          "published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")


TEXTS = [
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("This work is licensed under the GNU General Public License, version 1.", ""),
    (NOTICE.format("program", "", "2"), "gpl-2.0"),
    (NOTICE.format("program", "", "3"), "gpl-3.0"),
    (NOTICE.format("program", "Affero ", "3"), "agpl-3.0"),
    (NOTICE.format("library", "Lesser ", "2.1"), "lgpl-2.1"),
    (NOTICE.format("library", "Lesser ", "3"), "lgpl-3.0"),
    ("Licensed under the Apache License, Version 1.1.", ""),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.", ""),
    ("a GNU Affero license in version 3 of the library", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("around", ["", "lorem ipsum " * 23])
def test_texts(spark, around):
    rows = [(i, None if t is None else f"{around}{t} {around}", want) for i, (t, want) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert got == {i: want for i, _, want in rows}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    found = con.sql(ORACLES["op5_licenses"])
    assert {r[found.columns.index("doc_id")]: r[found.columns.index("licenses")] for r in found.fetchall()} == got


def test_without_telling_words_versions_are_confused(spark):
    df = spark.createDataFrame([(1, TEXTS[0][0])], "doc_id long, text string")
    assert licenses.scan(df, telling={}).first().licenses == "gpl-2.0,gpl-3.0"
