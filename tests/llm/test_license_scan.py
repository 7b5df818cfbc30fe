import pathlib
import re

import pytest

from tallyforge.llm import license_scan as L
from tallyforge.llm.license_texts import NOTICES, TEXTS

from ._oracle import oracle, rows

DATA = "/root/testdata/sf0.001"


def slow(text):
    """The canonical form in Python."""
    t = text.lower()
    for pattern in (L.TITLE, L.COPYRIGHT, L.RIGHTS, L.ITEM):
        t = re.sub(pattern, " ", t)
    for a, b in L.SAME:
        t = t.replace(a, b)
    return " ".join(re.findall(r"[^\W_]+", t))


def test_whole_table_against_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = L.scan(docs)
    assert rows(got) == oracle(L.SQL, documents=docs)
    assert any(r.n_notice_lines for r in got.collect())


def test_variants_and_edges(spark):
    mit = TEXTS[0][1]
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", mit).replace("copies of the Software", "copies of the Software")
    texts = [
        "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + wrapped,
        mit.upper().replace('"', "“"),
        mit.replace("sublicense", "sub-license").replace("MERCHANTABILITY", "merchantibility"),
        mit + " And one more word.",
        "Some text.\nReleased under the MIT Licence.\n  * Licensed under CC BY-NC 4.0 *",
        None,
        "",
        "licen",
    ]
    data = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    data += [data[4], (4, "other", "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, license string")
    got = L.scan(df)
    assert rows(got) == oracle(L.SQL, documents=df)
    by = sorted(((r.doc_id, r.license, r.notices, r.n_notice_lines) for r in got.collect()), key=str)
    for k in (None, 1, 2):
        assert (k, "MIT", "", 0) in by
    assert (3, None, "", 0) in by and by.count((4, None, "CC-BY-NC-4.0,MIT", 2)) == 2 and (4, None, "", 0) in by
    assert all("licen" in t.lower() for _, t in NOTICES)
    assert slow(texts[0]) == slow(texts[1]) == slow(texts[2]) == slow(mit)
    assert L.scan(df.limit(0)).count() == 0


def test_long_licences_and_usual_forms(spark):
    """Whole texts as this system ships them, and titles and list marks as repositories have them."""
    found = sorted(f for f in pathlib.Path("/usr/share/common-licenses").glob("*") if not f.is_symlink() and f.name != "BSD")
    if not found:
        pytest.skip("no licence texts on this machine")
    bsd = next(t for x, t in TEXTS if x == "BSD-3-Clause" and "\n" in t)
    data = [(i, f.read_text(errors="replace"), f.name) for i, f in enumerate(found)]
    data += [(i + 100, t.upper(), n) for i, t, n in data if n.startswith("GPL")]
    data += [
        (200, "The MIT License (MIT)\n\nCopyright (c) 2021 A. Person\n\n" + TEXTS[0][1], "MIT"),
        (201, "BSD 3-Clause License\n\nCopyright (c) 2021, A. Person\n" + bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "BSD-3-Clause"),
        (202, "ISC Licence\n\n" + dict(TEXTS)["ISC"], "ISC"),
        (203, dict(TEXTS)["Unlicense"].replace("https://unlicense.org", "http://unlicense.org/"), "Unlicense"),
    ]
    got = {r.doc_id: r.license for r in L.scan(spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")).collect()}
    for i, _, name in data:
        assert got[i] and got[i].startswith(name.split("-")[0]) and (name in got[i] or name == "Artistic"), (name, got[i])
