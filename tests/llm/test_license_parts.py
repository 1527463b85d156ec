"""Licenses named in lines and blocks."""

import re

from statewell.llm import licenses
from statewell.llm.base import table
from statewell.llm.license_texts import STATEMENTS, TEXTS

PLANTED = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def found(spark, rows):
    return {r["doc_id"]: (r["licenses"], r["n_found"]) for r in licenses.scan_parts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_lines_and_blocks(spark):
    apache = next(t for n, t in STATEMENTS if n == "Apache-2.0" and "Unless required" in t and t.startswith("Licensed"))
    rows = [(i, f"A story.\n{line}\nMore of it.") for i, line in enumerate(PLANTED)]
    rows += [
        (10, f"Story.\r\n\r\n# {apache.replace('. ', '.' + chr(10) + '# ').replace(chr(10) * 2, chr(10) + '#' + chr(10) + '# ')}\r\n \r\nEnd."),
        (11, "Story\n\n" + TEXTS["MIT"] + "\n\nRELEASED  under the MIT licence"), (12, "She had a licence to fish."), (13, None), (14, ""),
        (15, "\n".join(list(PLANTED) * 2)), (16, TEXTS["Zlib (titled)"]),
    ]
    got = found(spark, rows)
    assert [got[i] for i in range(4)] == [(name, 1) for name in PLANTED.values()]
    assert got[10][0] == "Apache-2.0" and got[11] == ("MIT", 2) and got[12] == got[13] == got[14] == (None, 0)
    assert got[15] == ("Apache-2.0,CC-BY-NC-4.0,GPL-3.0,MIT", 4) and got[16][0] == "Zlib"


def test_every_row_once_and_planted_lines(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = licenses.scan_parts(docs).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == docs.count()
    want = {k: ",".join(sorted({PLANTED[x] for x in t.split("\n") if x in PLANTED})) or None for k, t in texts.items()}
    assert {r["doc_id"]: r["licenses"] for r in got} == want and any(want.values())


def test_anchor_is_lossless():
    assert all(re.search(licenses.ANCHOR, t) for t in [*TEXTS.values(), *(t for _, t in STATEMENTS)])


def test_statements_do_not_contradict(spark):
    names = {}
    for r in spark.createDataFrame([(n.split(" (")[0], t) for n, t in [*TEXTS.items(), *STATEMENTS]], "n string, t string").select("n", licenses.digest("t").alias("d")).collect():
        names.setdefault(r["d"], set()).add(r["n"])
    assert not [v for v in names.values() if len(v) > 1]
