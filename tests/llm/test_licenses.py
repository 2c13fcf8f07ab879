"""License scans: phrases and containment against plain Python; the query against its SQL."""

import random
import re

import duckdb
import pyarrow as pa

from millrace.llm import licenses, queries
from tests.llm.conftest import SCHEMA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(licenses._UPPER, licenses._LOWER)


def brute(text):
    text = (text or "").translate(LOWER)
    words, hits, shares = WORD.findall(text), [], {}
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    for t in licenses.TEMPLATES:
        own, n = set(licenses.template_words(t.text)), 3 * len(re.findall("[0-9a-z]+", t.text.lower())) // 2
        for i in range(len(words)):
            block = set(words[i : i + n])
            share = len(block & own) / len(own)
            if words[i] in own and share >= licenses.THRESHOLD - 1e-9 and block >= set(t.must.split()) and not block & set(t.never.split()):
                shares[t.label] = max(share, shares.get(t.label, 0))
    base = {h[1] for h in hits}
    return (
        len(words), len(hits), min(hits)[0] if hits else None, max(h[0] for h in hits) if hits else None,
        ",".join(sorted(base)), ",".join(sorted(base | set(shares))), 1.0 if hits else max(shares.values(), default=0.0),
    )


def made(rows):
    rnd, out = random.Random(8), list(rows)
    words = [w for t in licenses.TEMPLATES for w in licenses.template_words(t.text) + t.must.split() * 2 + t.never.split()] + ["cc", "by", "All", "RIGHTS", "reserved", "Kit", "é"]
    for i in range(400):
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for _ in range(3)]
        t = rnd.choice(licenses.TEMPLATES).text.split()
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice(["x", "é", "the"])
        lines.insert(rnd.randint(0, 3), rnd.choice([" ", ", ", "-"]).join(t))
        out.append((1000 + i, "\n".join(lines), "en", "a", 1, *"kisrch"))
    return out


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_against_all_blocks_and_templates(spark, rows):
    data = made(rows)
    got = licenses.scan_licenses(spark.createDataFrame(data, SCHEMA)).collect()
    want = {r[0]: brute(r[1]) for r in data}
    assert len(got) == len(data)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r["doc_id"]], r["doc_id"]
    assert sum(bool(v[5]) for v in want.values()) > 150


def test_query_against_sql(spark, docs, tmp_path):
    docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_licenses(spark, str(tmp_path)).toArrow()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op2_licenses"]).fetchall()
    assert sorted(map(tuple, got.to_pandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False)), key=str) == sorted(want, key=str)
    assert isinstance(got, pa.Table)


def test_no_templates_and_no_rows(docs, none):
    assert licenses.scan_licenses(none).collect() == []
    assert {r["score"] for r in licenses.scan_licenses(docs, templates=[]).collect()} == {0.0, 1.0}


BSD = next(t.text for t in licenses.TEMPLATES if t.label == "bsd")
CASES = {
    "Licensed under CC BY 4.0": "cc-by,cc-by-4.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
    "Licensed under the MIT License, version 2.0": "mit",
    "The license under which it was released expired": "",
    "licensed under the GNU Lesser General Public License, version 3": "gpl",
    "Permission is hereby granted, free of charge, to any person\n obtaining a copy of this software and associated\ndocumentation files (the Software)": "mit",
    BSD.replace(", ", ",\n * "): "bsd",
    " ".join(w + " of many words" * 3 for w in "released under the mit license".split()): "",
    None: "",
    "": "",
    "x " * 30_000 + "Released under the\nMIT License": "mit",
}


def test_labels_are_right(spark):
    made = [(i, t, "x") for i, t in enumerate(CASES)]
    got = licenses.scan_licenses(spark.createDataFrame(made, "doc_id long, text string, hits string")).collect()
    assert {list(CASES)[r["doc_id"]]: r["labels"] for r in got} == CASES
