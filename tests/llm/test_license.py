import re

import cases
import pyarrow as pa
import pytest

from indexloom.llm import license_scan, textops


def hashes(text):
    return textops.Words(*textops.utf8(pa.array([text], type=pa.large_string()))).hash


def finds(spark, texts):
    rows = license_scan.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [[(f.license, f.coverage, f.start, f.end) for f in r.finds] for r in sorted(rows, key=lambda r: r.doc_id)]


def test_every_template_is_found_in_full(spark):
    names = sorted(license_scan.TEMPLATES)
    pad = "some wörds before it, "
    got = finds(spark, [pad + license_scan.TEMPLATES[n] + " and after" for n in names])
    for n, f in zip(names, got, strict=True):
        assert (n, 1.0) in [x[:2] for x in f] and f[0][2] == len(pad)


def test_spans_and_altered_texts(spark):
    mit = license_scan.TEMPLATES["MIT text"].split()
    changed = " ".join(w for i, w in enumerate(mit) if i % 25 != 7)
    inserted = " ".join(w + (" really" if i % 30 == 11 else "") for i, w in enumerate(mit))
    short = "Été. Licensed under CC BY-NC 4.0.\nx"
    half = " ".join(mit[: len(mit) // 2])
    got = finds(spark, [changed, inserted, short, half, "licensed under the sun", None])
    assert got[0][0][0] == "MIT text" and 0.9 < got[0][0][1] < 1
    assert got[1][0][0] == "MIT text" and got[1][0][1] == 1
    assert [short[f[2] : f[3]] for f in got[2]] == ["Licensed under CC BY-NC 4.0"]
    assert got[3] == [] and got[4] == [] and got[5] == []


def test_winnowing_keeps_its_guarantee():
    h = hashes(" ".join(f"w{i * 7919 % 1000}" for i in range(300)))
    g = textops.shingle_hashes(h, license_scan.GRAM)
    picked = set(license_scan.winnow(g).tolist())
    assert all(picked & set(range(i, i + license_scan.WINNOW)) for i in range(len(g) - license_scan.WINNOW + 1))


@pytest.mark.parametrize("make", [cases.documents, cases.sample, cases.empty])
def test_op10_finds_all_notices(spark, make):
    """Brute force: the notices of these documents are whole, so a search for their words finds them."""
    docs = make(spark)
    notice = {n: re.compile(r"[\W_]+".join(map(re.escape, re.findall(r"\w+", t))), re.I) for n, t in license_scan.TEMPLATES.items() if n.endswith("notice")}
    want = [(r.doc_id, ",".join(sorted(n for n, p in notice.items() if p.search(r.text or "")))) for r in docs.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.licenses) for r in license_scan.find_licenses(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
