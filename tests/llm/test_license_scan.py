from datumloom.llm import license_scan as scan


def found(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return scan.license_matches(df, **options).collect()


def test_whole_and_changed_templates(spark):
    mit, bsd = scan.TEMPLATES["MIT"], scan.TEMPLATES["BSD"]
    changed = mit.replace("free of charge", "for no money at all").replace("merge, ", "")
    text = f"Header words. {changed} Then something else entirely. {bsd.upper()} End."
    rows = sorted(found(spark, [text]), key=lambda r: r.first_word)
    assert [r.license for r in rows] == ["MIT", "BSD"]
    assert 0.9 < rows[0].coverage < 1 and rows[1].coverage == 1
    assert text.lower()[rows[1].char_start : rows[1].char_end] == bsd.lower().rstrip(".")


def test_every_template_is_found_in_itself(spark):
    rows = found(spark, list(scan.TEMPLATES.values()))
    best = {}
    for r in rows:
        best.setdefault(r.doc_id, []).append((r.license, r.coverage))
    for i, name in enumerate(scan.TEMPLATES):
        assert (name, 1.0) in best[i]


def test_statements_in_documents_against_plain_search(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = ["Apache-2.0-statement", "MIT-statement", "GPL-3.0-statement", "CC-BY-NC-4.0-statement"]
    want = sorted((r.doc_id, n) for r in docs.collect() for n in names for _ in range(r.text.count(scan.TEMPLATES[n])))
    got = sorted((r.doc_id, r.license) for r in scan.license_matches(docs).collect())
    assert got == want and want


def test_winnowing_keeps_one_of_every_window():
    words = [f"w{i}" for i in range(40)]
    places = [p for _, p in scan.fingerprints(words)]
    assert all(any(s <= p < s + scan.WINDOW for p in places) for s in range(38 - scan.WINDOW + 1))
    assert scan.fingerprints(["a", "b"]) == [] and len(scan.fingerprints(["a", "b", "c"])) == 1


def test_repeated_licences_and_odd_rows(spark, odd, none):
    line = scan.TEMPLATES["MIT-statement"]
    rows = found(spark, [f"{line} x y z {line}", None, ""])
    assert len(rows) == 2 and {r.doc_id for r in rows} == {0}
    assert scan.license_matches(odd).collect() == []
    assert scan.license_matches(none).collect() == []
