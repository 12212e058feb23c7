"""Stored documents: programs, knowledge, the registry of data sets, and details of catalogues."""

from __future__ import annotations

import json

import pytest

from duskwatch.sources import documents, readers


def test_known_vulnerabilities_trim_their_weaknesses(spark, tmp_path):
    (tmp_path / "k.csv").write_text('cveID,vendorProject,product,dateAdded,dueDate,knownRansomwareCampaignUse,cwes\nCVE-1,V,P,2024-01-01,,Known,"CWE-79, CWE-20 ,CWE-10"\n')
    assert readers.read(spark, "kev", str(tmp_path / "k.csv")).first().cwes == ["CWE-79", "CWE-20", "CWE-10"]


def test_catalogue_text_of_inner_elements(spark, tmp_path):
    (tmp_path / "c.xml").write_text(
        '<c xmlns:xhtml="x"><Attack_Pattern ID="1" Name="A"><Description> a <xhtml:p>b <xhtml:i>c</xhtml:i></xhtml:p> &lt;d&gt; 1 &lt; 2 </Description></Attack_Pattern>'
        '<Attack_Pattern ID="2" Name="B"/></c>'
    )
    got = {r.capec_id: r.description for r in readers.read(spark, "capec", str(tmp_path)).collect()}
    assert got == {"CAPEC-1": "a b c <d> 1 < 2", "CAPEC-2": None}


def test_programs_know_their_file(spark, tmp_path):
    digest = "ab" * 32
    (tmp_path / f"{digest.upper()}.json").write_text(json.dumps({"PE Sections": [], "Imported symbols": []}))
    (tmp_path / "other.json").write_text("not json")
    got = sorted((r.sha256 or "", r.file.rpartition("/")[2]) for r in documents.read_pe_metadata(spark, str(tmp_path)).collect())
    assert got == [("", "other.json"), (digest, f"{digest.upper()}.json")]
    (tmp_path / "o").mkdir()
    (tmp_path / "o/objects.jsonl").write_text(json.dumps({"sha256": "x", "label": 1, "imports": {"a.dll": ["f"]}}) + "\nnot json\n")
    assert [r.sha256 for r in documents.read_pe_objects(spark, str(tmp_path / "o")).collect()] == ["x"]


def test_knowledge_keeps_good_records(spark, tmp_path):
    good = {"pattern_id": "a", "threat_class": "APT", "embedding": [0.0, 1.0]}
    records = [good, good | {"threat_class": "Benign"}, good | {"pattern_id": ""}, {"threat_class": "APT"}, good | {"threat_class": "x"}, good | {"pattern_id": "b", "embedding": [1.0]}, "text",
               good | {"pattern_id": "c", "embedding": [None, 1.0]}]
    (tmp_path / "1.json").write_text(json.dumps({"patterns": records, "metadata": {}}, indent=1))
    (tmp_path / "2.json").write_text("broken {")
    (tmp_path / "3.json").write_text(json.dumps({"patterns": []}))
    kept, refused = documents.read_patterns(spark, str(tmp_path), 2)
    assert [(r.pattern_id, r.threat_class) for r in kept.collect()] == [("a", "Benign")]
    assert [r.error for r in refused.orderBy("place").collect()] == ["no pattern_id", "no pattern_id", "unknown class", "wrong size of vector", "no pattern_id", "missing number in vector"]
    assert documents.of_class(kept, "Benign").count() == 1 and documents.of_class(kept, "APT").count() == 0
    with pytest.raises(ValueError, match="unknown class"):
        documents.of_class(kept, "Odd")


def test_knowledge_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "APT", [float(i), 0.5]) for i in range(25)], "pattern_id string, threat_class string, embedding array<double>")
    documents.write_patterns(rows, str(tmp_path / "kb"), per_document=10)
    kept, refused = documents.read_patterns(spark, str(tmp_path / "kb"), 2)
    assert sorted((r.pattern_id, r.embedding[0]) for r in kept.collect()) == sorted((str(i), float(i)) for i in range(25)) and refused.count() == 0
    documents.write_patterns(rows.limit(0), str(tmp_path / "none"))


def test_registry_of_known_datasets(spark, tmp_path):
    log = str(tmp_path / "log")
    assert documents.register_datasets(documents.known_datasets(spark), log).count() == 0
    odd = spark.createDataFrame([("", "n", "vulnerabilities", "csv", "available", None, None, None), ("z", "n", "vulnerabilities", "doc", "available", None, None, None)], documents.DATASET)
    assert sorted(r.error for r in documents.register_datasets(odd, log).collect()) == ["no id", "unknown format"]
    done = spark.createDataFrame([("ember", "EMBER", "malware_samples", "json", "ingested", "/d", 7, 1.5)], documents.DATASET)
    documents.register_datasets(done, log)
    assert [r.dataset_id for r in documents.datasets(spark, log, status="ingested").collect()] == ["ember"]
    assert documents.datasets(spark, log, kind="vulnerabilities").count() == 2
    total = documents.dataset_statistics(documents.datasets(spark, log)).filter("kind is null and status is null and format is null").first()
    assert (total.n, total.records, total.size_mb) == (len(documents.DESCRIPTORS), 7, 1.5)
    with pytest.raises(ValueError, match="unknown status"):
        documents.datasets(spark, log, status="odd")
