"""Source readers on small files of each format, bad records included."""

from __future__ import annotations

import json

import pytest

from duskwatch.sources import readers


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_flow_csv_by_duration(spark, tmp_path):
    head = "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label"
    rows = ["2011/08/10 09:46:53.047277,3.5,tcp,10.0.0.1,1577,->,8.8.8.8,443,S,0,0,10,900,300,flow=From-Botnet-V1", "bad,x,udp,10.0.0.2,,->,9.9.9.9,zz,S,0,0,,100,400,Background"]
    got = readers.read(spark, "flow_duration", write(tmp_path, "f.csv", "\n".join([head, *rows]))).orderBy("src_ip").collect()
    assert (got[0].label, got[0].botnet, got[0].bytes_received, got[0].dst_port) == ("From-Botnet-V1", True, 600, 443)
    assert got[0].ts.year == 2011 and got[1].ts is None and got[1].bytes_received == 0 and got[1].src_port == 0


def test_flow_csv_by_direction(spark, tmp_path):
    text = " Timestamp, Source IP, Protocol, Flow Duration, Total Fwd Packets, Total Backward Packets, SYN Flag Count, Label\n03/07/2017 08:55:00,1.2.3.4,6,2500000,3,4,1, BENIGN\n"
    row = readers.read(spark, "flow_direction", write(tmp_path, "c.csv", text)).first()
    assert (row.protocol, row.duration_s, row.packets, row.flags, row.label, row.dst_ip) == ("TCP", 2.5, 7, {"SYN Flag Count": 1}, "BENIGN", None)


def test_ecar_lines(spark, tmp_path):
    good = {"timestamp": 1568736000000, "id": "a", "hostname": "h", "object": "FLOW", "action": "CONNECT", "pid": 7, "properties": {"image_path": "C:\\x\\run.exe", "dest_ip": "8.8.8.8"}}
    path = write(tmp_path, "e.json", json.dumps(good) + "\n\nnot json\n")
    row = readers.read(spark, "ecar", path).first()
    assert (row.event_type, row.action, row.process_name, row.dst_ip, row.ts.year) == ("network", "connect", "run.exe", "8.8.8.8", 2019)
    assert [r.value for r in readers.read_jsonl(spark, path, readers.ECAR)[1].collect()] == ["not json"]


def test_stix(spark, tmp_path):
    item = {"type": "attack-pattern", "name": "N", "description": "d", "external_references": [{"source_name": "other", "external_id": "x"}, {"source_name": "mitre-attack", "external_id": "T1"}],
            "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "execution"}]}
    folder = tmp_path / "stix"
    folder.mkdir()
    write(folder, "bundle.json", json.dumps({"type": "bundle", "objects": [item, {"type": "malware", "name": "m"}]}))
    write(folder, "single.json", json.dumps(item | {"name": "Other", "external_references": [{"source_name": "mitre-attack", "external_id": "T2"}]}))
    got = {r.technique_id: r for r in readers.read(spark, "stix", str(folder)).collect()}
    assert set(got) == {"T1", "T2"} and got["T1"].tactics == ["execution"] and got["T1"].is_subtechnique is False


def test_capec(spark, tmp_path):
    xml = '<c><Attack_Pattern ID="1" Name="A"><Description> d </Description><Typical_Severity>High</Typical_Severity></Attack_Pattern></c>'
    row = readers.read(spark, "capec", write(tmp_path, "c.xml", xml)).first()
    assert (row.capec_id, row.name, row.description, row.severity) == ("CAPEC-1", "A", "d", "High")


def test_known_vulnerabilities(spark, tmp_path):
    head = "cveID,vendorProject,product,vulnerabilityName,dateAdded,shortDescription,requiredAction,dueDate,knownRansomwareCampaignUse,notes,cwes"
    rows = ["cve-2021-1,V,P,n,2021-11-03,s,r,2021-11-17,Known,,\"CWE-1, CWE-2,\"", "CVE-2021-1,W,P,n,bad,s,r,,Unknown,,"]
    got = readers.read(spark, "kev", write(tmp_path, "k.csv", "\n".join([head, *rows]))).collect()
    assert len(got) == 1 and got[0].vendor == "W" and got[0].cwes == [] and got[0].date_added is None and got[0].ransomware is False


def test_honeypot_and_syslog(spark, tmp_path):
    hit = {"@timestamp": "2024-01-01T00:00:00Z", "type": "cowrie", "src_ip": "1.2.3.4", "dest_port": 22, "username": "root"}
    row = readers.read(spark, "honeypot", write(tmp_path, "h.json", json.dumps(hit))).first()
    assert (row.event_type, row.severity, row.user_name) == ("auth", "HIGH", "root")
    lines = spark.createDataFrame([("<13>Jan 1 host app: " + json.dumps(hit | {"input": "wget x"}),), ("plain text",)], "value string")
    got = {r.event_type: r for r in readers.syslog_events(lines).collect()}
    assert got["process"].severity == "CRITICAL" and got["syslog"].command == "plain text"


def test_capture_events(spark, tmp_path):
    events = [
        {"event_type": "process", "timestamp": "2024-01-02T00:00:00", "source_system": "s", "event_data": {"pid": "7", "action": "create"}},
        {"event_type": "File", "timestamp": "2024-01-01T00:00:00", "source_system": "s", "event_data": {"path": "/a", "action": "READ"}},
        {"event_type": "process", "timestamp": "2024-01-01T00:00:00", "source_system": "s", "event_data": {"action": "create"}},
        {"event_type": "odd", "timestamp": "2024-01-01T00:00:00", "source_system": "s", "event_data": {"action": "x"}},
        {"event_type": "auth", "timestamp": "never", "source_system": "s", "event_data": {"action": "login", "user": "u"}},
    ]
    good, bad = readers.capture_events(readers.read_json(spark, write(tmp_path, "e.json", json.dumps(events)), readers.CAPTURE))
    assert [(r.event_type, r.action) for r in good.collect()] == [("file", "read"), ("process", "create")]
    assert sorted(r.error for r in bad.collect()) == ["process without pid", "timestamp", "unknown event type"]


def test_binary_hashes_and_registry(spark, tmp_path):
    import hashlib

    path = write(tmp_path, "x.bin", "abc")
    assert readers.file_hashes(spark, path).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    with pytest.raises(ValueError, match="unknown format"):
        readers.read(spark, "nope", path)
