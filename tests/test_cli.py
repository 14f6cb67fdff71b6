import json

from tallyspark.cli import BAD_INPUT, BAD_STORE, FAILED, OK, main


def test_configuration_and_trail_commands(tmp_path, capsys):
    (tmp_path / "good.yaml").write_text("fiscal_year_end: 06-30\nreport_formats: [json]\n")
    (tmp_path / "bad.yaml").write_text("a: b\n  c: d\n")
    (tmp_path / "rules.yaml").write_text("- {id: R1, name: x, field: a, condition: is_null}\n")
    (tmp_path / "wrong.yaml").write_text("rules_file: rules.yaml\n")
    assert main(["validate-config", "--config", str(tmp_path / "good.yaml")]) == OK
    assert main(["validate-config", "--config", str(tmp_path / "bad.yaml")]) == BAD_INPUT
    assert main(["validate-config", "--config", str(tmp_path / "wrong.yaml")]) == BAD_INPUT
    assert main(["validate-config", "--config", str(tmp_path / "none.yaml")]) == BAD_INPUT
    (tmp_path / "t.jsonl").write_text("{}\n")
    assert main(["verify", str(tmp_path / "t.jsonl")]) == FAILED
    assert "can't be read" in capsys.readouterr().out


def test_run_list_and_export(spark, tmp_path, capsys):
    (tmp_path / "in.csv").write_text("account,amount,date\nA,100,2024-01-01\nB,-50,2024-01-02\nA,100,2024-01-01\n")
    out = str(tmp_path / "out")
    assert main(["run", str(tmp_path / "none.csv"), "--output-dir", out]) == BAD_INPUT
    assert main(["run", str(tmp_path / "in.csv"), "--output-dir", out, "--dry-run"]) == OK
    assert main(["run", str(tmp_path / "in.csv"), "--output-dir", out]) == OK
    session = capsys.readouterr().out.split("session ")[1].split(":")[0]
    report = json.loads((tmp_path / "out" / f"{session}_report.json").read_text())
    assert report["integrity"]["score"] == 8 and report["integrity"]["rating"] == "MINOR"
    assert main(["verify", str(tmp_path / "out" / f"{session}_trail.jsonl")]) == OK
    assert main(["sessions", "--output-dir", out]) == OK and session in capsys.readouterr().out
    assert main(["export", "--session", session, "--output-dir", out, "--format", "json"]) == OK
    assert main(["export", "--session", "none", "--output-dir", out]) == BAD_STORE
