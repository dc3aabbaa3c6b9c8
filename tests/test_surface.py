"""The public surface: names, command line, summary, and an entry module that stands without the subpackage llm."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from factlens import api
from factlens.cli import main
from factlens.plans.summary import html_summary
from factlens.sources import generate


def test_names():
    assert all(hasattr(api, n) for n in api.__all__)


def test_command_line(spark, tmp_path, capsys):
    generate.performance_corpus(spark, 3).select(*[f for f in __import__("factlens.schema", fromlist=["FACT"]).FACT.names]).write.parquet(str(tmp_path / "facts"))
    assert main(["validate", "--facts", str(tmp_path / "facts")]) == 0
    assert main(["snapshot", "--facts", str(tmp_path / "facts"), "--as-of", "2001-01-01", "--out", str(tmp_path / "a")]) == 0
    assert main(["audit", "--facts", str(tmp_path / "facts"), "--as-of", "2030-01-01", "--out", str(tmp_path / "b"), "--fail-on", "low"]) == 0
    assert "{}" in capsys.readouterr().out


def test_commands_from_faults_to_scores(spark, tmp_path, capsys):
    import json

    from factlens.schema import FACT
    from factlens.sources import testdata

    d = "/root/testdata/sf0.001"
    # Copies share their source row, so one of each is clean.
    testdata.facts_orders(spark, d).dropDuplicates(["source_row_key"]).select(*FACT.names).write.parquet(str(tmp_path / "facts"))
    testdata.lineages_lineitem(spark, d).select(*FACT.names).write.parquet(str(tmp_path / "history"))
    said = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    capsys.readouterr()
    assert main(["inject", "--facts", str(tmp_path / "facts"), "--as-of", "1999-01-01", "--family", "unit_drift", "--severity", "high", "--out", str(tmp_path / "i")]) == 0
    faults = said()["faults"]
    assert main(["audit", "--facts", str(tmp_path / "i/public/facts"), "--as-of", "1999-01-01", "--out", str(tmp_path / "a")]) == 0
    capsys.readouterr()
    assert main(["evaluate", "--findings", str(tmp_path / "a/findings"), "--manifest", str(tmp_path / "i/private/manifest"), "--family", "unit_drift"]) == 0
    got = said()
    assert got["faults"] == faults and 0 < got["true_positives"] <= faults and got["findings"] == got["true_positives"] + got["false_positives"] and 0 < got["recall"] <= 1
    one = spark.read.parquet(str(tmp_path / "a/findings")).filter("detector = 'unit_drift'").first()
    assert main(["explain", "--findings", str(tmp_path / "a/findings"), "--facts", str(tmp_path / "i/public/facts"), "--finding", one.finding_id]) == 0
    assert said()["records"][0]["record_id"] == one.affected
    assert main(["explain", "--findings", str(tmp_path / "a/findings"), "--facts", str(tmp_path / "facts"), "--finding", "none"]) == 2
    capsys.readouterr()
    assert main(["benchmark", "--facts", str(tmp_path / "facts"), "--history", str(tmp_path / "history"), "--as-of", "1999-01-01", "--out", str(tmp_path / "b")]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines() if x.startswith("{")]
    assert {x["dimension"] for x in lines} == {"overall", "fault_profile", "severity"} and sum(x["cases"] for x in lines if x["dimension"] == "overall") == 16
    assert main(["inject", "--facts", str(tmp_path / "i/public/facts"), "--as-of", "1800-01-01", "--family", "duplicate", "--out", str(tmp_path / "n")]) == 3


def test_report_command(spark, tmp_path, capsys):
    import json

    (tmp_path / "in.csv").write_text("entity,amount,end,filed,row\nA,1,2020-01-01,2020-01-20,r1\nA,2,2020-04-01,2020-04-20,r2\n")
    constants = {"concept_namespace": "n", "concept": "c", "unit": "USD", "period_type": "instant", "source_name": "s", "source_locator": "l"}
    (tmp_path / "m.json").write_text(json.dumps({"columns": {"entity_id": "entity", "value": "amount", "period_end": "end", "filed_on": "filed", "source_row_key": "row"}, "constants": constants, "null_tokens": [""], "available_when_filed": True}))
    rules = [{"kind": "detector", "rule_id": "d", "detector": "lookahead"}, {"kind": "publication_lag", "rule_id": "lag", "scope": {"concept_namespace": "n", "concept": "c"}, "basis": "filing", "least": 0, "most": 10, "action": "blocking"}, {"kind": "concept_unit", "rule_id": "u", "scope": {"concept_namespace": "n", "concept": "c"}, "accepted": ["USD"]}]
    run = lambda out, **more: ((tmp_path / "p.json").write_text(json.dumps({"rules": rules} | more)), main(["report", "--input", f"file://{tmp_path}/in.csv", "--format", "csv", "--mapping", f"file://{tmp_path}/m.json", "--policy", f"file://{tmp_path}/p.json", "--as-of", "2021-01-01", "--out", f"file://{tmp_path}/{out}"]))[1]
    assert run("a") == 4 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["disposition"] == "blocking"
    assert run("b", exceptions=[{"exception_id": "x", "rule_id": "lag", "effect": "waive", "reason": "z"}]) == 0
    assert run("c", exceptions=[{"exception_id": "x", "rule_id": "other", "effect": "waive", "reason": "z"}]) == 3
    (tmp_path / "in.csv").write_text("entity,amount,end,filed,row\nA,x,2020-01-01,2020-01-20,r1\n")
    assert run("d") == 3 and spark.read.parquet(f"file://{tmp_path}/b/evaluations").count() == 3


def test_summary_escapes(spark):
    page = html_summary("<t>", counts=spark.createDataFrame([("a<b", None)], "name string, n int"))
    assert "&lt;t&gt;" in page and "a&lt;b" in page and "<b" not in page.replace("<body", "")


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_stands_without_llm(tmp_path, pipeline):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "factlens", tmp_path / "factlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py")[: 1 + pipeline]:
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:" + ":".join(p for p in sys.path if "site-packages" in p)}, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 50, said.stderr
