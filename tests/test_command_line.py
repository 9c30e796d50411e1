"""The command line on small trees."""

import json
import os
import threading
import urllib.error
import urllib.request

import pytest

from sievework import __main__ as cli
from sievework.operators.catalog import OPTIONS, RULES, ConfigError
from sievework.sinks import dashboard
from sievework.sources import settings

TREE = {
    "src/a.ts": "// What this is for.\nexport class Wide {\n  keep(x) {\n    eval(x);\n  }\n  change(y) {\n    eval(y);\n    go(y);\n  }\n}\n",
    "src/b.ts": "// What this is for.\neval(z);\n",
    "gone/c.ts": "eval(z);\n",
    ".gitignore": "gone/\n",
}


@pytest.fixture
def tree(spark, tmp_path, monkeypatch):
    for path, text in TREE.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "session", lambda name: spark)
    return tmp_path


def evals(capsys, *args):
    code = cli.main(["analyse", *args, "--format", "json"])
    shown = json.loads(capsys.readouterr().out)
    return code, sorted((f["file_path"], f["line"]) for f in shown["findings"] if f["rule_id"] == "security.eval-call")


def test_inputs_and_missing_paths(tree, capsys):
    assert evals(capsys) == (1, [("src/a.ts", 4), ("src/a.ts", 7), ("src/b.ts", 2)])
    assert evals(capsys, "src/b.ts", "gone/c.ts") == (1, [("gone/c.ts", 1), ("src/b.ts", 2)])  # a named file is not ignored
    assert evals(capsys, "src/b.ts", "nowhere")[0] == 2
    assert cli.main(["check-ignore", "gone/c.ts", "--json"]) == 0 and json.loads(capsys.readouterr().out)[0]["source"] == "gitignore"
    assert cli.main(["check-ignore", "src/a.ts"]) == 1


def test_changed_scopes(tree, capsys):
    assert evals(capsys, "src/a.ts", "--changed-ranges", "8") == (1, [("src/a.ts", 7)])  # the method around it has changed
    assert evals(capsys, "src/a.ts", "--changed-ranges", "8", "--changed-scope", "hunk")[1] == []
    assert evals(capsys, "src/a.ts", "--changed-ranges", "4-7", "--changed-scope", "hunk")[1] == [("src/a.ts", 4), ("src/a.ts", 7)]
    git = "git -c user.email=a@x.example -c user.name=a"
    assert os.system(f"git init -q . && git add -A && {git} commit -qm one") == 0
    (tree / "src/b.ts").write_text(TREE["src/b.ts"] + "eval(w);\n")
    assert evals(capsys, "--since", "HEAD", "--changed-scope", "hunk")[1] == [("src/b.ts", 3)]
    (tree / "src/new.ts").write_text("eval(v);\n")
    assert evals(capsys, "--diff")[1] == [("src/b.ts", 3), ("src/new.ts", 1)]


def test_baseline_gates_and_profiles(tree, capsys):
    assert cli.main(["analyse", "--write-baseline", "--format", "json"]) == 1
    capsys.readouterr()
    assert evals(capsys) == (0, []) and evals(capsys, "--no-baseline")[0] == 1
    os.remove(cli.BASELINE)
    (tree / "sievework.yaml").write_text(f"schemaVersion: {settings.VERSION}\nprofile: ./own.yaml\nminimumSeverity:\n  analyse: none\n")
    (tree / "own.yaml").write_text("extends: minimal\nrules:\n  security.eval-call:\n    severity: warning\n")
    code, found = evals(capsys)
    assert code == 0 and len(found) == 3 and evals(capsys, "--fail-on", "warning")[0] == 1
    assert evals(capsys, "--no-config")[0] == 1
    config = settings.load(".")
    assert config.severities == {"security.eval-call": "warning"} and not config.enabled("waste.any-type")
    assert cli.main(["init"]) == 1 and cli.main(["init", "--force"]) == 0 and settings.load(".").minimum_severity == {"analyse": "none"}
    for bad in ("minimumSeverity:\n  dashboard: error\n", "minimumSeverity:\n  analyse: loud\n", "rules:\n  size.file-length:\n    options:\n      least: 1\n", "profile: ./none.yaml\n"):
        (tree / "sievework.yaml").write_text(f"schemaVersion: {settings.VERSION}\n{bad}")
        with pytest.raises(ConfigError):
            settings.load(".")
    (tree / "sievework.yaml").write_text(f"schemaVersion: {settings.VERSION}\nprofile: minimal\nrules:\n  waste.any-type:\n    enabled: true\n  design.large-module-concentration:\n    options:\n      minFiles: 2\n")
    config = settings.load(".")
    assert config.enabled("waste.any-type") and not config.enabled("waste.console-log") and config.option("design.large-module-concentration", "minFiles") == 2


def test_lists_and_completion(capsys):
    for args, want in ((["list"], "check-ignore"), (["list-rules"], "size.file-length"), (["list-profiles"], "strict"), (["completion", "bash"], "--changed-scope"), (["completion", "zsh"], "bashcompinit"), (["completion", "fish"], "__fish_use_subcommand")):
        assert cli.main(args) == 0 and want in capsys.readouterr().out
    assert cli.main(["list-rules", "naming.generic-parameter", "--json"]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["option_keys"] == list(OPTIONS["naming.generic-parameter"]) and shown["remediation"] and shown["list_keys"] == ["placeholder_names"]
    assert cli.main(["list-rules", "no.rule"]) == 2
    assert all(r.description and r.remediation for r in RULES.values())
    assert cli.parser().parse_args(["analyse", "--format", "odd"]).format == "text"


def test_dashboard():
    def render(kind, root):
        if root == "bad":
            raise ValueError("no")
        return f"<p>{root}</p>" if kind == "html" else "{}"

    with dashboard.server("127.0.0.1", 0, render) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{server.server_address[1]}"
        assert urllib.request.urlopen(f"{at}/?root=x", timeout=10).read() == b"<p>x</p>" and urllib.request.urlopen(f"{at}/report.json", timeout=10).read() == b"{}"
        for path, code in (("/other", 404), ("/?root=bad", 400)):
            with pytest.raises(urllib.error.HTTPError) as x:
                urllib.request.urlopen(at + path, timeout=10)
            assert x.value.code == code
        server.shutdown()
