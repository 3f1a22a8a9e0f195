"""Lineage of any depth, shell lexing, guards with nulls."""

import pytest
from pyspark.sql import functions as F

from guardlake.functions.shell import Command
from guardlake.functions.shell_content import content_targets
from guardlake.operators import guards, sessions


def test_roots_of_long_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(1000)]
    cycle = [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2000)]
    got = {r.child: r.root for r in sessions.roots(spark.createDataFrame(chain + cycle, "child long, parent long")).collect()}
    assert all(got[i] == 1000 for i in range(1000)) and all(got[i] == i for i in range(2000, 2004))
    assert sessions.roots(spark.createDataFrame([], "child long, parent long")).count() == 0


@pytest.mark.parametrize(
    "text,mutates,reads,targets",
    [
        ("", False, False, []),
        ("echo 'unclosed", False, True, []),
        ("ls\nrm a.txt", True, False, ["a.txt"]),
        ("find . -name x -delete", True, False, []),
        ("echo $(rm b.py)", True, False, ["b.py"]),
        ("cat a.py | grep x > out.log", True, False, ["a.py", "out.log"]),
        ("cat a.py 2>&1", False, True, ["a.py"]),
        ("sed -n 1,5p README", False, True, ["README"]),
        ("sed -i s/a/b/ c.cfg", True, False, ["s/a/b/", "c.cfg"]),
        ("python -c \"import os; os.system('rm x.txt')\"", True, False, ["x.txt"]),
        ("node -e \"fs.writeFileSync('a.js', '')\"", True, False, ["a.js"]),
        ("Set-Content a.txt hi", True, False, ["a.txt"]),
        ("cmd --out=build/a.bin --message=b.txt *.py", False, False, ["build/a.bin"]),
    ],
)
def test_commands(text, mutates, reads, targets):
    c = Command(text)
    assert (c.mutates, c.reads, c.targets()) == (mutates, reads, targets)


def test_guards_with_nulls(spark):
    schema = "seq long, session_id string, event_name string, tool_name string, command string, path string, content string, response string"
    rows = [(1, None, None, None, None, None, None, None), (2, "s", "PreToolUse", "Bash", None, None, None, None), (3, "s", "PreToolUse", None, "rm /etc/x", None, None, None), (4, "s", "Stop", None, None, None, None, None)]
    events = spark.createDataFrame(rows, schema)
    assert guards.guard_findings(events).count() == 0
    assert [(r.session_id, r.seq) for r in guards.stop_reminders(events).collect()] == [("s", 4)]
    assert guards.guard_findings(events.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,targets",
    [
        ("echo 'from typing import Any' > src/example.py", [("src/example.py", "from typing import Any", "shell_echo")]),
        ("cat > src/example.py <<'PY'\nx = y  # type: ignore[arg-type]\nPY", [("src/example.py", "x = y  # type: ignore[arg-type]", "shell_heredoc")]),
        ("cat <<EOF | tee -a a.txt b.txt\nhi\nEOF\nls", [("a.txt", "hi", "shell_heredoc"), ("b.txt", "hi", "shell_heredoc")]),
        ("cat <<-E > t\n\tone\n\t two\n\tE\necho 2 > u", [("t", "one\n two", "shell_heredoc"), ("u", "2", "shell_echo")]),
        ("cat > f <<E\nno end", [("f", "no end", "shell_heredoc")]),
        ("python3 - <<'E'\nfrom pathlib import Path\nPath('a.py').write_text('x=1')\nE", [("a.py", "x=1", "shell_python_write")]),
        ("python -c \"open('o.txt','w').write('hey')\"", [("o.txt", "hey", "shell_python_write")]),
        ("python -c \"p='a.md'\nwith open(p, mode='a') as f: f.write('zz')\"", [("a.md", "zz", "shell_python_write")]),
        ("python -c \"open('o.txt').write('hey')\"", []),
        ("python -c 'not python ('", []),
        ("bash -c \"echo hi > x.txt\"", [("x.txt", "hi", "shell_echo")]),
        ("echo $(echo q > z.txt) `echo r > y.txt`", [("z.txt", "q", "shell_echo"), ("y.txt", "r", "shell_echo")]),
        ("FOO=1 sudo echo a b >> c 2>&1; echo no 2> err; echo x > /dev/null", [("c", "a b", "shell_echo")]),
        ("echo \"a \\\"b\\\" > c\" >| q # > z", [("q", 'a "b" > c', "shell_echo")]),
        ("apply_patch <<'EOF'\n*** Update File: .env\n+A=1\n-B=2\nEOF", [(".env", "A=1", "patch")]),
        ("echo 'open > x", []),
        ("cat a | tee b; echo done", []),
        ("", []),
        ("echo a\\\nb > c; echo a > c; echo a > c", [("c", "ab", "shell_echo"), ("c", "a", "shell_echo")]),
    ],
)
def test_contents_of_commands(text, targets):
    assert content_targets(text) == targets


def test_very_long_and_deep_commands():
    assert content_targets("cat > f <<E\n" + "x" * 1_000_000 + "\nE")[0][1] == "x" * 1_000_000
    assert content_targets("python -c 'x = " + "+".join(["1"] * 5000) + "'") == []
    assert content_targets("echo " + "$(" * 500 + ")" * 500) == []


def test_paths_are_resolved(spark):
    rows = [("../../etc/x", "/a/b"), ("../../etc/x", None), ("./../../../etc/x", "/a"), ("/ETC//x/../y", "/q"), ("C:\\Windows\\x", "/q"), ("", "/q"), (None, "/q")]
    df = spark.createDataFrame(rows, "p string, f string")
    got = [r[0] for r in df.select(guards.resolved(F.col("p"), F.coalesce("f", F.lit("/workspace")))).collect()]
    assert got == ["/etc/x", "/etc/x", "/etc/x", "/etc/y", "c:/windows/x", "/q", None]


def test_patch_column_and_cwd(spark):
    schema = "seq long, event_name string, tool_name string, command string, path string, content string, response string, patch string, cwd string"
    rows = [(1, "PreToolUse", "Edit", None, "a.py", None, None, "+++ b/id_rsa\n+x", None), (2, "PreToolUse", "Read", None, "../boot/x", None, None, None, "/srv"), (3, "PreToolUse", "Read", None, "boot/x", None, None, None, None)]
    got = sorted(tuple(r) for r in guards.guard_findings(spark.createDataFrame(rows, schema)).select("seq", "rule_id", "target").collect())
    assert got == [(1, "GLOBAL-BUILTIN-SENSITIVE-DATA", "id_rsa"), (2, "GLOBAL-BUILTIN-SYSTEM-PROTECTION", "../boot/x")]


def test_large_contents_by_target(spark):
    schema = "seq long, event_name string, tool_name string, command string, path string, content string, response string"
    long = "x" * 50_001
    rows = [(1, "PreToolUse", "Bash", f"cat > big.txt <<E\n{long}\nE", None, None, None), (2, "PreToolUse", "apply_patch", None, None, f"*** Add File: p.txt\n+{long}", None)]
    got = sorted((r.seq, r.target) for r in guards.guard_findings(spark.createDataFrame(rows, schema)).where("rule_id = 'WARN-LARGE-001'").collect())
    assert got == [(1, "big.txt"), (2, "p.txt")]
