"""What a shell command would write into files: rows of path, content and source.

One pass over the characters with states for quotes, escapes, substitutions, redirections and
heredocs gives simple commands; forms whose content stands in the command itself become targets.
Contents that only a run would tell (of a pipe, a variable, a download) are none.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field
from pathlib import PurePosixPath

#: Sources of contents, programs that read a script or a patch, words before the program.
HEREDOC, ECHO, PYTHON, PATCH = "shell_heredoc", "shell_echo", "shell_python_write", "patch"
PYTHONS, SHELLS, PATCHERS = ("python", "python3"), ("bash", "sh", "zsh"), ("apply_patch", "applypatch")
BEFORE = ("env", "command", "builtin", "exec", "time", "nohup", "sudo")
#: Commands within commands are followed so deep.
DEPTH = 4
Target = tuple[str, str, str]


@dataclass
class Simple:
    """One simple command: words without quotes, files it redirects its output to, heredoc bodies and substituted commands."""

    words: list[str] = field(default_factory=list)
    writes: list[str] = field(default_factory=list)
    bodies: list[str] = field(default_factory=list)
    inner: list[str] = field(default_factory=list)
    piped: bool = False

    @property
    def program(self) -> tuple[str, list[str]]:
        """Its name without folder, in lower case, and its arguments; assignments and wrappers go."""
        rest = list(self.words)
        while rest and (rest[0] in BEFORE or rest[0].partition("=")[0].isidentifier() and "=" in rest[0]):
            rest.pop(0)
        return (PurePosixPath(rest[0]).name.lower(), rest[1:]) if rest else ("", [])


class Lexer:
    """Simple commands of a text. What is left open ends with the text."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0
        self.commands: list[Simple] = []
        self.now = Simple()
        self.word: list[str] | None = None
        self.expects = ""  # what the next word is: a file to write, one to read, or a heredoc's marker
        self.waiting: list[tuple[Simple, str, bool]] = []  # heredocs whose bodies start at the next line

    def run(self) -> list[Simple]:
        steps = {"'": self._single, '"': self._double, "\\": self._escape, "`": self._backtick, "\n": self._line, ">": self._output, "<": self._input}
        while self.at < len(self.text):
            c = self.text[self.at]
            if c in steps:
                steps[c]()
            elif c == "$" and self.text.startswith("$(", self.at):
                self._add(self._substitution())
            elif c == "#" and self.word is None:
                self.at = self._find("\n")
            elif c in " \t\r":
                self._end_word()
                self.at += 1
            elif c == "&" and self.text.startswith("&>", self.at):
                self._end_word()
                self.at += 1
            elif c in ";&|()":
                self._separator(c)
            else:
                self._add(c)
                self.at += 1
        self._end_command()
        return self.commands

    def _find(self, what: str, start: int | None = None) -> int:
        at = self.text.find(what, self.at if start is None else start)
        return len(self.text) if at < 0 else at

    def _add(self, piece: str) -> None:
        self.word = self.word or []
        self.word.append(piece)

    def _end_word(self) -> None:
        if self.word is None:
            return
        text, self.word = "".join(self.word), None
        if self.expects == "write":
            self.now.writes.append(text)
        elif self.expects.startswith("here"):
            self.waiting.append((self.now, text, self.expects == "here-tabs"))
        elif not self.expects:
            self.now.words.append(text)
        self.expects = ""

    def _end_command(self, piped: bool = False) -> None:
        self._end_word()
        if self.now.words or self.now.writes or self.now.inner:
            self.now.piped = piped
            self.commands.append(self.now)
        self.now, self.expects = Simple(), ""

    def _single(self) -> None:
        end = self._find("'", self.at + 1)
        self._add(self.text[self.at + 1 : end])
        self.at = end + 1

    def _double(self) -> None:
        out, self.at = [], self.at + 1
        while self.at < len(self.text) and self.text[self.at] != '"':
            if self.text[self.at] == "\\" and self.text[self.at + 1 : self.at + 2] in ('"', "\\", "$", "`", "\n"):
                out.append(self.text[self.at + 1].replace("\n", ""))
                self.at += 2
            elif self.text.startswith("$(", self.at):
                out.append(self._substitution())
            else:
                out.append(self.text[self.at])
                self.at += 1
        self.at += 1
        self._add("".join(out))

    def _escape(self) -> None:
        after = self.text[self.at + 1 : self.at + 2]
        if after != "\n":
            self._add(after)
        self.at += 2

    def _backtick(self) -> None:
        end = self._find("`", self.at + 1)
        self.now.inner.append(self.text[self.at + 1 : end])
        self._add(self.text[self.at : end + 1])
        self.at = end + 1

    def _substitution(self) -> str:
        """``$(...)`` with what it nests; quoted parentheses do not count."""
        start, depth, quote = self.at, 0, ""
        while self.at < len(self.text):
            c = self.text[self.at]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c == "\\":
                self.at += 1
            elif c in "()":
                depth += 1 if c == "(" else -1
                if not depth:
                    self.at += 1
                    break
            self.at += 1
        whole = self.text[start : self.at]
        self.now.inner.append(whole[2:-1] if whole.endswith(")") else whole[2:])
        return whole

    def _separator(self, c: str) -> None:
        two = self.text[self.at : self.at + 2]
        if c == "|" and two != "||":
            self._end_command(piped=True)
            self.at += 2 if two == "|&" else 1
            return
        self._end_command()
        self.at += 2 if two in ("&&", "||", ";;") else 1

    def _line(self) -> None:
        piped = self.now.piped
        self._end_word()
        waiting, self.waiting = self.waiting, []
        self.at += 1
        for command, marker, tabs in waiting:
            lines = []
            while self.at < len(self.text):
                end = self._find("\n")
                line, self.at = self.text[self.at : end], end + 1
                line = line.lstrip("\t") if tabs else line
                if line.rstrip("\r") == marker:
                    break
                lines.append(line)
            command.bodies.append("\n".join(lines))
        self._end_command(piped)

    def _output(self) -> None:
        stream = "".join(self.word or [])
        if stream.isdigit():
            self.word = None
        self._end_word()
        self.at += 2 if self.text[self.at : self.at + 2] in (">>", ">|") else 1
        if self.text.startswith("&", self.at):  # a copy of a stream
            self.at += 1
            while self.at < len(self.text) and self.text[self.at] in "0123456789-":
                self.at += 1
            return
        self.expects = "other" if stream.isdigit() and stream != "1" else "write"

    def _input(self) -> None:
        self._end_word()
        for sign, kind in (("<<<", "read"), ("<<-", "here-tabs"), ("<<", "here"), ("<", "read")):
            if self.text.startswith(sign, self.at):
                self.at += len(sign)
                self.expects = kind
                return


def _text(node: ast.AST | None, known: dict[str, ast.AST]) -> str:
    """The string a node stands for: a literal, or a name bound to one."""
    if isinstance(node, ast.Name):
        node = known.get(node.id)
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else ""


def _file(node: ast.AST | None, known: dict[str, ast.AST]) -> str:
    """The path of ``Path("x")`` or of ``open("x", mode)`` with a writing mode, or of a name bound to one."""
    if isinstance(node, ast.Name):
        node = known.get(node.id)
    if not isinstance(node, ast.Call) or not node.args:
        return ""
    name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else ""
    if name == "Path":
        return _text(node.args[0], known)
    modes = [*node.args[1:2], *(k.value for k in node.keywords if k.arg == "mode")]
    mode = "".join(_text(m, known) for m in modes[-1:])
    return _text(node.args[0], known) if name == "open" and isinstance(node.func, ast.Name) and set(mode) & set("wax+") else ""


def python_writes(script: str) -> list[Target]:
    """Literal texts that a Python script writes: ``write`` and ``write_text`` of paths and files opened for writing."""
    try:
        nodes = list(ast.walk(ast.parse(script)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    known: dict[str, ast.AST] = {}
    for node in nodes:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            known[node.targets[0].id] = node.value
        elif isinstance(node, ast.withitem) and isinstance(node.optional_vars, ast.Name):
            known[node.optional_vars.id] = node.context_expr
    out = []
    for node in nodes:
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("write_text", "write") and node.args:
            path, content = _file(node.func.value, known), _text(node.args[0], known)
            if path and content:
                out.append((path, content, PYTHON))
    return out


def patch_targets(patch: str) -> list[Target]:
    """The added lines of a patch for every file it names; the patch itself if it adds none."""
    from guardlake.functions.shell import PATCH_HEADS

    lines = patch.splitlines()
    heads = (next((x[len(h) :].strip() for h in PATCH_HEADS if x.startswith(h)), "") for x in lines)
    paths = list(dict.fromkeys(p for p in heads if p and p != "/dev/null")) or ["patch.diff"]
    added = "\n".join(x[1:] for x in lines if x.startswith("+") and not x.startswith("+++")) or patch
    return [(p, added, PATCH) for p in paths] if patch.strip() else []


def _after(args: list[str], option: str) -> str:
    return args[args.index(option) + 1] if option in args[:-1] else ""


def content_targets(text: str, depth: int = 0) -> list[Target]:
    """``(path, content, source)`` of what a command line writes, each once, in order."""
    if depth > DEPTH:
        return []
    out: list[Target] = []
    commands = Lexer(text).run()
    for i, c in enumerate(commands):
        name, args = c.program
        if name == "cat" and c.bodies:
            files = list(c.writes)
            if c.piped and i + 1 < len(commands) and commands[i + 1].program[0] == "tee":
                files += [a for a in commands[i + 1].program[1] if not a.startswith("-")]
            out += [(f, c.bodies[-1], HEREDOC) for f in files]
        elif name == "tee" and c.bodies:
            out += [(f, c.bodies[-1], HEREDOC) for f in (*(a for a in args if not a.startswith("-")), *c.writes)]
        elif name == "echo" and args:
            out += [(f, " ".join(args), ECHO) for f in c.writes if f.lower() not in ("/dev/null", "nul")]
        elif name in PYTHONS:
            for script in (_after(args, "-c"), *(c.bodies if not args or args[0] == "-" else [])):
                out += python_writes(script)
        elif name in SHELLS:
            for script in (_after(args, "-c"), *c.bodies):
                out += content_targets(script, depth + 1)
        elif name in PATCHERS:
            for patch in c.bodies or args[:1]:
                out += patch_targets(patch)
        for inner in c.inner:
            out += content_targets(inner, depth + 1)
    return list(dict.fromkeys(x for x in out if x[0] and x[1]))
