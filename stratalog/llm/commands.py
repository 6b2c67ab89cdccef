"""A shell command's key: equal for commands that do the same work.

Dropped: spacing, quoting, comments, set-up before the command (cd, set, exports, assignments, limits and
timers), what follows it for its output or exit code (redirects, pagers, echoes, `|| true`). Values that each
run makes anew (temporary names, random ids, clock values) become signs of their kind.
"""

from __future__ import annotations

import re

import pandas as pd

#: Programs that only set up, wrap, or look at another command.
SETUP = frozenset("cd pushd popd set export unset source . ulimit umask trap shopt alias module true : ".split())
REPORT = frozenset("echo printf true : exit".split())
VIEWERS = frozenset("head tail tee less more cat".split())
WRAPPERS = frozenset("time command exec nohup builtin sudo env nice ionice timeout gtimeout stdbuf setsid chronic".split())
WITH_VALUE = {"timeout": {"-k", "-s"}, "gtimeout": {"-k", "-s"}, "nice": {"-n"}, "ionice": {"-c", "-n", "-p"}, "sudo": {"-u", "-g", "-h", "-p"}, "env": {"-u", "-C"}, "stdbuf": {"-i", "-o", "-e"}, "exec": {"-a"}}

LEX = re.compile(
    r"""(?P<skip>[ \t\r]+|\\\r?\n)
    |(?P<comment>\#[^\n]*)
    |(?P<op>\n|&&|\|\||;;|;|\|&|\||&>>?|\d?>>?&[\d-]|\d?>>?\|?|<<<|<<-?|<|&|[()])
    |(?P<word>(?:'[^']*'|"(?:\\.|[^"\\])*"|\$\((?:[^()]|\([^()]*\))*\)|`[^`]*`|\\.|[^\s'"`\\&|;<>()]|['"`\\])+)""",
    re.X | re.S,
)
PIECE = re.compile(r"""'(?P<s>[^']*)'|"(?P<d>(?:\\.|[^"\\])*)"|\\(?P<e>.)|(?P<sub>\$\((?:[^()]|\([^()]*\))*\)|`[^`]*`)""", re.S)
UUID = re.compile(r"\b[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b")
TEMP = re.compile(r"(?:/private)?(?:/var)?/(?:tmp|folders)/[^\s\"'=,;:]+|\$\{?TMPDIR\}?/[^\s\"'=,;:]+")
RANDOM = re.compile(r"tmp\.?[A-Za-z0-9_]{6,}|[A-Za-z0-9]*\d[A-Za-z]+\d[A-Za-z0-9]*|(?<![A-Za-z])[0-9a-f]{6,}(?![A-Za-z])|\d{5,}|<id>|X{6,}|\$\$|\$RANDOM|[A-Z][a-z]+[A-Z][A-Za-z]*")
CLOCK = re.compile(r"(?<![\w.])1[3-9]\d{8}(?:\.\d+|\d{3}|\d{6})?(?![\w.])|\b20\d\d-[01]\d-[0-3]\d[T_ ][0-2]\d[:-]?[0-5]\d(?:[:-]?[0-5]\d)?(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?|\b20\d{6}[T_-]?[0-2]\d[0-5]\d[0-5]\d\b")
ASSIGN = re.compile(r"[A-Za-z_]\w*\+?=")
LIMIT = re.compile(r"\d+(?:\.\d+)?[smhd]?")


def _unquote(word: str) -> str:
    if not re.search(r"['\"\\]", word):
        return word

    def plain(m: re.Match) -> str:
        if m["s"] is not None:
            return m["s"]
        if m["d"] is not None:
            return re.sub(r"\\([\"\\$`\n])", r"\1", m["d"])
        return m["sub"] or m["e"]

    return PIECE.sub(plain, word)


def _stable(word: str) -> str:
    word = UUID.sub("<id>", word)
    word = TEMP.sub(lambda m: "<tmp>" if RANDOM.search(m[0].split("/", 2)[-1]) else m[0], word)
    return CLOCK.sub("<time>", word)


def _segments(cmd: str) -> list[tuple[str, list[str], list[str]]]:
    """(operator before, words, output redirects) of each simple command."""
    out: list[tuple[str, list[str], list[str]]] = []
    words: list[str] = []
    redirects: list[str] = []
    before, target = "", ""
    heredoc = None
    for m in LEX.finditer(cmd):
        kind, text = m.lastgroup, m[0]
        if kind == "skip":
            continue
        if kind == "comment":
            if m.start() and cmd[m.start() - 1] not in " \t\r\n;&|(":
                words.append(text)
            continue
        if kind == "word":
            if target:
                if target.startswith("<"):
                    words.append(target + _unquote(text))
                    heredoc = heredoc or target.startswith("<<") and target != "<<<"
                else:
                    redirects.append(target + _unquote(text))
                target = ""
            else:
                words.append(_unquote(text))
            continue
        if text[0] in "<>" or text[0].isdigit() or text.startswith("&>"):
            target = "" if text[-1].isdigit() or text[-1] == "-" and "&" in text else text.lstrip("012")
            continue
        if text == "&" and words and words[-1] == ">":
            continue
        if words or redirects:
            out.append((before, words, redirects))
        words, redirects, before, target = [], [], text, ""
    if words or redirects:
        out.append((before, words, redirects))
    return out


def _unwrap(words: list[str]) -> list[str]:
    while words:
        if ASSIGN.match(words[0]):
            words = words[1:]
        elif words[0].rpartition("/")[2] in WRAPPERS:
            wrapper, words = words[0].rpartition("/")[2], words[1:]
            while words and (words[0].startswith("-") or wrapper == "env" and ASSIGN.match(words[0])):
                words = words[2 if words[0] in WITH_VALUE.get(wrapper, ()) else 1 :]
            if wrapper.endswith("timeout") and words and LIMIT.fullmatch(words[0]):
                words = words[1:]
        else:
            return words
    return words


def command_key(cmd: str | None, depth: int = 0) -> str | None:
    """The key of a command, None for null. A command that is nothing but set-up or comment is keyed by its own words."""
    if cmd is None:
        return None
    every = _segments(cmd)
    kept: list[str] = []
    said: list[str] = []  # echoes and the like: the command only where there is no other
    piped = False
    for before, words, redirects in every:
        piped = before in ("|", "|&") and (piped or bool(kept))
        core = _unwrap(words)
        if not core:
            continue
        program = core[0]
        if piped and program in VIEWERS:
            continue
        if program in SETUP and not piped:
            continue
        quiet = program in REPORT and not any(r.startswith(">") for r in redirects)
        if program in ("bash", "sh", "zsh") and len(core) == 3 and re.fullmatch(r"-\w*c", core[1]) and depth < 100:
            kept.append(command_key(core[2], depth + 1) or "")
            continue
        text = []
        for w in core:
            name, eq, value = w.partition("=") if re.match(r"--[\w-]+=", w) else (w, "", "")
            text += [_stable(name), _stable(value)] if eq else [_stable(w)]
        if program in REPORT or program == "cat" and any(w.startswith("<<") for w in core):
            text += [_stable(r) for r in redirects if r.startswith(">") and "/dev/" not in r]
        (said if quiet else kept).append(("| " if piped else "") + "\x1f".join(text))
    kept = kept or said
    if not kept:
        return _stable(" ".join(w for _, words, _ in every for w in words))
    return "\x1e".join(kept)


def keys(commands: pd.Series) -> pd.Series:
    """command_key over an Arrow batch; repeated commands are analysed once."""
    known = {c: command_key(c) for c in commands.dropna().unique()}
    return commands.map(known).where(commands.notna(), None)
