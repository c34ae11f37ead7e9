"""Declared log formats: `$name` templates as one anchored regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

BUILT_IN = "nginx-combined"

#: Fixed value: the built-in grammar. Possessive, so that no field takes a part of another.
COMBINED = r'^ *+([^ ]++) *+([^ ]++) *+([^ ]++) *+\[([^\]]*+)\] *+"([^"]*+)" *+([^ ]++) *+([^ ]++) *+"([^"]*+)" *+"([^"]*+)"(?U:\s)*+\z'
COMBINED_FIELDS = {"remote_user": 3, "time_local": 4, "request": 5, "status": 6, "body_bytes_sent": 7}

#: Fixed value: names of one field.
ALIASES = {"uri": "request_uri"}
USED = ("request", "request_method", "request_uri", "status", "time_local", "time_iso8601", "remote_user", "body_bytes_sent")


class GrammarError(ValueError):
    pass


@dataclass(frozen=True)
class Grammar:
    """pattern: a Java regular expression; fields: group of each used field; declared: not the built-in one."""

    pattern: str
    fields: dict[str, int]
    declared: bool


def compile_format(text: str) -> Grammar:
    """The built-in grammar by its name, or a template of $name and ${name} between literals."""
    if "$" not in text:
        if text == BUILT_IN:
            return Grammar(COMBINED, COMBINED_FIELDS, False)
        raise GrammarError("empty log format" if not text.strip() else f"unknown log format {text!r}")
    return _declared(text)


def _pieces(text: str) -> list[tuple[str, str]]:
    if "\\" in text:
        raise GrammarError("a log format has no escape sequences")
    out: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        if text[at] != "$":
            end = text.find("$", at)
            end = len(text) if end < 0 else end
            out.append(("literal", text[at:end]))
            at = end
            continue
        braced = text[at + 1 : at + 2] == "{"
        if braced:
            end = text.find("}", at)
            if end < 0:
                raise GrammarError("${ without }")
            name, after = text[at + 2 : end], end + 1
        else:
            name = re.match(r"[A-Za-z0-9_]*", text[at + 1 :])[0]
            after = at + 1 + len(name)
        if not name:
            raise GrammarError("a variable without a name")
        if out and out[-1][0] == "variable":
            raise GrammarError(f"${out[-1][1]} and ${name} have nothing between them")
        out.append(("variable", name))
        at = after
    return out


def _declared(text: str) -> Grammar:
    pieces = _pieces(text)
    pattern, fields, group = "^", {}, 0
    for i, (kind, value) in enumerate(pieces):
        if kind == "literal":
            pattern += " ++" if not value.strip(" ") else "".join(c if c.isalnum() or c in " _" else "\\" + c for c in value)
            continue
        group += 1
        after = pieces[i + 1][1] if i + 1 < len(pieces) else None
        stop = " " if after is None else after[0]
        pattern += "([^" + (stop if stop.isalnum() or stop == " " else "\\" + stop) + "]*+)"
        name = ALIASES.get(value, value)
        if name in USED:
            fields.setdefault(name, group)
    missing = []
    if "request" not in fields and not {"request_method", "request_uri"} <= fields.keys():
        missing.append("$request or $request_method and $request_uri")
    if "status" not in fields:
        missing.append("$status")
    if "time_local" not in fields and "time_iso8601" not in fields:
        missing.append("$time_local or $time_iso8601")
    if missing:
        raise GrammarError("the log format lacks " + ", ".join(missing))
    return Grammar(pattern + r"\z", fields, True)
