"""The part of YAML that configurations, schemas and extraction records use, read and written without a library.

Block mappings and sequences, flow ones on a line, plain and quoted scalars, comments, and literal (``|``) and folded
(``>``) text.  Anchors, tags and several documents are refused.
"""

from __future__ import annotations

import json
import re


class YamlError(ValueError):
    """The text isn't in the part of YAML that is read here; the message says on which line."""


_KEY = re.compile(r"""(?P<key>"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(?P<rest>.*)|$)""")
_NUMBER = re.compile(r"[-+]?\d+(?P<part>\.\d*)?(?P<exp>[eE][-+]?\d+)?$")
_WORDS = {"null": None, "~": None, "": None, "true": True, "false": False}


def _bare(line: str) -> str:
    """A line without its comment."""
    quote, escaped = "", False
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not escaped else quote
            escaped = quote == '"' and c == "\\" and not escaped
        elif c in "\"'" and (i == 0 or line[i - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def scalar(text: str) -> object:
    text = text.strip()
    if text[:1] == '"':
        return json.loads(text)
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if found := _NUMBER.match(text):
        return float(text) if found["part"] or found["exp"] else int(text)
    if text[:1] in "&*!%@`":
        raise YamlError(f"not read here: {text}")
    return text


class _Flow:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self) -> object:
        c = self.space()
        if c == "[":
            return self.items("]", lambda: self.value(), list)
        if c == "{":
            return self.items("}", self.pair, dict)
        return scalar(self.word(",]}"))

    def word(self, stops: str) -> str:
        c = self.space()
        if c in ("'", '"'):
            found = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'').match(self.text, self.at)
            if not found:
                raise YamlError(f"open quote in {self.text}")
            self.at = found.end()
            return found[0]
        begin = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops:
            self.at += 1
        return self.text[begin : self.at]

    def pair(self) -> tuple:
        key = scalar(self.word(":,}"))
        if self.space() != ":":
            return key, None
        self.at += 1
        return key, self.value()

    def items(self, close: str, one, kind):
        self.at += 1
        out = []
        while self.space() != close:
            if self.at >= len(self.text):
                raise YamlError(f"{close} is missing in {self.text}")
            out.append(one())
            if self.space() == ",":
                self.at += 1
        self.at += 1
        return kind(out)


class _Block:
    def __init__(self, text: str):
        self.lines = text.splitlines()
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        """The indentation and the content of the next line that has any."""
        while self.at < len(self.lines):
            bare = _bare(self.lines[self.at])
            if bare.strip() and bare.strip() != "---":
                return len(bare) - len(bare.lstrip(" ")), bare.strip()
            self.at += 1
        return None

    def node(self, least: int) -> object:
        found = self.peek()
        if found is None or found[0] < least:
            return None
        depth, line = found
        if line == "-" or line.startswith("- "):
            return self.sequence(depth)
        if _KEY.fullmatch(line):
            return self.mapping(depth)
        self.at += 1
        return self.inline(line, depth)

    def sequence(self, depth: int) -> list:
        out = []
        while (found := self.peek()) and found[0] == depth and (found[1] == "-" or found[1].startswith("- ")):
            rest = found[1][1:]
            inner = rest.lstrip()
            if not inner:
                self.at += 1
                out.append(self.node(depth + 1))
            elif inner.startswith("- ") or _KEY.fullmatch(inner) and inner[0] not in "[{":
                # What follows the dash is a block that begins on this line.
                self.lines[self.at] = " " * (depth + 1 + len(rest) - len(inner)) + inner
                out.append(self.node(depth + 1))
            else:
                self.at += 1
                out.append(self.inline(inner, depth))
        return out

    def mapping(self, depth: int) -> dict:
        out: dict = {}
        while (found := self.peek()) and found[0] == depth and (pair := _KEY.fullmatch(found[1])):
            key, rest = scalar(pair["key"]), (pair["rest"] or "").strip()
            self.at += 1
            if rest:
                out[key] = self.inline(rest, depth)
            else:
                after = self.peek()
                # A list may stand as deep as its key.
                same = after is not None and after[0] == depth and (after[1] == "-" or after[1].startswith("- "))
                out[key] = self.node(depth if same else depth + 1)
        return out

    def inline(self, text: str, depth: int) -> object:
        if text[0] in "|>" and re.fullmatch(r"[|>][-+]?", text):
            return self.text(text, depth)
        if text[0] in "[{":
            while text.count("[") + text.count("{") > text.count("]") + text.count("}") and self.at < len(self.lines):
                text += " " + _bare(self.lines[self.at]).strip()
                self.at += 1
            return _Flow(text).value()
        if text[0] not in "\"'":
            # A plain scalar goes on in deeper lines.
            while (found := self.peek()) and found[0] > depth and not _KEY.fullmatch(found[1]) and not found[1].startswith("- "):
                text += " " + found[1]
                self.at += 1
        return scalar(text)

    def text(self, mark: str, depth: int) -> str:
        held: list[str] = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip(" ")) > depth):
            held.append(self.lines[self.at])
            self.at += 1
        while held and not held[-1].strip():
            held.pop()
        margin = min((len(x) - len(x.lstrip(" ")) for x in held if x.strip()), default=0)
        joined = ("\n" if mark[0] == "|" else " ").join(x[margin:] for x in held)
        return joined if mark.endswith("-") or not held else joined + "\n"


def load(text: str) -> object:
    block = _Block(text)
    out = block.node(0)
    if block.peek() is not None:
        raise YamlError(f"line {block.at + 1}: {block.lines[block.at].strip()}")
    return out


_PLAIN = re.compile(r"[A-Za-zÀ-ɏ_/][\w À-ɏ./()+=@-]*")


def _word(value: object) -> str:
    if isinstance(value, str):
        plain = _PLAIN.fullmatch(value) and value == value.strip() and value.lower() not in _WORDS
        return value if plain else json.dumps(value, ensure_ascii=False)
    return json.dumps(value) if value is not None else "null"


def dump(value: object, depth: int = 0) -> str:
    """``value`` (of dicts, lists and scalars) as block YAML, keys in their order."""
    pad = "  " * depth
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{_word(k)}:" + (f"\n{dump(v, depth + 1)}" if isinstance(v, dict | list) and v else f" {dump(v).strip()}\n") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-" + (f" {dump(v, depth + 1).lstrip()}" if isinstance(v, dict | list) and v else f" {dump(v).strip()}\n") for v in value)
    return f"{pad}{'{}' if value == {} else '[]' if value == [] else _word(value)}\n"
