"""Turn exclusion patterns into Java regular expressions, on the driver.

Rule authors write the dialect of the Rust ``regex`` and ``globset`` crates (both publicly
documented). Two facts make this more than passing the text through: a pattern that is *not*
legal in that dialect gets a second chance with its backslashes read as separators, and Java
accepts several escapes (``\\Q``, ``\\h``, ``\\G``, ``\\X``, ``\\R``) the dialect rejects. So legality
is decided here, from the dialect's own list of escapes, and never by Java.
"""

from __future__ import annotations

import re

# What the dialect's bracketed names cover (ASCII only).
POSIX_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\x0C\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

# One-letter escapes that mean a single character.
CONTROL_ESCAPES = {"a": r"\x07", "f": r"\f", "t": r"\t", "n": r"\n", "r": r"\r", "v": r"\x0B"}

# Escapes that assert a position.
ASSERTIONS = {
    "A": r"\A",
    "z": r"\z",
    "b": r"\b",
    "B": r"\B",
    "<": r"\b(?=\w)",
    ">": r"\b(?<=\w)",
    "b{start}": r"\b(?=\w)",
    "b{end}": r"\b(?<=\w)",
    "b{start-half}": r"(?<!\w)",
    "b{end-half}": r"(?!\w)",
}

# Java flags that give the dialect's defaults: Unicode classes and case folding, and \n as the
# only line terminator.
BASE_FLAGS = "(?dU)"

_GROUP_NAME = re.compile(r"\?P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>")
_GROUP_FLAGS = re.compile(r"\?([A-Za-z]*)(?:-([A-Za-z]+))?([:)])")
_COUNT = re.compile(r"\{\s*(\d*)\s*(,?)\s*(\d*)\s*\}")
_HEX = re.compile(r"x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|[xuU]\{([0-9A-Fa-f]+)\}")
_PROPERTY = re.compile(r"([pP])(?:([A-Za-z])|\{(\^?)(?:[A-Za-z_]+(?:=|:))?([A-Za-z_0-9 -]+)\})")
_KEPT_ESCAPE = re.compile(r"\\(\.(?!\*)|[\^$*+?()\[\]{}|])?")


class PatternError(ValueError):
    """The pattern is not legal in the rule dialect."""


class UnsupportedPattern(ValueError):
    """Legal in the rule dialect, but without a Java counterpart."""


def with_ignore_case(pattern: str) -> str:
    """Rules ignore case unless the author opens with a group flag of their own."""
    return pattern if pattern.startswith("(?") else "(?i)" + pattern


def separators_normalized(pattern: str) -> str:
    """Read backslashes as separators, except those that escape a regex metacharacter.

    A backslash before ``.*`` is a separator followed by "anything"; before any other dot it
    keeps escaping the dot.
    """
    return _KEPT_ESCAPE.sub(lambda m: m.group(0) if m.group(1) else "/", pattern)


def regex_rule_to_java(pattern: str) -> str:
    """Compile a regex rule: as typed first, with normalised separators if that is illegal."""
    try:
        return regex_to_java(with_ignore_case(pattern))
    except PatternError as raw_error:
        normalized = separators_normalized(pattern)
        if normalized == pattern:
            raise
        try:
            return regex_to_java(with_ignore_case(normalized))
        except PatternError as error:
            raise PatternError(
                f"{error} (after reading backslashes as separators; as typed: {raw_error})"
            ) from error


def regex_to_java(pattern: str) -> str:
    """Java form of a pattern, or :class:`PatternError` when the dialect rejects it."""
    return BASE_FLAGS + _Translation(pattern).run()


def _literal(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 or char == "_" else "\\" + char


class _Translation:
    """One left-to-right pass; ``atom`` is where the last repeatable piece starts in ``out``."""

    def __init__(self, pattern: str) -> None:
        self.text = pattern
        self.pos = 0
        self.out: list[str] = []
        self.atom: int | None = None
        self.repeated = False
        self.verbose = False
        self.multiline = False
        self.groups: list[tuple[int, bool, bool]] = []

    def run(self) -> str:
        while self.pos < len(self.text):
            self.step(self.text[self.pos])
        if self.groups:
            raise PatternError("unclosed group")
        return "".join(self.out)

    def step(self, char: str) -> None:
        if char == "\\":
            self.add(self.escape(in_class=False))
        elif char == "[":
            self.add(self.bracket())
        elif char == "(":
            self.open_group()
        elif char == ")":
            self.close_group()
        elif char in "*+?{":
            self.repeat(char)
        elif char == "|":
            self.pos += 1
            self.out.append("|")
            self.atom = None
        elif self.verbose and (char.isspace() or char == "#"):
            end = self.text.find("\n", self.pos) if char == "#" else self.pos
            self.pos = len(self.text) if end < 0 else end + 1
        else:
            self.pos += 1
            if char == "$":
                self.add("$" if self.multiline else r"\z")
            else:
                self.add(char if char in "^." else _literal(char))

    def add(self, java: str) -> None:
        self.atom = len(self.out)
        self.repeated = False
        self.out.append(java)

    def escape(self, in_class: bool) -> str:
        rest = self.text[self.pos + 1:]
        if not rest:
            raise PatternError("incomplete escape at the end of the pattern")
        char = rest[0]
        found = _HEX.match(rest)
        if found:
            self.pos += 1 + found.end()
            code = int(next(g for g in found.groups() if g), 16)
            if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
                raise PatternError("escape is not a Unicode scalar value")
            return f"\\x{{{code:X}}}"
        found = _PROPERTY.match(rest)
        if found:
            self.pos += 1 + found.end()
            letter, short, negated, name = found.groups()
            if negated:
                letter = "P" if letter == "p" else "p"
            name = short or name.strip()
            return f"\\{letter}{{{name if len(name) <= 2 else 'Is' + name}}}"
        if not in_class:
            half = re.match(r"b\{(start|end)(-half)?\}", rest)
            key = half.group(0) if half else char
            if key in ASSERTIONS:
                self.pos += 1 + len(key)
                return ASSERTIONS[key]
        self.pos += 2
        if char in "dDsSwW":
            return "\\" + char
        if char in CONTROL_ESCAPES:
            return CONTROL_ESCAPES[char]
        if char.isalnum() or ord(char) > 127 or char in "<>":
            raise PatternError(f"unrecognised escape \\{char}")
        return "\\" + char

    def bracket(self) -> str:
        text, out = self.text, ["["]
        self.pos += 1
        if text[self.pos:self.pos + 1] == "^":
            out.append("^")
            self.pos += 1
        first = True
        while True:
            char = text[self.pos:self.pos + 1]
            if not char:
                raise PatternError("unclosed character class")
            if char == "]" and not first:
                self.pos += 1
                return "".join(out) + "]"
            first = False
            posix = re.compile(r"\[:(\^?)([a-z]+):\]").match(text, self.pos)
            if posix and posix.group(2) in POSIX_CLASSES:
                self.pos = posix.end()
                out.append(f"[{posix.group(1)}{POSIX_CLASSES[posix.group(2)]}]")
            elif char == "[":
                out.append(self.bracket())
            elif char == "\\":
                out.append(self.escape(in_class=True))
            elif text.startswith("&&", self.pos):
                self.pos += 2
                out.append("&&")
            elif text.startswith("--", self.pos) or text.startswith("~~", self.pos):
                raise UnsupportedPattern(f"class operator in '{text}' is not supported")
            else:
                self.pos += 1
                if not (self.verbose and char.isspace()):
                    out.append(char if char == "-" else _literal(char))

    def open_group(self) -> None:
        self.pos += 1
        named = _GROUP_NAME.match(self.text, self.pos)
        flagged = _GROUP_FLAGS.match(self.text, self.pos)
        outer = (len(self.out), self.verbose, self.multiline)
        if named:
            self.pos = named.end()
            self.out.append("(")
        elif flagged:
            self.pos = flagged.end()
            on, off, end = flagged.groups()
            java = self.flags(on, off or "")
            if end == ")":
                if not on and not off:
                    raise PatternError("empty flag group")
                self.out.append(f"(?{java})" if java else "")
                self.atom = None
                return
            self.out.append(f"(?{java}:")
        elif self.text[self.pos:self.pos + 1] == "?":
            raise PatternError("look-around is not part of the dialect")
        else:
            self.out.append("(")
        self.groups.append(outer)
        self.atom = None

    def flags(self, on: str, off: str) -> str:
        kept = {"on": "", "off": ""}
        for side, letters in (("on", on), ("off", off)):
            for letter in letters:
                if letter in "ims":
                    kept[side] += letter
                elif letter == "u":
                    kept[side] += "U"
                elif letter in "UR":
                    raise UnsupportedPattern(f"flag {letter} is not supported")
                elif letter != "x":
                    raise PatternError(f"unrecognised flag {letter}")
        if "x" in on or "x" in off:
            self.verbose = "x" in on
        if "m" in on or "m" in off:
            self.multiline = "m" in on
        return kept["on"] + ("-" + kept["off"] if kept["off"] else "")

    def close_group(self) -> None:
        if not self.groups:
            raise PatternError("unopened group")
        self.pos += 1
        start, self.verbose, self.multiline = self.groups.pop()
        self.out.append(")")
        self.atom = start
        self.repeated = False

    def repeat(self, char: str) -> None:
        if self.atom is None:
            raise PatternError("repetition without an expression")
        java = char
        if char == "{":
            found = _COUNT.match(self.text, self.pos)
            low, comma, high = found.groups() if found else ("", "", "")
            if not found or not (low or high):
                raise PatternError("malformed counted repetition")
            if low and high and int(low) > int(high):
                raise PatternError("counted repetition with its bounds reversed")
            java = "{" + (low or "0") + comma + high + "}"
            self.pos = found.end()
        else:
            self.pos += 1
        if self.repeated:
            # the dialect repeats the repetition; Java would read a possessive quantifier
            self.out[self.atom:] = ["(?:" + "".join(self.out[self.atom:]) + ")"]
        if self.text[self.pos:self.pos + 1] == "?":
            java += "?"
            self.pos += 1
        self.out.append(java)
        self.repeated = True


def glob_to_java(glob: str) -> str:
    """Java form of a glob, anchored at both ends, for a path with forward separators.

    ``*`` and ``?`` cross separators, ``**`` between separators spans any number of folders,
    ``[...]`` and ``{a,b}`` work as usual, and a backslash is a separator.
    """
    text = glob.replace("\\", "/")
    if text == "**":
        return r"(?s)\A.*\z"
    out: list[str] = []
    pos, depth = 0, 0
    while pos < len(text):
        char = text[pos]
        before = pos == 0 or text[pos - 1] in "/" or (depth and text[pos - 1] in "{,")
        if text.startswith("**", pos) and before and (pos + 2 == len(text) or text[pos + 2] == "/"):
            pos += 2
            if pos == len(text):
                # "folder/**": something below the folder
                out.append(".*")
            else:
                pos += 1
                if out and out[-1] == "/":
                    out[-1] = "(?:/|/.*/)"
                else:
                    out.append("(?:/?|.*/)")
        elif char == "*":
            while text[pos:pos + 1] == "*":
                pos += 1
            out.append(".*")
        elif char == "?":
            pos += 1
            out.append(".")
        elif char == "[":
            end = text.find("]", pos + (3 if text[pos + 1:pos + 2] in ("!", "^") else 2))
            if end < 0:
                raise PatternError(f"bad glob '{glob}': unclosed character class")
            body = text[pos + 1:end]
            negated = body[0] in "!^"
            body = body[1:] if negated else body
            for low, high in re.findall(r"(.)-(.)", body):
                if low > high:
                    raise PatternError(f"bad glob '{glob}': invalid range {low}-{high}")
            inner = "".join(c if c == "-" else _literal(c) for c in body)
            out.append(f"[{'^' if negated else ''}{inner}]")
            pos = end + 1
        elif char == "{":
            pos, depth = pos + 1, depth + 1
            out.append("(?:")
        elif char == "}":
            if not depth:
                raise PatternError(f"bad glob '{glob}': unopened alternatives")
            pos, depth = pos + 1, depth - 1
            out.append(")")
        elif char == "," and depth:
            pos += 1
            out.append("|")
        else:
            pos += 1
            out.append(char if char == "/" else _literal(char))
    if depth:
        raise PatternError(f"bad glob '{glob}': unclosed alternatives")
    return r"(?s)\A" + "".join(out) + r"\z"
