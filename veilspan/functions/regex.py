"""ECMAScript regular expressions in the dialects of the JVM and of RE2."""

from __future__ import annotations

import re

# Code points matched by \s in ECMAScript.  Single Latin-1 characters stay a bit test in the JVM; the others stand behind one range, since
# the JVM asks each part of a class about a character that is in none of them, some twenty times slower from three parts on.
SPACE = r"\t\n\x0B\f\r \xA0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
LINE_END = r"\n\r\u2028-\u2029"
# Any character as a class: repeated, it is matched in a loop and not by recursion.
ANY = r"[\x{0}-\x{10FFFF}]"
# Unlike \b, \w is ASCII in every JVM.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
# A boundary in front of something that can only start with a word character.
WORD_START = r"(?<!\w)"
# Ranges with an ASCII class of their own, which is one test instead of three.
CLASSES = (("A-Za-z0-9_", r"\w"), ("A-Za-z0-9", r"\p{Alnum}"), ("0-9A-Za-z", r"\p{Alnum}"))
STARTS_WITH_WORD = re.compile(r"\(*(?:\?:)?(?:[A-Za-z0-9_]|\\d|\[[A-Za-z0-9]+\])(?![?*{])")


def to_java(pattern: str, flags: str = "", trusted: bool = False) -> str:
    """Rewrite the constructs whose meaning differs; everything else is shared syntax.

    ``trusted`` allows the cheaper leading boundary, which is right when every alternative
    after it starts with a word character (true for the catalogue, unknown for user rules).
    """
    out: list[str] = []
    i, in_class, multiline = 0, False, "m" in flags
    dot = ANY if "s" in flags else f"[^{LINE_END}]"
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i:i + 2]
        if not in_class and pattern.startswith(r"[\s\S]", i):
            out.append(ANY)
            i += 6
        elif c == "\\":
            if two == r"\s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif two == r"\S":
                out.append(f"[^{SPACE}]")
            elif two == r"\b" and not in_class:
                cheap = trusted and i == 0 and STARTS_WITH_WORD.match(pattern, i + 2)
                out.append(WORD_START if cheap else BOUNDARY)
            elif two == r"\B" and not in_class:
                out.append(f"(?!{BOUNDARY})")
            else:
                out.append(two)
            i += 2
        elif in_class and (short := next((s for s in CLASSES if pattern.startswith(s[0], i)), None)):
            out.append(short[1])
            i += len(short[0])
        elif in_class:
            in_class = c != "]"
            out.append(r"\[" if c == "[" else r"\&" if c == "&" else c)
            i += 1
        elif c == "[":
            in_class = True
            negated = two == "[^"
            out.append("[^" if negated else "[")
            i += 2 if negated else 1
        elif c == ".":
            out.append(dot)
            i += 1
        elif c == "^":
            out.append(rf"(?:(?<=[{LINE_END}])|\A)" if multiline else r"\A")
            i += 1
        elif c == "$":
            out.append(rf"(?=[{LINE_END}]|\z)" if multiline else r"\z")
            i += 1
        else:
            out.append(c)
            i += 1
    return ("(?i)" if "i" in flags else "") + "".join(out)


def glob_to_java(glob: str) -> str:
    """Path glob: ``**/`` any number of folders, ``**`` anything, ``*`` and ``?`` within one."""
    wild = {"**/": "(?s:.*/)?", "**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    body = "".join(wild.get(p) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", p) for p in parts)
    return rf"(?:\A|/){body}\z"
