"""Cheap tests before regular expressions: strings of which every match must hold one, derived from the patterns."""

from __future__ import annotations

import re
import re._parser as sre  # its module also has the names of the operations

import ahocorasick

#: What else matches an ASCII letter where case is ignored.
FOLD = str.maketrans({"İ": "i", "ı": "i", "ſ": "s"})


def _of_parsed(parsed) -> frozenset[str]:
    """Lower-case strings of which every match of a parsed pattern has one; empty if there are none."""
    best, run = frozenset(), ""

    def better(new: frozenset[str]) -> None:
        nonlocal best
        if new and (not best or min(map(len, new)) > min(map(len, best))):
            best = new

    for op, arg in [*parsed, (None, None)]:
        if op is sre.LITERAL:
            run += chr(arg).lower()
            continue
        better(frozenset([run] if run else []))
        run = ""
        if op is sre.BRANCH:
            parts = [_of_parsed(x) for x in arg[1]]
            better(frozenset().union(*parts) if all(parts) else frozenset())
        elif op is sre.SUBPATTERN:
            better(_of_parsed(arg[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            single = len(arg[2]) == 1 and arg[2][0][0] is sre.LITERAL
            better(frozenset([chr(arg[2][0][1]).lower() * arg[0]]) if single else _of_parsed(arg[2]))
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
            better(frozenset(chr(c).lower() for _, c in arg))
    return best


def required(pattern: re.Pattern) -> frozenset[str]:
    """Lower-case strings of which every match has one, by the pattern's alternatives; a text is to be folded and lowered before."""
    return _of_parsed(sre.parse(pattern.pattern, pattern.flags))


def folded(text: str) -> str:
    """The text in lower case, as the required strings are to be looked for in it."""
    return text.translate(FOLD).lower() if "İ" in text or "ı" in text or "ſ" in text else text.lower()


def alternatives(source: str) -> list[str]:
    """The alternatives of a pattern that begin outside all brackets."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 1
        elif c == "[":
            # a class ends at the first bracket behind its first character
            i += 2 if source[i + 1] == "^" else 1
            i += source[i] == "]"
            while source[i] != "]":
                i += 2 if source[i] == "\\" else 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(source[start:i])
            start = i + 1
        i += 1
    return [*out, source[start:]]


class Guarded:
    """A pattern whose alternatives are only tried on texts that hold one of the strings which each of them requires."""

    def __init__(self, pattern: re.Pattern) -> None:
        source, flags = pattern.pattern, pattern.flags & ~re.UNICODE
        if source.startswith("(?i)"):
            source, flags = source[4:], flags | re.IGNORECASE
        self.by_string: dict[str, list[re.Pattern]] = {}
        for x in (re.compile(x, flags) for x in alternatives(source)):
            for need in required(x):
                self.by_string.setdefault(need, []).append(x)
        self.required = frozenset(self.by_string)

    def found(self, text: str, here: set[str]) -> bool:
        """Whether the pattern matches somewhere; ``here``: the required strings that the folded text has."""
        tried = set()
        for need in here & self.required:
            for x in self.by_string[need]:
                if x not in tried:
                    if x.search(text):
                        return True
                    tried.add(x)
        return False


class Finder:
    """Which of some strings a text holds, in one pass over it."""

    def __init__(self, strings: frozenset[str]) -> None:
        self.strings, self.automaton = strings, ahocorasick.Automaton()
        for x in strings:
            self.automaton.add_word(x, x)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> set[str]:
        """Those in the text, its case ignored."""
        return {x for _, x in self.automaton.iter(folded(text))}
