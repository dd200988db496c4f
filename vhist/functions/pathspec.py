"""Path specifications: parsed on the driver, applied as a Column.

Magic: `:(top,literal,glob,icase,exclude,attr:...)path` and the short forms `:/`, `:!`, `:^`. A specification matches a path
that is equal, that lies below it as a directory, or that as a whole fits it as a wildcard in which * crosses slashes; with
`glob`, * and ? stop at slashes and `**` spans directories. Positive ones are alternatives, excludes take away, and a set
of excludes alone starts from everything. Folding is for A-Z only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST, LONGEST = 128, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java doesn't know [[:class:]], so classes are written out.
CLASSES = {
    "alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r" \t\n\r\x0B\f", "blank": r" \t",
    "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f", "cntrl": r"\x00-\x1F\x7F", "print": r"\x20-\x7E", "graph": r"!-~",
}


class PathspecError(ValueError):
    """A specification that can't be used; nothing is returned in its place."""


@dataclass(frozen=True)
class Spec:
    path: str
    magic: frozenset[str] = frozenset()
    attrs: tuple[str, ...] = field(default=())


def parse(raw: str, prefix: str = "") -> Spec:
    if len(raw.encode()) > LONGEST:
        raise PathspecError("pathspec too long")
    magic: set[str] = set()
    attrs: tuple[str, ...] = ()
    rest = raw
    if raw.startswith(":("):
        end = raw.find(")")
        if end < 0:
            raise PathspecError(f"unclosed magic in {raw!r}")
        for word in filter(None, raw[2:end].split(",")):
            if word.startswith("attr:"):
                attrs = tuple(word[5:].split())
                if not attrs:
                    raise PathspecError("empty attribute requirement")
            elif word in ("top", "literal", "glob", "icase", "exclude"):
                magic.add(word)
            else:
                raise PathspecError(f"unknown magic {word!r}")
        rest = raw[end + 1 :]
    elif raw.startswith(":"):
        short = {"/": "top", "!": "exclude", "^": "exclude"}
        k = 1
        while k < len(raw) and raw[k] in short:
            magic.add(short[raw[k]])
            k += 1
        rest = raw[k + 1 :] if raw[k : k + 1] == ":" else raw[k:]
    if {"glob", "literal"} <= magic:
        raise PathspecError("glob and literal exclude each other")
    if "top" not in magic and prefix:
        rest = f"{prefix.strip('/')}/{rest}"
    parts: list[str] = []
    for part in rest.split("/"):
        if part == "..":
            if not parts:
                raise PathspecError(f"{raw!r} is outside the repository")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return Spec("/".join(parts) + ("/" if rest.endswith("/") and parts else ""), frozenset(magic), attrs)


def fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def is_wild(path: str) -> bool:
    return bool(re.search(r"(?<!\\)[*?\[]", path))


def literal_prefix(path: str) -> str:
    """What every match starts with: pushed to the scan as a range, so that files without it are skipped."""
    return re.split(r"[*?\[\\]", path, maxsplit=1)[0]


def glob_regex(pattern: str, pathname: bool) -> str:
    """A wildcard as an anchored Java regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            stars = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            before, after = pattern[i - 1 : i], pattern[i + stars : i + stars + 1]
            if not pathname:
                out.append(".*")
            elif stars == 2 and before in ("", "/") and after in ("", "/"):
                if after:
                    out.append("(?:[^/]*/)*")
                    stars += 1
                else:
                    out.append(".*")
            else:
                out.append("[^/]*")
            i += stars
            continue
        if c == "?":
            out.append("[^/]" if pathname else ".")
        elif c == "[":
            end, body = bracket(pattern, i)
            if end < 0:
                return "(?!)"  # an unclosed bracket matches nothing
            out.append(f"(?!/){body}" if pathname else body)
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + r")\z"


def bracket(pattern: str, start: int) -> tuple[int, str]:
    """The end of a bracket expression and its Java form; -1 if it isn't closed."""
    i, body = start + 1, []
    negated = pattern[i : i + 1] in ("!", "^")
    i += negated
    first = i
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and i > first:
            return i, "[" + "^" * negated + "".join(body) + "]"
        if pattern.startswith("[:", i) and (end := pattern.find(":]", i)) > 0:
            name = pattern[i + 2 : end]
            if name not in CLASSES:
                raise PathspecError(f"unknown class {name!r}")
            body.append(CLASSES[name])
            i = end + 2
            continue
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            c = pattern[i]
            body.append("\\" + c)
        else:
            body.append("\\" + c if c in "[]^\\&~" or (c == "-" and i == first) else c)
        i += 1
    return -1, ""


def matches(spec: Spec, path: Column) -> Column:
    """Whether one positive specification matches a path."""
    want, subject = spec.path, path
    if "icase" in spec.magic:
        want, subject = want.translate(str.maketrans(UPPER, LOWER)), fold(path)
    if not want:
        return F.lit(True)
    below = subject.startswith(want if want.endswith("/") else want + "/")
    if "literal" in spec.magic or not is_wild(want):
        plain = want.replace("\\", "") if "literal" not in spec.magic else want
        return below if plain.endswith("/") else (subject == plain) | subject.startswith(plain + "/")
    prefix = literal_prefix(want)
    fits = subject.rlike(glob_regex(want.rstrip("/"), "glob" in spec.magic))
    # Names that are spelled like the wildcard, and what lies below a directory so named.
    same = (subject == want.rstrip("/")) | subject.startswith(want.rstrip("/") + "/")
    # With a final slash, what lies below a directory that it fits.
    split = F.split(subject, "/")
    parents = F.exists(F.sequence(F.lit(1), F.size(split) - 1), lambda n: F.array_join(F.slice(split, 1, n), "/").rlike(glob_regex(want.rstrip("/"), "glob" in spec.magic)))
    deeper = F.when(F.size(split) > 1, parents).otherwise(False)
    found = deeper if want.endswith("/") else fits
    return ((subject >= prefix) & subject.startswith(prefix) & found if prefix else found) | (F.lit(False) if want.endswith("/") else same)


def literal_paths(raw: list[str], prefix: str = "") -> list[str] | None:
    """The plain paths that a set of specifications names, directories with a final slash; None if any needs more than equality. These
    go the way of `path_log`, without looking at other paths."""
    out = []
    for spec in (parse(r, prefix) for r in raw):
        if spec.attrs or spec.magic & {"icase", "exclude"} or "literal" not in spec.magic and is_wild(spec.path):
            return None
        out.append(spec.path or ".")
    return out or None


def follow_path(raw: list[str], prefix: str = "") -> str:
    """The one file that a history can follow: a single plain path."""
    if len(raw) != 1:
        raise PathspecError("following takes one file")
    spec = parse(raw[0], prefix)
    if spec.attrs or spec.magic & {"glob", "icase", "exclude"} or "literal" not in spec.magic and is_wild(spec.path):
        raise PathspecError("following takes a plain path")
    if not spec.path:
        raise PathspecError("following takes a file")
    return spec.path


def looks_like_pathspec(argument: str) -> bool:
    """Whether an argument is meant as a specification even if nothing has its name: long magic or an unescaped wildcard."""
    return argument.startswith(":(") or is_wild(re.sub(r"\\\\.", "", argument))


def compile_specs(raw: list[str], path: Column, prefix: str = "", attributes: Column | None = None) -> Column:
    """One predicate for a set of specifications. ``attributes``: a map of the path's attribute states, for attr magic."""
    if len(raw) > MOST:
        raise PathspecError(f"more than {MOST} pathspecs")
    plus, minus = [], []
    for spec in (parse(r, prefix) for r in raw if r != ":"):
        hit = matches(spec, path)
        for need in spec.attrs:
            if attributes is None:
                raise PathspecError("attribute magic without attributes")
            name = need.lstrip("-!").split("=")[0]
            state = F.coalesce(F.try_element_at(attributes, F.lit(name)), F.lit("!"))
            value = "-" if need[0] == "-" else "!" if need[0] == "!" else need.split("=", 1)[1] if "=" in need else "+"
            hit = hit & (state == value)
        (minus if "exclude" in spec.magic else plus).append(hit)
    taken = reduce(lambda a, b: a | b, plus) if plus else F.lit(True)
    return reduce(lambda a, b: a & ~b, minus, taken)


def relative_to(path: Column, folder: str) -> Column:
    """A path as seen from a folder: what is outside goes up by `..` for each level that isn't shared."""
    if not folder.strip("/"):
        return path
    base = folder.strip("/").split("/")
    parts = F.split(path, "/")
    shared = F.lit(0)
    for n in range(1, len(base) + 1):
        same = (F.size(parts) > n) & (F.array_join(F.slice(parts, 1, n), "/") == "/".join(base[:n]))
        shared = F.when(same, F.lit(n)).otherwise(shared)
    rest = F.slice(parts, shared + 1, F.size(parts) - shared)
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.lit(len(base)) - shared), rest), "/")
