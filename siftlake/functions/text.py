"""Column functions over paths, lines and repository addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from siftlake import rules as R

# Fixed value: the characters that count as white space when trimming.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Case-insensitive, Unicode classes, and only \n ends a line.
FLAGS = "(?iUd)"


def strip(col: Column) -> Column:
    """B2: trim all Unicode white space."""
    return F.btrim(col, F.lit(WHITESPACE))


def sql_text(text: str) -> str:
    """``text`` as a literal of Spark SQL.  Large expressions are written as SQL text:
    one call to the JVM in place of thousands."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_word(words) -> str:
    """Pattern for any of the words, taken literally."""
    return "|".join(re.escape(w) for w in words)


def starts_with_any(column: str, prefixes) -> str:
    """SQL text."""
    return " OR ".join(f"startswith({column}, {sql_text(p)})" for p in prefixes)


def contains_any(col: Column, words) -> Column:
    return col.rlike(any_word(words))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_ext(path: Column) -> Column:
    """The last dot suffix of the base name; leading dots do not start one."""
    return F.regexp_extract(path, r"(?:^|/)\.*[^/.][^/]*(\.[^./]*)$", 1)


def has_extension(path: Column, extensions) -> Column:
    """Keep by suffix, so that a file named just ``.py`` counts too."""
    return path.rlike(rf"(?:{any_word(extensions)})\z")


def comment_mark(ext: Column) -> Column:
    """What starts a line comment in files of this kind, or null."""
    return (F.when(has_extension(ext, R.HASH_COMMENT_EXTENSIONS), "#")
            .when(has_extension(ext, R.SLASH_COMMENT_EXTENSIONS), "//"))


def strip_comments(stripped: Column, mark: Column) -> Column:
    """B3 on a stripped line: cut at the first line-comment mark, even when it is
    inside a string.  Most lines need none of the three steps."""
    flat = F.when(stripped.contains("\t") | stripped.contains("\xa0"),
                  F.translate(stripped, "\xa0\t", "  ")).otherwise(stripped)
    return F.when(flat.contains(mark), strip(F.call_function(
        "substring_index", flat, mark, F.lit(1)))).otherwise(flat)


def decode_text(raw: Column) -> Column:
    """A3: bytes to text; bytes that are not UTF-8 vanish and line ends become \\n."""
    text = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\ufffd", "")
    return unify_newlines(text)


def unify_newlines(text: Column) -> Column:
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def _bare_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(url), "/+$", ""), r"\.git$", "")


def repo_name(url: Column) -> Column:
    """Last part of an address, lower case."""
    bare = _bare_url(url)
    last = F.when(bare.contains("/"), F.substring_index(bare, "/", -1)).otherwise(
        F.substring_index(bare, ":", -1))
    return F.lower(last)


# Fixed value: how owner and repository are found in an address.
OWNER_REPO = r"(?d)[:/]([^/]+)/([^/]+?)(?:\.git)?$"


def owner_name(url: Column) -> Column:
    """B6, first part: '' when the address has no owner."""
    return F.lower(F.regexp_extract(_bare_url(url), OWNER_REPO, 1))


def owned_repo_name(url: Column) -> Column:
    """B6, second part: falls back to :func:`repo_name`."""
    found = F.lower(F.regexp_extract(_bare_url(url), OWNER_REPO, 2))
    return F.when(found != "", found).otherwise(repo_name(url))


def safe_filename(path: Column) -> Column:
    """B14."""
    return F.translate(path, " áé", "_ae")


def clean_report_path(path: Column) -> Column:
    """Drop any leading run of dots and slashes."""
    return F.ltrim(strip(path), F.lit("./"))


def valid_repo_url(url: Column) -> Column:
    """C10."""
    return F.coalesce(F.length(strip(url)) >= 10, F.lit(False))


# Addresses that raise no warning.
USUAL_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")


def unusual_host(url: Column) -> Column:
    return ~contains_any(F.substring_index(url, "?", 1), USUAL_HOSTS)


def snippet_clip(line: Column, size: int) -> Column:
    """B9."""
    return F.substring(strip(line), 1, size)


def parse_coverage(value: Column) -> Column:
    """A number, or text with '%'; anything else is 0."""
    text = strip(F.replace(value.cast("string"), F.lit("%"), F.lit("")))
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def _split_on_any_run(pattern: str) -> list[str]:
    """Cut a pattern at each ``.*`` outside groups and character classes."""
    pieces, start, depth, in_class, i = [], 0, 0, False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif depth == 0 and pattern.startswith(".*", i):
            pieces.append(pattern[start:i])
            start = i = i + 2
            continue
        i += 1
    return pieces + [pattern[start:]]


# Patterns whose repeated ends do not change *whether* a line matches.
_SHORTER = {
    r"#.*\w+\s*=\s*\w+": r"#.*\w\s*=\s*\w",
    r"//.*\w+\s*=\s*\w+": r"//.*\w\s*=\s*\w",
    r"\b[A-Z][a-z]+[A-Z][a-zA-Z]*\s*=\s*[0-9]+": r"\b[a-z]{3,}+\s*=\s*[0-9]",
}


# One letter, escaped mark or class of characters, perhaps repeated.
_ATOM = re.compile(r"""(\\[sSdDwWbB.\[\]()|+*?{}^$/"'\\-]|\[\^?[^\[\]\\]*\]|[^\\\[\]()|+*?{}^$])([+*](?![+*?{]))?""")


def _without_end_repeats(pattern: str) -> str:
    """``\\w+.*=`` as ``\\w.*=``: at both ends of a pattern and beside ``.*`` one of a run is enough,
    as the search or the ``.*`` takes the others.  A pattern that is more than atoms stays as it is."""
    pieces = []
    for piece in _split_on_any_run(pattern):
        atoms, at = [], 0
        while at < len(piece):
            found = _ATOM.match(piece, at)
            if found is None:
                return pattern
            atoms.append(found.groups(""))
            at = found.end()
        for end in (0, -1):
            while atoms and atoms[end][1] == "*":
                atoms.pop(end)
            if atoms:
                atoms[end] = (atoms[end][0], "")
        pieces.append("".join(a + repeat for a, repeat in atoms))
    return ".*".join(pieces) if all(pieces) else pattern


def linear_form(pattern: str) -> str:
    """A pattern that matches the same lines without trying every way to split
    them: ``a.*b.*c`` takes the first a, the first b after it, then any c.  Long
    lines (minified code) would otherwise cost a power of their length."""
    pattern = _SHORTER.get(pattern, pattern)
    if is_simple(pattern):
        pattern = _without_end_repeats(pattern)
    head, mark, tail = pattern.partition("(?!.*")
    if mark:  # x not followed by y: look only behind the last y
        return rf"^(?>(?:.*{tail[:-1]})?).*?{head}"
    pieces = _split_on_any_run(pattern)
    if len(pieces) == 1 or not all(pieces):
        return pattern
    return "^" + "".join(f"(?>.*?{p})" for p in pieces[:-1]) + ".*?" + pieces[-1]


def _needed_runs(pattern: str) -> list[tuple[str, ...]]:
    """What every match of ``pattern`` contains, in lower case: of each tuple at least one text.  A tuple is
    a run of letters and marks, or the choice of a class of marks or of a group of plain words."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        ch, literal, choice = pattern[i], "", ()
        if ch == "\\":
            i += 1
            literal = "" if pattern[i].isalnum() else pattern[i]
        elif ch == "[":
            start = i
            while pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
            choice = _one_of(pattern[start:i + 1])
        elif ch == "(":
            depth, start = 0, i
            while True:
                depth += {"(": 1, ")": -1}.get(pattern[i], 0)
                if depth == 0:
                    break
                i += 2 if pattern[i] == "\\" else 1
            choice = _one_of(pattern[start:i + 1])
        elif ch == "|":
            return []
        elif ch == "{":
            i = pattern.index("}", i)
        elif ch not in ".^$*+?":
            literal = ch
        i += 1
        kept = pattern[i:i + 1] not in ("*", "?", "{")
        if literal and kept:
            run += literal
        else:
            runs.append((run,))
            run = ""
            if choice and kept:
                runs.append(choice)
    return [tuple(x.lower() for x in r) for r in (*runs, (run,)) if all(r)]


def _one_of(part: str) -> tuple[str, ...]:
    """The texts that a class of quotation marks or a group of plain words stands for, or none."""
    if re.fullmatch(r"\[[\"'\\]+\]", part):
        return tuple(dict.fromkeys(part[1:-1].replace("\\", "")))
    words = re.fullmatch(r"\((?:\?:)?([A-Za-z0-9]+(?:\|[A-Za-z0-9]+)*)\)", part)
    return tuple(words[1].split("|")) if words else ()


def needed_literal(pattern: str) -> str:
    """The longest text, in lower case, that every match of ``pattern`` contains."""
    return max([r[0] for r in _needed_runs(pattern) if len(r) == 1] + [""], key=len)


# Marks of code that are rare in prose.
MARKS = "!\"#$%&'()*+/:;<=>?@[\\]^`{|}~"
HAS_MARK = "[" + re.escape(MARKS) + "]"


# Letters from the most to the least frequent; a search stops at each place that has the first letter of its text.
_FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def _from_rare_letter(text: str) -> str:
    """The end of ``text``, of three letters or more, that begins with the rarest letter."""
    starts = range(max(1, len(text) - 2))
    return text[max(starts, key=lambda i: (_FREQUENT.find(text[i]) % 99, -i)):]


def needed_texts(pattern: str) -> tuple[tuple[str, ...], bool]:
    """The texts of which every match of ``pattern`` contains one, the most telling choice of them; and
    whether every match contains one of ``MARKS`` as well."""
    runs = _needed_runs(pattern)
    if not runs:
        return ("",), False
    best = max(runs, key=lambda r: (min(map(len, r)), -len(r)))
    marked = any(all(set(x) & set(MARKS) for x in r) for r in runs)
    return tuple(dict.fromkeys(_from_rare_letter(x) for x in best)), marked


def folded(line: Column) -> Column:
    """Lower case for literal look-ups: the four letters that match an ASCII letter
    when case is ignored become that letter."""
    has = line.contains("\u0130") | line.contains("\u0131") | line.contains("\u017f") | line.contains("\u212a")
    return F.when(has, F.lower(F.translate(line, "\u0130\u0131\u017f\u212a", "iisk"))).otherwise(F.lower(line))


# What must not be taken apart: alternatives, groups, back references, coded characters, quoted
# runs, lazy and possessive marks, and repeats, whose ends the rest of the pattern may need.
_COMPLEX = re.compile(r"""[|()+*?{}^$]|\\[^sSdDwWbB.\[\]()|+*?{}^$/"'\\-]""")


def is_simple(pattern: str) -> bool:
    """Only letters, escaped marks, classes of characters, and ``.*`` between them; repeats only where one
    of a run is enough."""
    return not any(_COMPLEX.search(re.sub(r"\[\^?[^\[\]\\]*\]", "x", p)) or "[" in re.sub(r"\[\^?[^\[\]\\]*\]|\\.", "", p)
                   for p in _without_end_repeats(pattern).split(".*"))


def searched(pattern: str, proven=frozenset()) -> tuple[str, tuple[str, ...], bool]:
    """The pattern to search a line with, case ignored; texts in lower case of which the folded line must have
    one; and whether it must have one of ``MARKS``.  Most lines lack them and are spared the
    regular expression.  Only ``proven`` and simple patterns get a quicker form and needed texts; all
    others are matched as they are."""
    if pattern in proven or is_simple(pattern):
        return (FLAGS + linear_form(pattern), *needed_texts(pattern))
    return FLAGS + pattern, ("",), False
