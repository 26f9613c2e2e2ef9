"""Plain Python folds that the Spark results are compared with, written from the
description of the semantics and not from the Spark code."""

import os
import re

from siftlake import rules as R

DQ, SQ = '"""', "'''"


def masked_lines(lines, ext):
    """One boolean per line: is it dropped as part of a block comment?"""
    out, state = [], None
    for line in lines:
        if ext in R.TRIPLE_QUOTE_EXTENSIONS:
            for mark, other in ((DQ, SQ), (SQ, DQ)):
                if mark in line:
                    if state is None:
                        state = mark if line.count(mark) == 1 else None
                    elif state == mark:
                        state = None
                    break
        elif ext in R.BLOCK_COMMENT_EXTENSIONS:
            opens, closes = "/*" in line, "*/" in line
            if state is None and opens and not closes:
                state = "/*"
            elif state and closes and not opens:
                state = None
        out.append(state is not None)
    return out


def clean(stripped, ext):
    text = stripped.replace("\xa0", " ").replace("\t", " ").strip()
    if ext in R.HASH_COMMENT_EXTENSIONS:
        return text.split("#")[0].strip()
    if ext in R.SLASH_COMMENT_EXTENSIONS:
        return text.split("//")[0].strip()
    return text


def looked_at(group, stripped, cleaned, masked):
    starts = ("#", "//", "/*")
    if not stripped:
        return False
    if group.name == "security":
        return not (masked or stripped.startswith(starts + ("*", DQ, SQ, "import ", "from "))
                    or not cleaned or cleaned.startswith(("import ", "from ", "#", "//", "/*")))
    if group.name == "quality":
        return not (stripped.startswith(starts + ("import ", "from ", "__import__"))
                    or "import " in stripped or stripped.endswith(" import") or "from " in stripped[:10])
    if group.name == "advanced":
        return not masked and not stripped.startswith(starts) and bool(cleaned)
    return not stripped.startswith(starts)


def group_findings(group, path, content):
    """(line, issue, severity) of one group in one file."""
    ext = os.path.splitext(path)[1]
    dirs = path.split("/")[:-1]
    if not path.endswith(group.extensions):
        return []
    if group.prune and any(d.startswith(".") or d in R.VENDORED_DIRS for d in dirs):
        return []
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    masks, out, seen = masked_lines(lines, ext), [], set()
    for number, (line, masked) in enumerate(zip(lines, masks), 1):
        stripped = line.strip()
        cleaned = clean(stripped, ext)
        if not looked_at(group, stripped, cleaned, masked):
            continue
        text = {"raw": line, "stripped": stripped, "clean": cleaned}[group.text]
        for rule in group.rules:
            if rule.message and re.search(rule.pattern, text, re.IGNORECASE):
                key = rule.message if group.dedup == R.FIRST_PER_MESSAGE else (number, rule.message)
                if key not in seen:
                    seen.add(key)
                    out.append((number, rule.message, rule.severity))
                break
    return out


def undocumented(lines):
    """('F' or 'K', line, name) before de-duplication."""
    out, current, has_doc = [], None, False
    for i, raw in enumerate(lines):
        line = raw.strip()
        is_def, is_class = re.match(r"def\s+(\w+)\s*\(", line), re.match(r"class\s+(\w+)", line)
        if is_def:
            if current and not has_doc:
                out.append(("F", *current))
            current, has_doc = (i + 1, is_def.group(1)), False
        elif is_class:
            if not any(DQ in x or SQ in x for x in lines[i + 1:i + 4]):
                out.append(("K", i + 1, is_class.group(1)))
        elif current and (DQ in line or SQ in line):
            has_doc = True
    return out
