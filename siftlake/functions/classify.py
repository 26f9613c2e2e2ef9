"""Ordered keyword cascades over finding texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftlake.functions.text import contains_any, safe_filename, sql_text


def cascade(branches, default) -> Column:
    """The value of the first branch whose test holds."""
    chain = None
    for test, value in branches:
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(default)


# ---------------------------------------------------------------------------
# Fix suggestions, tried in order.  The first entry of a row lists
# word groups; a row applies when each group has a word in the issue text.
# ---------------------------------------------------------------------------
FIXES = [
    ([["hardcoded password"]],
     "Use environment variables", 'password = os.getenv("PASSWORD")',
     "Store secrets in .env file, not in code"),
    ([["hardcoded"], ["api", "key", "secret"]],
     "Use environment variables", 'api_key = os.getenv("API_KEY")',
     "Keep secrets in environment variables"),
    ([["eval", "exec"]],
     "Avoid eval()/exec(), use safe alternatives",
     "import ast\nresult = ast.literal_eval(safe_input)",
     "Never use eval()/exec() with user input"),
    ([["sql injection"]],
     "Use parameterized queries",
     'cursor.execute("SELECT * FROM users WHERE id = ?", (user_id,))',
     "Always use parameterized queries"),
    ([["snake_case"]],
     "Use snake_case for function names",
     "def my_function_name():  # Good\n# def myFunctionName():  # Bad",
     "Python functions should use snake_case naming"),
    ([["pascalcase"]],
     "Use PascalCase for class names",
     "class MyClassName:  # Good\n# class myClassName:  # Bad",
     "Python classes should use PascalCase naming"),
    ([["todo", "fixme"]],
     "Complete or remove TODO/FIXME items",
     "# Implement the required functionality\n# or remove if not needed",
     "Address all TODO/FIXME comments before deployment"),
    ([["docstring"]],
     "Add a docstring to explain functionality",
     'def function():\n    """Description of what this function does."""\n    pass',
     "Docstrings improve code readability and maintainability"),
    ([["unused"], ["import"]],
     "Remove unused imports", "# Remove the unused import statement",
     "Unused imports clutter code and can slow down startup"),
    ([["unused"], ["variable"]],
     "Remove unused variables", "# Remove the unused variable or prefix with _",
     "Unused variables indicate dead code or bugs"),
    ([["too long"]],
     "Refactor into smaller functions/classes",
     "# Break down large functions/classes into smaller components",
     "Large functions/classes are hard to test and maintain"),
    ([["broad exception", "except:"]],
     "Catch specific exceptions",
     "try:\n    ...\nexcept ValueError:\n    # Handle specific error",
     "Catching all exceptions masks bugs"),
    ([["print", "console.log"]],
     "Use a logger instead of print statements",
     'import logging\nlogging.info("Message")',
     "Logging provides better control and output formatting"),
]
RENAME_FIX = ("Rename file to remove spaces and accents", "# Rename: ", " -> ",
              "Files with spaces/accents break on Linux and CI systems")
OTHER_FIX = ("Fix: ", "# Review and fix the reported issue\n# Ensure code follows project standards",
             "Address the reported issue: ")
NO_ISSUE_TEXT = ("Address this issue", "Quality improvement needed")

SECURITY_AREAS = [
    ("injection", ["injection", "sql", "xss", "eval", "exec"]),
    ("authentication", ["password", "auth", "credential"]),
    ("encryption", ["ssl", "tls", "crypto", "hash"]),
    ("configuration", ["config", "debug", "verify"]),
]
QUALITY_AREAS = [
    ("naming", ["name", "snake_case", "pascalcase"]),
    ("complexity", ["complex", "long", "nested"]),
    ("maintainability", ["todo", "fixme", "debug"]),
    ("performance", ["performance", "inefficient", "slow"]),
]
OTHER_AREA = "other"

# A line of a model's prose is a finding when it has one of these words.
PROSE_WORDS = [
    "security", "vulnerability", "issue", "problem", "performance", "practice",
    "maintainability", "documentation", "accessibility", "testability", "aria", "coupling",
    "docstring", "dead", "duplicate", "unused", "naming", "readability", "parameters", "class",
    "method", "complexity", "nested", "long", "magic", "hard-coded", "architectural", "global",
    "loop", "query", "memory", "n+1", "null", "exception", "leak", "unreachable", "pointer",
    "comparison", "boolean", "race", "off-by-one", "api", "dependency", "cve", "vulnerable",
    "outdated", "package", "library", "transitive",
]
# ... and the first of these rows with a word in the line names its type and severity.
PROSE_CLASSES = [
    (["security", "vulnerability"], "security", "HIGH"),
    (["cve", "vulnerable", "outdated", "dependency", "package", "library", "transitive"],
     "security", "HIGH"),
    (["performance", "slow", "loop", "query", "memory", "n+1"], "performance", "MEDIUM"),
    (["reliability", "null", "exception", "leak", "unreachable", "pointer"], "quality", "HIGH"),
    (["comparison", "boolean", "race", "off-by-one", "misused api"], "quality", "HIGH"),
    (["practice", "convention"], "best_practice", "LOW"),
    (["maintainability", "complexity", "nested", "long", "magic", "hard-coded", "architectural",
      "global"], "maintainability", "LOW"),
    (["documentation", "docstring", "comment"], "documentation", "LOW"),
    (["accessibility", "aria", "alt text", "contrast"], "accessibility", "MEDIUM"),
    (["testability", "coupling", "dependency", "hard to test"], "testability", "MEDIUM"),
]
PROSE_OTHER = ("quality", "MEDIUM")


def minimal_fix(issue: Column, path: Column) -> Column:
    """Suggestion, code and explanation for a finding."""
    low = F.lower(F.coalesce(issue, F.lit("")))
    path = F.coalesce(path, F.lit(""))
    names = ("suggestion", "minimal_code", "explanation")

    def fixed(*texts):
        fields = ", ".join(f"'{n}', {sql_text(t)}" for n, t in zip(names, texts))
        return F.expr(f"named_struct({fields})")

    def built(*columns):
        return F.struct(*[c.alias(n) for n, c in zip(names, columns)])

    title, rename, arrow, why = RENAME_FIX
    branches = [(
        low.contains("filename") & contains_any(low, ["space", "accent"]),
        built(F.lit(title), F.concat(F.lit(rename), path, F.lit(arrow), safe_filename(path)),
              F.lit(why)),
    )]
    for groups, *texts in FIXES:
        test = contains_any(low, groups[0])
        for words in groups[1:]:
            test = test & contains_any(low, words)
        branches.append((test, fixed(*texts)))
    prefix, code, why = OTHER_FIX
    no_suggestion, no_why = NO_ISSUE_TEXT
    default = built(F.concat(F.lit(prefix), F.coalesce(issue, F.lit(no_suggestion))), F.lit(code),
                    F.concat(F.lit(why), F.coalesce(issue, F.lit(no_why))))
    return cascade(branches, default)


def _area(issue: Column, areas) -> Column:
    low = F.lower(F.coalesce(issue, F.lit("")))
    return cascade([(contains_any(low, words), F.lit(name)) for name, words in areas],
                   F.lit(OTHER_AREA))


def security_area(issue: Column) -> Column:
    """B11."""
    return _area(issue, SECURITY_AREAS)


def quality_area(issue: Column) -> Column:
    """B12."""
    return _area(issue, QUALITY_AREAS)


def prose_is_finding(line: Column) -> Column:
    return contains_any(F.lower(line), PROSE_WORDS)


def prose_class(line: Column) -> Column:
    """Struct of type and severity for a line of prose."""
    low = F.lower(line)

    def pair(kind, severity):
        return F.expr(f"named_struct('type', '{kind}', 'severity', '{severity}')")

    return cascade([(contains_any(low, words), pair(kind, sev)) for words, kind, sev in PROSE_CLASSES],
                   pair(*PROSE_OTHER))
