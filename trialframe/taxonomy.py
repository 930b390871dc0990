"""Categories, ordered rules and published figures: fixed values that results must equal."""

from __future__ import annotations

PRIMARIES = ("A", "B", "C")
STATES = ("A", "B", "C", "PASS")
#: Categories in order of priority.
CATEGORIES = ("A.1", "A.2", "A.3", "B.1", "B.2", "B.3", "B.4", "B.5", "C.1", "C.2", "C.3", "C.4")
UNMAPPED = "UNMAPPED"
#: Fixed values: (rule, signal pattern, message pattern, category, confidence); the first match decides.
RULES = (
    ("R01", r"no_code_output", None, "A.1", 0.99),
    ("R02", r"(syntax|collection|runtime):(IndentationError|TabError)", None, "A.2", 0.95),
    ("R03", r"(syntax|collection|runtime):SyntaxError", r"(?i)import \* only allowed at module level", "A.3", 0.95),
    ("R04", r"(syntax|collection|runtime):SyntaxError", r"(?i)was never closed|unterminated (triple-quoted )?string literal|unexpected EOF|EOF while scanning|expected ':'|missing ':'", "A.1", 0.9),
    ("R05", r"(collection|runtime):[A-Za-z_][A-Za-z0-9_]*:llm_defined", None, "B.5", 0.8),
    ("R06", r"(import|collection|runtime):ModuleNotFoundError(:[a-z_]+)?", None, "A.3", 0.95),
    ("R07", r"(import|collection|runtime):ImportError:external", None, "A.3", 0.9),
    ("R08", r"(collection|runtime):ImportError:candidate", None, "B.2", 0.9),
    ("R09", r"(collection|runtime):NameError:stdlib_unbound", None, "A.3", 0.9),
    ("R10", r"(collection|runtime):(NameError|UnboundLocalError)", None, "B.2", 0.9),
    ("R11", r"(collection|runtime):TypeError", r"takes (from \d+ to \d+|\d+|no) positional arguments? but \d+ (positional arguments? \(and \d+ keyword-only arguments?\) )?(were|was) given|takes (at most|at least|exactly) (\d+|one) (positional )?arguments? \(\d+ given\)|takes no arguments \(\d+ given\)|missing \d+ required (positional|keyword-only) arguments?|got an unexpected keyword argument|got multiple values for (keyword )?argument|expected (at most |at least )?\d+ (positional )?arguments?, got \d+", "B.4", 0.9),
    ("R12", r"(collection|runtime):TypeError", None, "B.1", 0.8),
    ("R13", r"(collection|runtime):AttributeError", None, "B.1", 0.85),
    ("R14", r"(collection|runtime):(IndexError|KeyError|ValueError|ZeroDivisionError|OverflowError)", None, "B.3", 0.85),
    ("R15", r"timeout", None, "B.5", 0.85),
    ("R16", r"(collection|runtime):RecursionError", None, "B.5", 0.85),
    ("R17", r"functional:format", None, "C.3", 0.8),
    ("R18", r"functional:(logic|unextractable)", None, "C.1", 0.7),
)
#: Libraries whose missing name is an import error.
LIBRARIES = ("math", "heapq", "sys", "os", "collections", "itertools", "re", "bisect", "functools", "copy", "json", "random", "string", "datetime", "typing", "queue", "operator", "hashlib", "time", "fractions", "decimal", "scipy", "numpy")
WEB_LIBRARIES = ("math", "sys", "os", "re", "json", "time", "datetime", "random", "collections", "itertools", "heapq", "bisect")
#: Published pass rates and the sizes they hold for.
TARGETS = (("humanevalplus", 93.3, 164), ("mbppplus", 81.2, 399), ("introductory", 87.5, 200), ("interview", 66.7, 200), ("competition", 55.0, 200), ("appsplus", 69.8, 600), ("overall", 71.2, 1163))
#: Published repair rates after one and two iterations.
REFERENCE_ROWS = (("Self-debug", 23.3, 27.5), ("Intervenor", 22.5, 28.3), ("Ours", 24.1, 29.2), ("w/o BT", 21.7, 27.5), ("Ours + Intervenor", 25.8, 29.2))
TECHNIQUES = ("syntax", "imports", "tests", "runtime")


def priority(category: str) -> int:
    return CATEGORIES.index(category) + 1 if category in CATEGORIES else len(CATEGORIES) + 1
