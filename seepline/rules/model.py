"""Shape of a detection rule: a row of data, evaluated by ``operators.detect``."""

from __future__ import annotations

from dataclasses import dataclass

SQL = "SQL_INJECTION"
CMD = "COMMAND_INJECTION"
CODE = "CODE_INJECTION"
DESER = "DESERIALIZATION"
SSTI = "SSTI"
NOSQL = "NOSQL_INJECTION"
LDAP = "LDAP_INJECTION"
XPATH = "XPATH_INJECTION"
XXE = "XXE"
AUTH = "AUTH_BYPASS"
INFO = "INFO_DISCLOSURE"
IDOR = "IDOR"
XSS = "XSS"
DOMXSS = "DOM_XSS"
RXSS = "REFLECTED_XSS"
REDIR = "OPEN_REDIRECT"
PROTO = "PROTOTYPE_POLLUTION"
DEP = "VULNERABLE_DEPENDENCY"


# The frame of a condition on the whole file; wider than any file has lines.
WHOLE = (-(10**9), 10**9)


@dataclass(frozen=True)
class Rule:
    """One detector row.

    ``pattern`` must match the line and ``unless`` must not. ``near`` must match some
    line of ``near_frame`` (offsets from the hit, inclusive) and ``absent`` must match
    none of ``absent_frame``; with the frame WHOLE they look at all lines of the file. ``label`` names the taint the line must carry: one or more
    of user/db/json/unser/table separated by commas, or None for a pure pattern.
    With a label, ``grade`` holds for tainted hits and ``plain`` for the others;
    ``plain=None`` drops them. Grades read ``SEVERITY/CONFIDENCE``.
    """

    rule_id: str
    category: str
    pattern: str
    message: str
    grade: str
    label: str | None = None
    plain: str | None = None
    unless: str | None = None
    near: str | None = None
    near_frame: tuple[int, int] = (0, 0)
    absent: str | None = None
    absent_frame: tuple[int, int] = (0, 0)
    priority: int = 0
    cwe: str | None = None
    hit: str | None = None
    miss: str | None = None
    lang: str = ""


def pack(lang: str, *rules: Rule) -> tuple[Rule, ...]:
    """Stamp a language on rules."""
    from dataclasses import replace

    return tuple(replace(r, lang=lang) for r in rules)


# Weakness number and advice by category.
REMEDIATION = {
    SQL: ("CWE-89", "Bind values as query parameters"),
    CMD: ("CWE-78", "Pass an argument list without a shell"),
    CODE: ("CWE-94", "Do not evaluate data as code"),
    DESER: ("CWE-502", "Use a data-only format or a type allow-list"),
    SSTI: ("CWE-1336", "Keep templates static and pass data as context"),
    NOSQL: ("CWE-943", "Coerce values and reject operator keys"),
    LDAP: ("CWE-90", "Escape filter values"),
    XPATH: ("CWE-643", "Bind XPath variables"),
    XXE: ("CWE-611", "Switch off external entities"),
    AUTH: ("CWE-287", "Enforce the check on the server"),
    INFO: ("CWE-200", "Do not expose internals"),
    IDOR: ("CWE-915", "Copy allowed fields into the entity"),
    XSS: ("CWE-79", "Encode output for its context"),
    DOMXSS: ("CWE-79", "Use textContent or a sanitizer"),
    RXSS: ("CWE-79", "Encode output for its context"),
    REDIR: ("CWE-601", "Check the target against an allow-list"),
    PROTO: ("CWE-1321", "Reject prototype keys"),
    DEP: ("CWE-1104", "Upgrade the dependency"),
}
