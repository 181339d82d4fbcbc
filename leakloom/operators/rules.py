"""The built-in rules as data, and how their matches are validated: one SQL expression per rule, none in Python."""

from __future__ import annotations

import re
from dataclasses import dataclass

from leakloom.functions import constants
from leakloom.functions.sqltext import basename, literal, one_of

# What the rules match. The quoted bodies are unrolled and possessive, so that long lines cannot overflow the stack.
VALUE = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`|\$\{[^{}\r\n]*\}|[^\s"'`,;}\]]+)"""
ENVIRONMENT = r"process\.env\.[A-Za-z0-9_]+"
EXPRESSION = r"[^,;\r\n]+?"
PASSWORD = "password|passwd|pwd"
API_KEY = r"api[_\-\s]*key"
AWS_SECRET = "(?:AWS|AMAZON)_?SECRET_?(?:ACCESS_?)?KEY"
PLACEHOLDERS = "your_password_here your_api_key_here your_secret_here your_token_here your_github_token_here <password> <api_key> <secret> <token>"
REFERENCE = r"^(?:\$\{[A-Za-z_][A-Za-z0-9_]*\}|\$\{\{\s*(?:secrets|env|vars)(?:\.[A-Za-z_][A-Za-z0-9_]*)+\s*\}\}|\$[A-Za-z_][A-Za-z0-9_]*|process\.env\.[A-Za-z_][A-Za-z0-9_]*|var\.[A-Za-z_][A-Za-z0-9_]*|os\.(?:environ\[.*\]|(?:getenv|environ\.get)\([^,]*\)))$"


def assignment(key: str, signs: str) -> str:
    return rf"""(?i)({key})["'`]?\s*(?:{signs})\s*{VALUE}"""


def fallback(key: str, source: str) -> str:
    return rf"""(?i)({key})["'`]?\s*(?::|=)\s*(?:{source})\s*(?:\|\||\?\?)\s*{VALUE}"""


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    severity: str = "High"
    #: token: whole match between non-word characters; keyed: group 1 is a key, group 2 the value; plain: whole match; netrc: group 1 is the value.
    kind: str = "keyed"
    #: What the value must be, in SQL over `value`.
    check: str = "octet_length(value) >= 8"
    #: Texts, in lower case, one of which a line must hold.
    needs: tuple[str, ...] = ()
    #: More such sets: a line must hold one text of each.
    also: tuple[tuple[str, ...], ...] = ()
    builtin: bool = True

    @property
    def plain_start(self) -> bool:
        """Whether the pattern looks at nothing but what it matches: then the first match is the first place of its text."""
        return self.builtin and self.kind != "netrc"

    @property
    def groups(self) -> tuple[int, int | None]:
        return {"keyed": (2, 1), "netrc": (1, None), "group": (2, None)}.get(self.kind, (0, None))


def own(name: str, pattern: str, severity: str = "Medium", needs: tuple[str, ...] = ()) -> Rule:
    """A rule with a pattern of one's own: what its group captures is reported, without a group the whole match.

    The group must be the only one and stand at the top level, so that what is before it in the match can be captured too; `(?P<name>...)` is
    taken as a group, `(?:...)` is none."""
    pattern = pattern.replace("(?P<", "(?<")
    opens, depth, at, flags = [], 0, 0, re.match(r"\(\?[A-Za-z]+\)", pattern)
    start = flags.end() if flags else 0
    at, top_bar, in_class = start, False, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            at += pattern[at + 1 : at + 3] == "^]" and 2 or pattern[at + 1 : at + 2] == "]"
        elif c == "(":
            if pattern[at + 1 : at + 2] != "?" or re.match(r"\(\?<[A-Za-z]", pattern[at:]):
                opens.append((at, depth))
            depth += 1
        elif c == ")":
            depth -= 1
            if opens and depth == opens[0][1] and len(opens[0]) == 2:
                opens[0] = (*opens[0], at)
        elif c == "|" and depth == 0:
            top_bar = True
        at += 1
    low = tuple(x.lower() for x in needs)
    if not opens:
        return Rule(name, pattern, severity, "plain", "true", low, builtin=False)
    if len(opens) > 1 or opens[0][1] != 0 or top_bar:
        raise ValueError(f"{name}: one group at most, not inside another or beside a bar")
    a, _, b = opens[0]
    return Rule(name, f"{pattern[:start]}({pattern[start:a]}){pattern[a : b + 1]}{pattern[b + 1 :]}", severity, "group", "true", low, builtin=False)


URL_PASSWORD = "regexp_extract(value, '://[^@]*?:([^@]*)@', 1)"
_SECRET40 = r"value RLIKE '^[A-Za-z0-9/+=]{40}$'"
_KEY20 = r"value RLIKE '^A[KS]IA[A-Z0-9]{16}$'"
_ALL = ":=|=>|=|:"
_SIGN = (":", "=")
_OR = ("||", "??")
_AWS = ("akia", "asia")
# what all texts of a set have in common comes first: one look for it tells most lines
_IA = ("ia",)
_W = ("w",)

BUILTIN = (
    Rule("AWS Access Key", "(?:AKIA|ASIA)[A-Z0-9]{16}", "Critical", "token", "true", needs=_AWS, also=(_IA,)),
    Rule("AWS Secret Key", assignment(AWS_SECRET, _ALL), "Critical", check=_SECRET40, needs=("secret",), also=(_SIGN, ("key",), ("aws", "amazon"))),
    Rule("AWS Key in Object", assignment("key", ":"), "Critical", check=_KEY20, needs=_AWS, also=(_IA, (":",), ("key",))),
    Rule("AWS Secret in Object", assignment("secret", ":"), check=_SECRET40, needs=("secret",), also=(_SIGN, (":",))),
    Rule("AWS Direct Key Assignment", fallback("key", ENVIRONMENT), "Critical", check=_KEY20, needs=_OR, also=(_SIGN, ("process.env",), ("key",), _AWS)),
    Rule("AWS Direct Secret Assignment", fallback("secret", ENVIRONMENT), check=_SECRET40, needs=_OR, also=(_SIGN, ("process.env",), ("secret",))),
    Rule("AWS Access Key with Fallback", fallback("key", EXPRESSION), "Critical", check=_KEY20, needs=_OR, also=(_SIGN, ("key",), _AWS)),
    Rule("AWS Secret with Fallback", fallback("secret", EXPRESSION), check=_SECRET40, needs=_OR, also=(_SIGN, ("secret",))),
    Rule("Password with Fallback", fallback(PASSWORD, EXPRESSION), needs=_OR, also=(_SIGN, _W, ("password", "passwd", "pwd"))),
    Rule("Generic Fallback Secret", fallback(rf"secret|token|credential|{API_KEY}", ENVIRONMENT), needs=_OR, also=(_SIGN, ("process.env",))),
    Rule("GitHub Token", "gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}", "Critical", "token", "true", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), (("_",),)),
    Rule("Stripe Secret Key", "(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{24,}", "Critical", "token", "true", ("sk_", "rk_"), (("_",),)),
    Rule("npm Access Token", "npm_[A-Za-z0-9]{36}", "Critical", "token", "true", ("npm_",), (("_",),)),
    Rule("Generic API Key", assignment(API_KEY, _ALL), check=r"value RLIKE '^[A-Za-z0-9_+/=.-]{32,}$' AND replace(value, left(value, 1), '') <> ''", needs=("api",), also=(_SIGN, ("key",))),
    Rule("Private Key", "-----BEGIN (?:RSA |DSA |EC |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", "Critical", "plain", "true", ("-----begin",)),
    Rule("Password Assignment", assignment(PASSWORD, ":=|=>|="), needs=("password", "passwd", "pwd"), also=(_W, ("=",))),
    Rule("Password in Object", assignment(PASSWORD, ":"), needs=("password", "passwd", "pwd"), also=(_W, (":",))),
    Rule("Netrc Password", rf"(?i)\bpassword\s+{VALUE}", kind="netrc", check=f"value <> '' AND {basename('path')} = '.netrc'", needs=("password",)),
    Rule(
        "Database Connection String",
        r"""(?i)(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql)://[^\s<>/:'"`]+:[^\s<>@'"`]+@[^\s<>'"`]+""",
        "Critical",
        "plain",
        f"NOT ({URL_PASSWORD} RLIKE {literal(REFERENCE)} OR {one_of(f'lower({URL_PASSWORD})', PLACEHOLDERS)})",
        ("://",),
        (("@",), _SIGN),
    ),
    Rule("JWT Token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "High", "token", "true", ("eyj",), ((".",),)),
)


def unquoted(value: str) -> str:
    """The value without one pair of equal quotes around it."""
    return f"CASE WHEN {value} RLIKE {literal(QUOTED)} THEN substring({value}, 2, length({value}) - 2) ELSE {value} END"


QUOTED = r"""(?s)^(?:".*"|'.*'|`.*`)$"""
SHELL_DEFAULT = r"(?s)^\$\{[A-Za-z_][A-Za-z0-9_]*(?::-|:=|-|=)(.*)\}$"


def valid(rules: tuple[Rule, ...]) -> str:
    """Over rule_no, before, after, key, value, quoted, extension and path: whether a match is a finding. Rejected matches have used up their text all the
    same. What rules of a kind have in common is said once, so that the compiled code stays small."""
    word = "[A-Za-z0-9_]"
    edge = r"(right(before, 1) = '' OR NOT right(before, 1) RLIKE '[\\p{IsAlphabetic}\\p{N}]' OR (right(before, 1) RLIKE '[a-z]' AND key RLIKE '^[A-Z]'))"
    parts = [
        rf"NOT before RLIKE {literal(r'\$\{[A-Za-z0-9_]*$')}",
        f"NOT value RLIKE {literal(REFERENCE)}",
        f"NOT {one_of('lower(value)', PLACEHOLDERS)}",
        "NOT value RLIKE '^pk_(?:live|test)_[A-Za-z0-9]{24,}$'",
        f"(quoted OR NOT {one_of('extension', constants.QUOTED_ONLY)})",
        rf"(quoted OR NOT value RLIKE {literal(r'[(\[{]|^(?:process\.env|config|settings|secrets|this|self)\.')})",
    ]

    def of(*kinds: str) -> str:
        return "rule_no IN (" + ", ".join([*(str(no) for no, r in enumerate(rules) if r.builtin and r.kind in kinds), "-1"]) + ")"

    checks: dict[str, list[int]] = {}
    for no, rule in enumerate(rules):
        checks.setdefault(rule.check, []).append(no)
    own = " ".join(f"WHEN rule_no IN ({', '.join(map(str, nos))}) THEN {check}" for check, nos in checks.items())
    tests = [f"(NOT {of('token')} OR (NOT right(before, 1) RLIKE '{word}' AND NOT after RLIKE '{word}'))", f"(NOT {of('keyed')} OR {edge})", *(f"(NOT {of('keyed', 'netrc')} OR {x})" for x in parts), f"CASE {own} END"]
    return " AND ".join(tests)
