"""Word lists and patterns that decide the text features.

Fixed values: the lists below must equal the published feature definitions for
the counts to agree. Patterns use ``\\b``, ``\\w`` and ``\\d`` in their Unicode
sense; ``unicode_pattern`` spells that out for the JVM.
"""
from __future__ import annotations

import re

# --- fixed values: problem-statement domains -------------------------------
STATEMENT_DOMAINS = {
    "explicit_security": [
        r"\bsecurity\b", r"\bsecure\b", r"\bvulnerab\w*\b", r"\bcwe-\d+\b", r"\bowasp\b",
        r"\binjection\b", r"\bxss\b", r"\bsqli?\b", r"\bexploit\w*\b", r"\bunsafe\b",
    ],
    "auth": [
        r"\bauthentication\b", r"\bauthorization\b", r"\bauth\b", r"\blogin\b", r"\bsession\b",
        r"\btoken\b", r"\bjwt\b", r"\bcredential\w*\b", r"\bpassword\b",
    ],
    "input_validation": [
        r"\bvalidate\b", r"\bvalidation\b", r"\bsanitize\b", r"\bescape\b", r"\buser input\b",
        r"\buntrusted\b", r"\bparameter\b", r"\bpayload\b",
    ],
    "database": [
        r"\bdatabase\b", r"\bsql\b", r"\bquery\b", r"\borm\b", r"\bpostgres\w*\b", r"\bmysql\b",
        r"\bsqlite\b", r"\btransaction\b",
    ],
    "network_api": [
        r"\bapi\b", r"\bhttp\b", r"\bhttps\b", r"\brequest\b", r"\bresponse\b", r"\bendpoint\b",
        r"\bsocket\b", r"\bnetwork\b", r"\burl\b", r"\bwebhook\b",
    ],
    "filesystem": [
        r"\bfile\b", r"\bfilesystem\b", r"\bpath\b", r"\bdirectory\b", r"\bfolder\b", r"\btempfile\b",
    ],
    "command_exec": [
        r"\bshell\b", r"\bcommand\b", r"\bsubprocess\b", r"\bos\.system\b", r"\bexec\(", r"\beval\(",
        r"\bspawn\b", r"\bpopen\b",
    ],
    "crypto_secret": [
        r"\bcrypto\w*\b", r"\bencrypt\w*\b", r"\bdecrypt\w*\b", r"\bhash\b", r"\bsecret\b",
        r"\bprivate key\b", r"\bcertificate\b", r"\bssl\b", r"\btls\b",
    ],
    "dependency": [
        r"\bdependency\b", r"\bdependencies\b", r"\bpackage\b", r"\bimport\b", r"\brequirement\w*\b",
        r"\bversion\b",
    ],
    "serialization": [
        r"\bserializ\w*\b", r"\bdeserializ\w*\b", r"\bpickle\b", r"\byaml\b", r"\bjson\b", r"\bmarshal\b",
    ],
    "web_output": [
        r"\bhtml\b", r"\btemplate\b", r"\brender\b", r"\bjavascript\b", r"\bdom\b", r"\boutput\b",
    ],
    "permissions": [
        r"\bpermission\b", r"\bprivilege\b", r"\baccess control\b", r"\brole\b", r"\bowner\b", r"\badmin\b",
    ],
    "concurrency": [
        r"\bthread\b", r"\basync\b", r"\bawait\b", r"\brace condition\b", r"\block\b", r"\bconcurrent\b",
    ],
    "error_handling": [
        r"\bexception\b", r"\btraceback\b", r"\berror handling\b", r"\btry\b", r"\bexcept\b",
        r"\braise\b", r"\bfailure\b",
    ],
}

# --- fixed values: prompt-envelope domains where they differ ---------------
ENVELOPE_DOMAINS = {
    "security": [
        r"\bsecurity\b", r"\bsecure\b", r"\bvulnerab", r"\bcwe-\d+\b", r"\bowasp\b", r"\binjection\b",
        r"\bxss\b", r"\bsqli?\b", r"\bexploit", r"\bunsafe\b",
    ],
    "auth": [
        r"\bauthentication\b", r"\bauthorization\b", r"\bauth\b", r"\blogin\b", r"\bsession\b",
        r"\btoken\b", r"\bjwt\b", r"\bcredential", r"\bpassword\b", r"\bpermission",
    ],
    "input_validation": [
        r"\bvalidate\b", r"\bvalidation\b", r"\bsanitize\b", r"\bescape\b", r"\buser input\b",
        r"\buntrusted\b", r"\bparameter\b", r"\brequest data\b", r"\bpayload\b",
    ],
    "database": STATEMENT_DOMAINS["database"],
    "network_api": STATEMENT_DOMAINS["network_api"],
    "filesystem": [
        r"\bfile\b", r"\bfilesystem\b", r"\bpath\b", r"\bdirectory\b", r"\bfolder\b", r"\bread\b",
        r"\bwrite\b", r"\bopen\(", r"\btempfile\b",
    ],
    "command_exec": STATEMENT_DOMAINS["command_exec"],
    "crypto_secret": [
        r"\bcrypto", r"\bencrypt", r"\bdecrypt", r"\bhash\b", r"\bsecret\b", r"\bprivate key\b",
        r"\bcertificate\b", r"\bssl\b", r"\btls\b", r"\bkey\b",
    ],
    "dependency": STATEMENT_DOMAINS["dependency"],
    "serialization": STATEMENT_DOMAINS["serialization"],
    "web_output": [
        r"\bhtml\b", r"\btemplate\b", r"\brender\b", r"\bresponse\b", r"\bjavascript\b", r"\bdom\b",
        r"\boutput\b",
    ],
    "permissions": STATEMENT_DOMAINS["permissions"],
    "concurrency": STATEMENT_DOMAINS["concurrency"],
    "error_handling": STATEMENT_DOMAINS["error_handling"],
}

# --- fixed values: constraints, modals, negations, imperatives -------------
CONSTRAINTS = [
    r"\bmust\b", r"\bshould\b", r"\brequired\b", r"\brequirement\b", r"\bpreserve\b", r"\bmaintain\b",
    r"\bcompatible\b", r"\bdo not\b", r"\bdon't\b", r"\bwithout\b", r"\bonly\b", r"\bavoid\b", r"\bnever\b",
]
ENVELOPE_CONSTRAINTS = CONSTRAINTS + [r"\bno new\b"]
NEGATIONS = [
    r"\bdo not\b", r"\bdon't\b", r"\bmust not\b", r"\bshould not\b", r"\bnever\b", r"\bwithout\b",
    r"\bavoid\b", r"\bno new\b",
]
MODALS = [
    r"\bmust\b", r"\bshould\b", r"\bshall\b", r"\bneed(?:s|ed)? to\b", r"\brequired to\b",
    r"\bexpected to\b",
]
IMPERATIVES = [
    "fix", "generate", "preserve", "maintain", "return", "implement", "update", "change", "remove",
    "add", "ensure", "avoid", "use", "handle", "support", "validate", "prevent", "make",
]
# The domains whose terms make up the envelope's security term count.
ENVELOPE_SECURITY_TERMS = ["security", "auth", "input_validation", "command_exec", "crypto_secret"]

# --- fixed values: guideline terms, file endings, stop words ----------------
GUIDELINE_TERMS = [
    "[security-guidelines]", "owasp", "secure", "deny-list", "allow-list", "parameterized", "no eval",
    "shell=true",
]
FILE_ENDINGS = "py|js|ts|java|go|rb|php|cs|cpp|c|h|json|yaml|yml|toml|ini|cfg|md"

# --- Unicode classes in a form the JVM and RE2 both read --------------------
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def unicode_pattern(pattern: str) -> str:
    """The pattern with word edges, word and digit classes made explicit."""
    body, head, tail = pattern, "", ""
    if body.startswith(r"\b"):
        body, head = body[2:], rf"(?<!{WORD})"
    if body.endswith(r"\b"):
        body, tail = body[:-2], rf"(?!{WORD})"
    body = body.replace(r"\w", WORD).replace(r"\d", r"\p{Nd}")
    return head + body + tail


def single_token(pattern: str) -> str | None:
    """The body of a pattern that can only match one whole word, else None."""
    body = pattern[2:]
    if body.endswith(r"\b"):
        body = body[:-2]
    elif re.fullmatch(r"[a-z]+", body):
        body += r"\w*"
    else:
        return None
    if re.fullmatch(r"[a-z?]+(?:\\w\*)?", body):
        return body.replace(r"\w", WORD)
    return None


STEM = 5


def token_filter(patterns) -> tuple[list[str], list[str]]:
    """Whole words, and five-letter beginnings of open-ended words, to look for.

    The beginnings only narrow the tokens down; the patterns decide afterwards.
    """
    words, stems = set(), set()
    for body in filter(None, map(single_token, patterns)):
        if body.endswith("*"):
            stems.add(body[: -len(WORD) - 1][:STEM])
        elif "?" in body:
            words.update((body.replace("?", ""), re.sub(r".\?", "", body)))
        else:
            words.add(body)
    return sorted(words), sorted(stems)


def plain_part(pattern: str) -> str:
    """A literal that every match of a several-word pattern contains."""
    body = pattern.replace(r"\b", "").replace(r"\.", ".").replace(r"\(", "(")
    return re.split(r"\(\?:|\\d|\?", body)[0]
