"""Task rows to cases, and the rule dimension."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.diffs import touched_files
from ..functions.paths import repo_short_name
from ..functions.text import lines, strip_blanks


def prepare_cases(rows: DataFrame) -> DataFrame:
    """Validated cases; ``reject_reason`` is null for the good ones.

    The first missing field among id, repo, commit and statement is the reason.
    """

    def clean(c):
        return strip_blanks(F.coalesce(F.col(c), F.lit("")))

    ident, repo = clean("instance_id"), clean("repo")
    commit, statement = clean("base_commit"), clean("problem_statement")
    reason = (
        F.when(ident == "", "instance_id")
        .when(repo == "", "repo")
        .when(commit == "", "base_commit")
        .when(statement == "", "problem_statement")
    )
    first = F.get(lines(statement), F.lit(0))
    title = F.when(F.length(first) > 120, F.concat(F.substring(first, 1, 120), F.lit("…"))).otherwise(first)
    tests = F.when(F.coalesce("FAIL_TO_PASS", F.lit("")) != "", F.col("FAIL_TO_PASS")).otherwise(
        F.col("PASS_TO_PASS")
    )
    # A JSON list of tests becomes one test per line; other text stays as it is.
    listed = F.from_json(tests, "array<string>")
    files = F.filter(touched_files("patch"), lambda p: p != "dev/null")
    out = rows.withColumn("gold_changed_files", files)
    return out.select(
        reason.alias("reject_reason"),
        ident.alias("case_id"),
        repo.alias("repo_full_name"),
        repo_short_name(repo).alias("repo_short_name"),
        commit.alias("base_commit"),
        F.coalesce(title, F.lit("")).alias("issue_title"),
        statement.alias("problem_statement"),
        F.concat_ws("\n", "gold_changed_files").alias("short_file_list"),
        F.coalesce(
            F.when(listed.isNotNull() & F.startswith(F.btrim(tests), F.lit("[")), F.concat_ws("\n", listed)),
            tests, F.lit(""),
        ).alias("test_query"),
        F.size("gold_changed_files").cast("long").alias("gold_files_count"),
    )


# Rule id to category.
RULE_CWE: Mapping[str, str] = {
    "B101": "CWE-78", "B102": "CWE-78", "B103": "CWE-78", "B104": "CWE-78",
    "B105": "CWE-798", "B106": "CWE-798", "B107": "CWE-798", "B108": "CWE-377",
    "B109": "CWE-798", "B110": "CWE-703", "B112": "CWE-703", "B113": "CWE-400",
    "B201": "CWE-489", "B202": "CWE-22", "B301": "CWE-502", "B302": "CWE-327",
    "B303": "CWE-327", "B304": "CWE-327", "B305": "CWE-327", "B306": "CWE-327",
    "B307": "CWE-78", "B308": "CWE-20", "B309": "CWE-327", "B310": "CWE-330",
    "B311": "CWE-330", "B312": "CWE-209", "B313": "CWE-611", "B314": "CWE-611",
    "B315": "CWE-611", "B316": "CWE-611", "B317": "CWE-611", "B318": "CWE-611",
    "B319": "CWE-611", "B320": "CWE-611", "B321": "CWE-377", "B322": "CWE-20",
    "B323": "CWE-327", "B324": "CWE-327", "B325": "CWE-377", "B401": "CWE-319",
    "B402": "CWE-377", "B403": "CWE-502", "B404": "CWE-78", "B405": "CWE-611",
    "B406": "CWE-611", "B407": "CWE-611", "B408": "CWE-611", "B409": "CWE-611",
    "B410": "CWE-611", "B411": "CWE-330", "B412": "CWE-209", "B413": "CWE-20",
    "B501": "CWE-295", "B502": "CWE-326", "B503": "CWE-326", "B504": "CWE-326",
    "B505": "CWE-326", "B506": "CWE-502", "B507": "CWE-295", "B508": "CWE-319",
    "B509": "CWE-319", "B601": "CWE-78", "B602": "CWE-78", "B603": "CWE-78",
    "B604": "CWE-78", "B605": "CWE-78", "B606": "CWE-78", "B607": "CWE-78",
    "B608": "CWE-89", "B609": "CWE-78", "B610": "CWE-20", "B611": "CWE-20",
    "B612": "CWE-209", "B613": "CWE-176", "B701": "CWE-79", "B702": "CWE-79",
    "B703": "CWE-79", "B801": "CWE-327", "B901": "CWE-78", "B902": "CWE-78",
    "B903": "CWE-78",
}

# Category descriptions.
CWE_TEXT: Mapping[str, str] = {
    "CWE-20": "Improper Input Validation (OWASP A03:2021)",
    "CWE-22": "Path Traversal (OWASP A01:2021)",
    "CWE-78": "OS Command Injection (OWASP A03:2021)",
    "CWE-79": "Cross-site Scripting (OWASP A03:2021)",
    "CWE-89": "SQL Injection (OWASP A03:2021)",
    "CWE-94": "Code Injection (OWASP A03:2021)",
    "CWE-113": "HTTP Response Splitting",
    "CWE-116": "Improper Encoding or Escaping of Output",
    "CWE-134": "Use of Externally-Controlled Format String",
    "CWE-176": "Improper Handling of Unicode Encoding",
    "CWE-184": "Incomplete List of Disallowed Inputs",
    "CWE-190": "Integer Overflow or Wraparound",
    "CWE-200": "Information Exposure (OWASP A01:2021)",
    "CWE-208": "Observable Timing Discrepancy",
    "CWE-209": "Information Exposure Through Error Messages",
    "CWE-215": "Information Exposure Through Debug Information",
    "CWE-250": "Execution with Unnecessary Privileges",
    "CWE-269": "Improper Privilege Management (OWASP A01:2021)",
    "CWE-276": "Incorrect Default Permissions (OWASP A05:2021)",
    "CWE-284": "Improper Access Control",
    "CWE-287": "Improper Authentication (OWASP A07:2021)",
    "CWE-295": "Improper Certificate Validation (OWASP A02:2021)",
    "CWE-311": "Missing Encryption of Sensitive Data",
    "CWE-312": "Cleartext Storage of Sensitive Information",
    "CWE-319": "Cleartext Transmission (OWASP A02:2021)",
    "CWE-326": "Inadequate Encryption Strength (OWASP A02:2021)",
    "CWE-327": "Broken/Risky Cryptographic Algorithm (OWASP A02:2021)",
    "CWE-330": "Use of Insufficiently Random Values (OWASP A02:2021)",
    "CWE-346": "Origin Validation Error",
    "CWE-352": "Cross-Site Request Forgery (OWASP A01:2021)",
    "CWE-377": "Insecure Temporary File",
    "CWE-400": "Uncontrolled Resource Consumption",
    "CWE-426": "Untrusted Search Path",
    "CWE-434": "Unrestricted Upload of File with Dangerous Type",
    "CWE-451": "User Interface (UI) Misrepresentation of Critical Information",
    "CWE-476": "NULL Pointer Dereference",
    "CWE-489": "Active Debug Code (OWASP A05:2021)",
    "CWE-502": "Deserialization of Untrusted Data (OWASP A08:2021)",
    "CWE-522": "Insufficiently Protected Credentials (OWASP A07:2021)",
    "CWE-532": "Insertion of Sensitive Information into Log File",
    "CWE-601": "URL Redirection to Untrusted Site",
    "CWE-611": "XML External Entity Reference (OWASP A05:2021)",
    "CWE-614": "Sensitive Cookie Without Secure Flag (OWASP A05:2021)",
    "CWE-643": "Improper Neutralization of Data within XPath Expressions",
    "CWE-703": "Improper Check/Handling of Exceptional Conditions",
    "CWE-732": "Incorrect Permission Assignment (OWASP A05:2021)",
    "CWE-776": "XML Entity Expansion",
    "CWE-798": "Hard-coded Credentials (OWASP A07:2021)",
    "CWE-829": "Inclusion of Functionality from Untrusted Control Sphere",
    "CWE-918": "Server-Side Request Forgery (OWASP A10:2021)",
    "CWE-943": "Improper Neutralization of Special Elements in Data Query Logic",
}


def rule_dimension(
    findings: DataFrame,
    rules: Mapping[str, str] = RULE_CWE,
    texts: Mapping[str, str] = CWE_TEXT,
    rule: str = "test_id",
    reported: str = "cwe",
) -> DataFrame:
    """Category of the rule (else the reported one) and its description.

    The dimension is a constant of a few dozen entries and lives in the plan as
    a literal map, so no join is needed.
    """

    def table(d):
        return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])

    mapped = F.coalesce(F.try_element_at(table(rules), F.col(rule)), F.col(reported))
    out = findings.withColumn("rule_cwe", mapped)
    return out.withColumn("cwe_description", F.try_element_at(table(texts), F.col("rule_cwe")))
