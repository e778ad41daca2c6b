"""Captures at rule paths, derived from the documents.

Each document's number picks a rule path and a body form: a planted head with the
whole document text behind it, so that every branch of every validator occurs.
Some branches need a body that is only the head (very short, or a bare hash). Such
a form gives two captures: the head alone, and under one of fifty further domains the head
with the whole text, inside a string field if the head is a JSON object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.rules import PATH_RULES
from tidewatch.workload.inputs import table

HTML = "<!DOCTYPE html><html><head></head><body>page</body></html>"
_HEX = "0123456789abcdef0123456789abcdef01234567"
_KEY = "PRIVATE KEY"

# validator → (head, True: text behind it; False: the head alone and a second capture with the text)
FORMS: dict[str, tuple[tuple[str, bool], ...]] = {
    "env": (
        ("APP=1\nDB_PASSWORD=hunter2\n", True),
        ("AAA=1\nBBB=2\nCCC=3\n", True),
        ("ONE=1\n# a single pair\n", False),
        ("DB_PASSWORD=changeme\n# sample\n", False),
        ("", True),
        (HTML, False),
    ),
    "git": (
        ("ref: refs/heads/main\n", False),
        ("ref: refs/heads/main\n", True),
        (_HEX + "\n", False),
        (_HEX + " 0 commit\n", True),
        ("[core]\n\tbare = false\n", True),
        ("Fix the importer", False),
        ("", True),
    ),
    "key": (
        (f"-----BEGIN RSA {_KEY}-----\n", True),
        (f"-----BEGIN OPENSSH {_KEY}-----\n", True),
        (f"-----BEGIN EC {_KEY}-----\n", True),
        (f"-----BEGIN {_KEY}-----\n", True),
        (f"-----BEGIN PGP {_KEY} BLOCK-----\n", True),
        (f"-----BEGIN DSA {_KEY}-----\n", True),
        ("", True),
    ),
    "sql": (
        ("create table  users (id int);\n", True),
        ("INSERT INTO users VALUES (1);\n", True),
        ("-- MySQL dump 10.13\n", True),
        ("-- PostgreSQL database dump\n", True),
        ("# made by mysqldump\n", True),
        ("-- Dump completed on 2025\n", True),
        ("-- Dumped from database version 15\n", True),
        ("", True),
        (HTML, True),
    ),
    "config": (
        ("define( 'DB_PASSWORD', 'x' );\n", True),
        ("$table_prefix = 'wp_';\n", True),
        ("$db_password = 'x';\n", True),
        ("password: hunter2\n", True),
        ("<connectionStrings></connectionStrings>\n", True),
        ('<add password="x"/>\n', True),
        ("admin:$apr1$abc\n", True),
        ("user:abcdefghijklmn\n", True),
        ("datasource.password=x\n", True),
        ("SECRET_KEY = 'abc'\n", True),
        ("'PASSWORD': 'abc'\n", True),
        ('{"Password": "abcd"}', False),
        ("", True),
    ),
    "phpinfo": (
        ('<table><tr><td>PHP Version </td><td class="v">8.1.2</td></tr></table>\n', True),
        ("PHP Version <table", True),
        ("call phpinfo() here\n", True),
        ("", True),
    ),
    "admin": (
        ("phpMyAdmin select database\n", True),
        ("phpMyAdmin server=1\n", True),
        ("Adminer server list\n", True),
        ('Adminer server <input type="password">\n', True),
        ("", True),
    ),
    "log": (
        ("[error] something\n", True),
        ("PHP Fatal error: x\n", True),
        ("Traceback (most recent call last)\n", True),
        ("/home/someone/public_html/x\n", True),
        ("PDOException\n", True),
        ("SQLSTATE[HY000]\n", True),
        ("", True),
    ),
    "directory": (
        ("Index of /backup\n", True),
        ("<title>Index of x</title>\n", True),
        ("Directory listing for /\n", True),
        ("Parent Directory, Last modified, NGINX\n", True),
        ("apache and nginx\n", True),
        ("", True),
    ),
    "dsstore": (("xxBud1xx", True), ("", True), (HTML, False)),
    "aws": (
        ("[default]\naws_access_key_id = x\n", True),
        ("[profile a]\naws_secret_access_key = y\n", True),
        ("key AK" + "IAABCDEFGHIJKLMNOP\n", True),
        ("", True),
    ),
    "metadata": (
        ("ami-id\ninstance-id\n", True),
        ("iam/\n", True),
        ("project-id\n", True),
        ("hello world", False),
        (HTML, False),
        ("", True),
    ),
    "kube": (
        ("apiVersion: v1\nkind: Config\n", True),
        ("certificate-authority-data: x\n", True),
        ("clusters:\nusers:\n", True),
        ("", True),
    ),
    "shell": (
        ("sudo ls\nssh host\n", True),
        ("curl x\n", True),
        ("ls -la\ncd /\n", True),
        (HTML + " sudo ssh ", True),
        ("ab", False),
        ("", True),
    ),
    "binary": (("JAVA PROFILE 1.0.2\n", True), ("", True), (HTML, True), ("short", False)),
    "json": (
        ('{"propertySources": []}', False),
        ('{"beans": {}}', False),
        ('{"tenantId": 1}', False),
        ('{"my_password": 1}', False),
        ('{"ok": 1}', False),
        ("[1, 2]", False),
        ("not json", False),
        ('{"ok": 1}\n', True),
    ),
    "none": (
        ("", True),
        ("short", False),
        (HTML, False),
        ('{"a": 1}', False),
        ("a plain line of text that is long enough", False),
    ),
}

# Bodies for the false-positive filter.
NOISE = (
    ("", True),
    ("tiny", False),
    ("blocked, Ray ID: 1\n", True),
    ("Page Not Found\n", True),
    ("Permission denied: no such file\n", True),
    (HTML, True),
    ('<form><input name="password"></form> server login form', True),
    ("just some text, long enough", False),
)


def combinations(validator: str | None = None, noise: bool = False) -> list[tuple[int, str, str, str, str, str]]:
    """``(number, path, entity, validator, head, place of the text)`` of every rule and form.

    The text's place is ``behind`` the head, in a ``field`` of the JSON object, or ``none``.
    """
    chosen = [r for r in PATH_RULES if validator in (None, r.validator)]
    deepest = max(len(f) for f in FORMS.values()) if not noise else len(NOISE)
    rows, number = [], 0
    for i in range(deepest):
        for r in chosen:
            forms = NOISE if noise else FORMS[r.validator]
            if i >= len(forms):
                continue
            head, whole = forms[i]
            with_text = "field" if head.startswith("{") and head.endswith("}") else "behind"
            rows += [(number, r.path, r.entity, r.validator, head, p) for p in ([with_text] if whole else ["none", with_text])]
            number += 1
    return rows


_STATUS = "CASE WHEN doc_id % 23 = 5 THEN 404 ELSE 200 END"
_TYPE = "CASE WHEN head LIKE '<%' THEN 'text/html' ELSE 'text/plain' END"
# Second captures of bare heads, with the text, stand under fifty domains of their own.
_SITE = "CASE WHEN again THEN doc_id % 50 + 50 ELSE doc_id % 50 END"


def _numbered(validator: str | None, noise: bool) -> tuple[list[tuple], int]:
    """Forms with a mark on each second capture of a number; and how many numbers there are."""
    rows = combinations(validator, noise)
    bare = {r[0] for r in rows if r[5] == "none"}
    return [(*r, r[5] != "none" and r[0] in bare) for r in rows], rows[-1][0] + 1


def path_captures(spark: SparkSession, sf_dir: str, validator: str | None = None, noise: bool = False) -> DataFrame:
    """``doc_id, domain, url, path, entity, validator, status, content_type, body, body_bytes``."""
    rows, numbers = _numbered(validator, noise)
    forms = spark.createDataFrame(
        rows, "number bigint, path string, entity string, validator string, head string, place string, again boolean"
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % numbers).alias("number"))
    field = "concat(substring(head, 1, length(head) - 1), ', ', substring(to_json(named_struct('text', text)), 2))"
    body = f"CASE place WHEN 'none' THEN head WHEN 'behind' THEN concat(head, text) ELSE if(text IS NULL, NULL, {field}) END"
    return docs.join(F.broadcast(forms), "number").selectExpr(
        "doc_id",
        f"concat('site', {_SITE}, '.example') AS domain",
        f"concat('https://site', {_SITE}, '.example', path) AS url",
        "path",
        "entity",
        "validator",
        f"{_STATUS} AS status",
        f"{_TYPE} AS content_type",
        f"{body} AS body",
        f"CAST(octet_length({body}) AS BIGINT) AS body_bytes",
    )


def path_captures_sql(validator: str | None = None, noise: bool = False) -> str:
    """The same table for the comparison engine."""

    def lit(x: str) -> str:
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"

    rows, numbers = _numbered(validator, noise)
    values = ", ".join(f"({n}, {lit(p)}, {lit(e)}, {lit(v)}, {lit(h)}, {lit(w)}, {str(a).lower()})" for n, p, e, v, h, w, a in rows)
    field = "substr(head, 1, length(head) - 1) || ', ' || substr(CAST(json_object('text', text) AS VARCHAR), 2)"
    body = f"CASE place WHEN 'none' THEN head WHEN 'behind' THEN head || text ELSE CASE WHEN text IS NOT NULL THEN {field} END END"
    return f"""SELECT doc_id, 'site' || ({_SITE}) || '.example' AS domain, 'https://site' || ({_SITE}) || '.example' || path AS url, path, entity, validator,
        {_STATUS} AS status, {_TYPE} AS content_type, {body} AS body, lower({body}) AS cl, regexp_replace({body}, '^\\s+|\\s+$', '', 'g') AS st
        FROM documents JOIN (VALUES {values}) f(number, path, entity, validator, head, place, again) ON doc_id % {numbers} = number"""
