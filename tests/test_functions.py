"""Scalars against plain Python on random and hand-picked input."""

import hashlib
import json
import math
import random
import re

from pyspark.sql import functions as F

from tidewatch.functions import checks, text
from tidewatch.operators import path_scan


def col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def dihedral(a, b):
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def verhoeff(s):
    perms = [list(range(10))]
    for _ in range(7):
        perms.append([(1, 5, 7, 6, 2, 8, 3, 0, 9, 4)[d] for d in perms[-1]])
    c = 0
    for i, d in enumerate(reversed(s)):
        c = dihedral(c, perms[i % 8][int(d)])
    return c == 0


def luhn(s):
    total = 0
    for i, d in enumerate(reversed(s)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def entropy(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s)) if s else 0.0


def test_checksums_on_random_numbers(spark):
    rng = random.Random(1)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.choice((10, 12, 16)))) for _ in range(300)]
    assert col(spark, numbers, checks.verhoeff_check) == [verhoeff(n) for n in numbers]
    assert col(spark, numbers, checks.luhn_check) == [luhn(n) for n in numbers]


def test_checksums_ignore_separators_and_refuse_letters(spark):
    assert col(spark, ["2341 2341-2346", "2341 2341 2347", "", "12a4"], checks.verhoeff_check) == [True, False, False, False]
    assert col(spark, ["4539 1488 0343 6467", "4539-1488-0343-6468", "x"], checks.luhn_check) == [True, False, False]


def test_entropy(spark):
    rng = random.Random(2)
    words = ["", "aaaa", "abcd", "é😀é😀x", *["".join(rng.choice("abcXYZ019é😀-") for _ in range(rng.randint(1, 40))) for _ in range(100)]]
    for got, word in zip(col(spark, words, checks.shannon_entropy), words, strict=True):
        assert abs(got - entropy(word)) < 1e-9


def test_hash_needs_a_salt_and_strips(spark):
    assert col(spark, [" a\t"], lambda c: checks.hash_value(c, "s")) == [hashlib.sha256(b"sa").hexdigest()]
    try:
        checks.hash_value(F.lit("x"), "")
    except ValueError:
        pass
    else:
        raise AssertionError("an empty salt must be refused")


def test_sql_functions(spark):
    checks.register_sql_functions(spark, "it's")
    row = spark.sql(
        "SELECT verhoeff_check('2341 2341 2346') a, luhn_check('4539148803436467') b, shannon_entropy('aabb') c, hash_value(' v ') d"
    ).first()
    assert (row.a, row.b, row.c, row.d) == (True, True, 1.0, hashlib.sha256(b"it'sv").hexdigest())


def test_noise_is_stripped_like_the_python_patterns(spark):
    pages = [
        "<style a>x{width:33.3%}</style>a<script>var t='</p>';</script><b>b</b> 33.333 % 12px 3rem x12px é5em",
        "no markup 1.5% left", "<STYLE>q</STYLE>\n<p\nclass=x>t</p>", "", "a < b and c > d", "100vh 100 vh 1.5 2%",
    ]

    def plain(s):
        s = re.sub(r"<style[^>]*>.*?</style>", " ", s, flags=re.S | re.I)
        s = re.sub(r"<script[^>]*>.*?</script>", " ", s, flags=re.S | re.I)
        s = re.sub(r"<[^>]+>", " ", s)
        s = re.sub(r"\d+\.\d+\s*%", " ", s)
        return re.sub(r"\b\d+(?:px|rem|em|vh|vw|pt|cm|mm)\b", " ", s)

    assert col(spark, pages, text.strip_noise) == [plain(p) for p in pages]


def test_json_validity_matches_json_loads(spark):
    samples = ['{"a":1}', '{"a":1} x', '{"a":1}}', '{"a":1}] x', "[1,2]", "1", "1,2", "", "x", '"s"', "null", '{"a":1}\n ', "1} x", "1] x",
               '{"a":1,"a":2}', '{"a":[1,{"b":null}]}', "[1", '{"v":1},{"v":2}']

    def valid(s):
        try:
            json.loads(s)
            return True
        except ValueError:
            return False

    assert col(spark, samples, text.is_json) == [valid(s) for s in samples]


def test_email_and_contact_file(spark):
    assert col(spark, ["a@b.c", "a b@c.d", "https://a@b.c", "a@b", "@b.c", "a@b.c.d"], text.is_valid_email) == [True, False, False, False, False, True]
    body = "# Contact: mailto:no@x.y\r\nContact: mailto:one@x.y\n  CONTACT:two@x.y  \nContact: https://x.y/c\nEncryption: k"
    assert col(spark, [body, ""], text.contact_emails) == [["one@x.y", "two@x.y"], []]


def test_hosts_and_paths(spark):
    df = spark.createDataFrame(
        [("https://www.A.in:8443/x", "a.in"), ("https://other.in/", "a.in"), ("http://a.in./", "www.a.in")], "u string, d string"
    )
    assert [r[0] for r in df.select(text.canonical_host(F.col("u"), F.col("d"))).collect()] == ["www.a.in", "a.in", "a.in"]
    assert col(spark, ["https://a.in/x?y", "http://a.in"], lambda c: text.join_path(c, F.lit("/.env"))) == ["https://a.in/.env", "http://a.in/.env"]
    long = "/" + "p" * 90
    assert col(spark, [long, "", None, "/a"], text.short_path) == [long[:77] + "...", "/", "/", "/a"]


def test_notes_merge_keeps_types_and_survives_bad_json(spark):
    df = spark.createDataFrame(
        [('{"a":{"b":[1,2]},"r":1}', '{"r":2}'), ("nope", '{"r":2}'), (None, '{"r":2}'), ("[1]", '{"r":2}')], "n string, u string"
    )
    got = [json.loads(r[0]) for r in df.select(text.merge_notes(F.col("n"), F.col("u"))).collect()]
    assert got == [{"a": {"b": [1, 2]}, "r": 2}, {"r": 2}, {"r": 2}, {"r": 2}]


def test_zero_confidence_counts_as_missing(spark):
    df = spark.sql("SELECT * FROM VALUES (0.000BD, 0.700BD), (0.500BD, 0.700BD), (NULL, 0.700BD), (NULL, NULL) AS t(f, h)")
    got = [float(r[0]) for r in df.select(text.effective_confidence(F.col("f").cast("decimal(4,3)"), F.col("h").cast("decimal(4,3)"))).collect()]
    assert got == [0.7, 0.5, 0.7, 0.0]


def test_a_body_is_lowered_once(spark):
    """However many phrases are looked for, and whether or not the caller has it lower-cased."""
    body = F.concat("text", F.lit("; "))
    reason = path_scan.false_positive_reason(F.lit(200), body, F.lit("text/plain"), F.lit("LOG_FILE"))
    rows = [("x" * 9000 + " Access Denied",), ("<HTML>" + "x" * 9000 + " Page Not Found",), ("a plain line of text",), (None,)]
    df = spark.createDataFrame(rows, "text string").select(reason.alias("reason"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(concat(") <= 1
    assert [r.reason for r in df.collect()] == [None, "Soft 404/error page ('page not found')", None, None]
