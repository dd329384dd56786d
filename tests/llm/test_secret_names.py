import hashlib

from gritstone.llm import secret_ledger as sl

KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
#: Text, rule, secret: written by hand, with no use of the rules' patterns.
FOUND = [
    ("DB_PASSWORD=hunter2hunter2", "password", "hunter2hunter2"),
    ('"dbPassword": "hunter2hunter2"', "password", "hunter2hunter2"),
    ("spring.datasource.password = hunter2hunter2", "password", "hunter2hunter2"),
    ("PASSWORD_PROD: hunter2hunter2", "password", "hunter2hunter2"),
    ("mysql_pwd='hunter2hunter2';", "password", "hunter2hunter2"),
    ("export ROOT_PASSWD_2=hunter2hunter2", "password", "hunter2hunter2"),
    ("password=hunter2hunter2", "password", "hunter2hunter2"),
    (f"aws_secret_access_key = {KEY}", "keyed_token", KEY),
    (f'secretAccessKey: "{KEY}"', "keyed_token", KEY),
    ('secret_key = "abcdefghij0123456789"', "keyed_token", "abcdefghij0123456789"),
    ("access_key=abcdefghij0123456789", "keyed_token", "abcdefghij0123456789"),
    ("github_access_token=abcdefghij0123456789", "keyed_token", "abcdefghij0123456789"),
    ("my.api.key=abcdefghij0123456789", "keyed_token", "abcdefghij0123456789"),
    ("X2_API-KEY-V2: abcdefghij0123456789", "keyed_token", "abcdefghij0123456789"),
    ("token = abcdefghij0123456789", "keyed_token", "abcdefghij0123456789"),
]
CLEAN = [
    "DB_PASSWORD=short",
    "DB_PASSWORD=",
    "Ask for the password before you go on with hunter2hunter2.",
    "secret_key = none",
    "access_key_id is what identifies abcdefghij0123456789",
    "access granted: abcdefghij0123456789",
    "keyboard = abcdefghij0123456789",
    "passing = hunter2hunter2",
]


def test_secrets_under_any_name(spark):
    texts = [f"before\n{t}\nafter" for t, *_ in FOUND] + CLEAN
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(i, rule, hashlib.sha256(secret.encode()).hexdigest(), len(secret)) for i, (_, rule, secret) in enumerate(FOUND)}
    assert {(r.doc_id, r.rule_id, r.secret_sha256, r.secret_chars) for r in sl.findings(docs).collect()} == want
    assert {r.doc_id for r in sl.remove(docs).collect()} == set(range(len(FOUND), len(texts)))


def test_a_ledger_of_the_former_rules_is_scanned_anew(spark):
    docs = spark.createDataFrame([(1, "DB_PASSWORD=hunter2hunter2")], "doc_id long, text string")
    versions, now = sl.scan(docs)
    old = sl.Ledger(now.seen.selectExpr("blob_id", "transform(rules, r -> concat(split(r, '@')[0], '@1')) rules"), now.findings.filter("false"))
    assert [r.rule_id for r in sl.findings(docs, old).collect()] == ["password"]
