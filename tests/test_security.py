"""Each rule on one positive file, no finding on clean files, suppressions, gate."""

from __future__ import annotations

from weirflow.operators import security

POSITIVE = {
    "entropy.py": 'password = "Xk9#mQ2vR7tW4nP8sL3zF1c"',
    "prefix.py": 'import os\n\napi_key = "sk-1234567890abcdef1234567890abcdef"',
    "inject.py": 'cur.execute(f"SELECT * FROM users WHERE id = {user_id}")',
    "shell.py": "import subprocess\n\nsubprocess.run(cmd, shell=True)",
    "dsn.py": 'def connect():\n    return jdbc("jdbc:postgresql://db:5432/app?user=app&password=supersecret")',
    "auth.sql": "CREATE USER reader IDENTIFIED BY 'readonly123';\n",
    "clean.py": 'password = os.getenv("DB_PASSWORD")\ncur.execute("select 1 where id = %s", (a,))\nsubprocess.run(["ls"])\n',
}


def frame(spark, **files):
    return spark.createDataFrame([(k.replace("__", "."), k.rpartition("__")[2], v) for k, v in files.items()], "path string, ext string, content string")


def test_corpus(spark):
    found = security.scan(frame(spark, **{k.replace(".", "__"): v for k, v in POSITIVE.items()}))
    got = {(r.path, r.rule_id, r.severity) for r in found.collect()}
    assert got == {("entropy.py", "SEC-001", "high"), ("prefix.py", "SEC-001", "critical"), ("inject.py", "SEC-002", "high"), ("shell.py", "SEC-003", "high"), ("dsn.py", "SEC-004", "medium"), ("auth.sql", "SEC-005", "medium")}
    assert all("1234567890abcdef" not in r.snippet_redacted and "Xk9#" not in r.snippet_redacted for r in found.collect())
    assert security.gate(found, "critical").first().failed and not security.gate(found, "none").first().failed


def test_suppressions(spark):
    text = "os.system(a)  # weirflow:off SEC-003\nos.system(b)  # weirflow:off SEC-001, SEC-002\nos.system(c)\n"
    f = frame(spark, a__py=text, b__py="# weirflow:off-all\nos.system(c)\n")
    got = {(r.path, r.line, r.status) for r in security.scan(f).collect()}
    assert got == {("a.py", 1, "suppressed"), ("a.py", 2, "open"), ("a.py", 3, "open"), ("b.py", 2, "suppressed")}
    assert security.histogram(security.scan(f)).first().asDict() == {"critical": 0, "high": 2, "medium": 0, "low": 0, "suppressed": 2}
    assert security.new_since(security.scan(f), security.scan(frame(spark, a__py=text))).count() == 0
