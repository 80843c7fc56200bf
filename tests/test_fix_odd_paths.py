"""Fix plans of files without a path, or with one that others have too."""

from veilspan.operators import fixplan as X

AWS = "AKIA" + "4KTNQ7VZL2WXMP3D"


def test_each_file_gets_the_edits_of_its_own_text(spark):
    texts = [("a.py", f'key = "{AWS}"\n'), ("a.py", "# no secret here, but a longer text than the other one\n"), ("a.py", f'# x\nkey = "{AWS}"\n'), (None, f'key = "{AWS}"\n'), ("b.py", None)]
    env = X.parse_env(spark.createDataFrame([], "path string, text string"))
    plan = X.plan_fixes(spark.createDataFrame(texts, "path string, text string"), env)
    updated = {(r["path"], r["text"]): r["updated"] for r in plan["files"].collect()}
    assert len(updated) == 5
    assert updated[texts[0]] == 'key = os.environ["KEY"]\n' and updated[texts[2]] == '# x\nkey = os.environ["KEY"]\n'
    assert updated[texts[1]] == texts[1][1] and updated[texts[3]] == texts[3][1] and updated[texts[4]] is None
    assert [tuple(r) for r in plan["skipped"].collect()] == [(None, X.UNSUPPORTED)]
    assert sorted((r["path"], r["line"]) for r in plan["edits"].collect()) == [("a.py", 1), ("a.py", 2)]
