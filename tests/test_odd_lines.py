"""Message lines that strict readers refuse."""

from __future__ import annotations

import pytest

from veilspan.operators.vault import empty_vault, key_frame
from veilspan.sources.messages import guard_messages, parse_messages

AWS = "AKIA" + "4KTNQ7VZL2WXMP3D"


@pytest.mark.parametrize("line, parsed, hits", [
    (f'{{"method":"m","params":{{"a":"q","a":"{AWS}"}}}}', True, 1), (f'{{"params":{{"a":"{AWS}"}},"b":NaN}}', None, 1), (f"log {AWS} {{", False, 1),
    (f'{{"method":"m","result":"{AWS}"}}', True, 0), (f'{{"method":"m","method":"n","params":["{AWS}","{AWS}"]}}', True, 2), ("plain", False, 0), (f'"{AWS}"', True, 0)])
def test_no_line_lets_a_credential_out(spark, line, parsed, hits):
    lines = spark.createDataFrame([(1, line), (2, " ")], "i int, value string")
    out, _ = guard_messages(lines, ["i"], "request", empty_vault(spark), key_frame(spark, b"k"))
    (r,) = out.collect()
    assert r["redactions"] == hits and (parsed is None or r["parsed"] == parsed)
    assert (AWS in r["outgoing"]) == (hits == 0 and AWS in line) and (hits or r["outgoing"] == line)
    assert r["outgoing"].replace("MASKED_AWS_KEY_", "").startswith(line.split(AWS)[0])


def test_methods_of_odd_lines(spark):
    lines = spark.createDataFrame([('{"method":"m","params":{"a":1,"a":2}}',), ("x",)], "value string")
    assert sorted((r["parsed"], r["method"]) for r in parse_messages(lines).collect()) == [(False, None), (True, "m")]
