"""SQL twins of the operators, used only to check results on another engine."""

from __future__ import annotations

from ..functions import predicates as P
from ..rules.catalogue import (BUILTIN, CONFIDENCE_RANK, ENTROPY_CANDIDATE, ENTROPY_PROVIDER, ENTROPY_RULE_ID, Rule)
from ..operators.vault import KINDS, DEFAULT_KIND


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, flags: str = "") -> str:
    out = pattern
    # RE2 has no back-reference, no look-around and repeats at most 1000 times.
    out = out.replace(r"[\s\S]{0,8000}?", r"[\s\S]*?").replace(r"[\s\S]{0,4000}?", r"[\s\S]*?")
    out = out.replace(r"-----END\s+\1-----", r"-----END\s+(?:RSA|DSA|EC|OPENSSH|PGP|ENCRYPTED)?\s*PRIVATE KEY(?:\s+BLOCK)?-----")
    out = out.replace(r"(?=[\s,;)\]}]|$)", r"(?:[\s,;)\]}]|$)")
    return (f"(?{flags})" if flags else "") + out


def entropy(v: str) -> str:
    p = f"(len({v}) - len(replace({v}, ch, '')))::DOUBLE / len({v})"
    return (f"(CASE WHEN len({v}) = 0 THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split({v}, '')), "
            f"lambda ch: ({p}) * log2({p}))) END)")


def words(items) -> str:
    return "[" + ", ".join(lit(w) for w in items) + "]"


def placeholder_value(v: str, prefix: str = "MASKED") -> str:
    low = f"lower({v})"
    body = f"lower(regexp_replace({v}, '^[A-Za-z]{{2,12}}[_-]', ''))"
    tokens = f"regexp_split_to_array({low}, '[^a-z0-9]+')"
    bare = f"regexp_replace({low}, '[^a-z0-9]', '', 'g')"
    return "(" + " OR ".join([
        f"{v} IN ({', '.join(lit(k) for k in P.KNOWN_FAKES)})",
        f"len(list_filter({words((*P.STRONG_MARKERS, prefix.lower()))}, lambda m: contains({low}, m))) > 0",
        f"list_has_any({tokens}, {words(P.STRONG_WORDS)})",
        f"len(list_distinct(list_intersect({tokens}, {words(P.WEAK_WORDS)}))) >= 2",
        f"list_contains({words((*P.STRONG_WORDS, *P.WEAK_WORDS))}, {bare})",
        f"regexp_matches({v}, {lit('(?i)^(?:' + '|'.join(P.REFERENCE_ROOTS) + ')[.[]')})",
        f"left({v}, 1) IN ('<', '{{', '$', '%')", f"right({v}, 1) IN ('>', '}}', '%')",
        f"contains({low}, 'xxxx')",
        f"(len({body}) > 3 AND len(list_distinct(string_split({body}, ''))) <= 2)",
        f"len(list_filter({words(P.SEQUENCES)}, lambda m: contains({low}, m))) > 0",
        f"len(list_filter(list_distinct(string_split({v}, '')), lambda c: contains({v}, repeat(c, 6)))) > 0",
    ]) + ")"


VALIDATORS = {
    "not-sibling-prefix": "NOT starts_with(match, 'sk-ant-')",
    "not-variable": r"NOT regexp_matches(match, '^\$\{?[A-Z_]+\}?$') AND NOT regexp_matches(match, '^%[A-Z_]+%$')",
    "not-shell-variable": r"NOT regexp_matches(match, '^\$\{?[A-Z_]+\}?$')",
    "mixed-classes": "regexp_matches(match, '[0-9]') AND regexp_matches(match, '[a-z]') AND regexp_matches(match, '[A-Z]')",
}


def jwt_part(i: int) -> str:
    part = f"translate(string_split(match, '.')[{i}], '-_', '+/')"
    return f"decode(from_base64({part} || repeat('=', CAST((4 - len({part}) % 4) % 4 AS BIGINT))))"


VALIDATORS["jwt"] = (f"json_valid({jwt_part(1)}) AND json_valid({jwt_part(2)}) AND json_type({jwt_part(1)}) = 'OBJECT' "
                     f"AND json_type({jwt_part(2)}) = 'OBJECT' AND json_type({jwt_part(1)}, '$.alg') = 'VARCHAR'")


def raw_rule(source: str, key: str, position: int, rule: Rule) -> str:
    """All matches of one rule over ``source(key, text)`` with start, secret and entropy."""
    p = lit(re2(rule.pattern, rule.flags))
    gate = " OR ".join(f"contains(text, {lit(x)})" for x in rule.prefilter) or "TRUE"
    tests = [f"entropy >= {rule.entropy_min or 0}", "len(match) > 0"]
    if rule.validator:
        tests.append(VALIDATORS[rule.validator])
    return f"""
SELECT {key}, {position} AS ord, seq, {lit(rule.id)} AS rule_id, {lit(rule.provider)} AS provider,
       {lit(rule.confidence)} AS confidence, {CONFIDENCE_RANK[rule.confidence]} AS rank, start_at, match, entropy FROM (
  SELECT *, {entropy('match')} AS entropy FROM ({matches(source, key, p, f"regexp_extract_all(text, {p}, {rule.group})", gate)})
) WHERE {' AND '.join(tests)}"""


def matches(source: str, key: str, p: str, secrets: str, gate: str) -> str:
    """Positions from the gaps between matches, as any SQL engine without offsets can do."""
    return f"""
  SELECT {key}, i - 1 AS seq, s[i] AS match,
         CAST(list_sum(list_slice(gaps, 1, i)) + coalesce(list_sum(list_slice(lens, 1, i - 1)), 0)
              + instr(w[i], s[i]) - 1 AS BIGINT) AS start_at
  FROM (SELECT {key}, w, s, list_transform(w, lambda x: len(x)) AS lens,
               list_transform(regexp_split_to_array(text, {p}), lambda x: len(x)) AS gaps, unnest(range(1, len(w) + 1)) AS i
        FROM (SELECT {key}, text, regexp_extract_all(text, {p}, 0) AS w, {secrets} AS s FROM {source}
              WHERE ({gate}) AND regexp_matches(text, {p})))"""


OVERLAP = "a.start_at < b.start_at + len(b.match) AND a.start_at + len(a.match) > b.start_at"
STRONGER = ("(b.rank > a.rank OR (b.rank = a.rank AND (len(b.match) > len(a.match) OR (len(b.match) = len(a.match) "
            "AND (b.ord < a.ord OR (b.ord = a.ord AND b.seq < a.seq))))))")


def findings(source: str, key: str = "doc_id", rules=BUILTIN, path: str | None = None, pragma: str = "veilspan",
             prefix: str = "MASKED", threshold: float = 4.0, with_entropy: bool = True,
             allow_patterns=(), allow_path_regex: str | None = None) -> str:
    """CTE list ending in ``findings``; ``source`` has the key, ``text`` and perhaps a path column."""
    ctes = ["raw AS (" + "\nUNION ALL".join(raw_rule(source, key, i, r) for i, r in enumerate(rules, 1)) + ")"]
    pool = "raw"
    for n in range(3):  # three rounds settle chains of three overlapping spans
        ctes.append(f"won{n} AS (SELECT a.* FROM {pool} a WHERE NOT EXISTS (SELECT 1 FROM {pool} b "
                    f"WHERE a.{key} = b.{key} AND {OVERLAP} AND {STRONGER}))")
        ctes.append(f"rest{n} AS (SELECT a.* FROM {pool} a WHERE NOT EXISTS (SELECT 1 FROM won{n} b "
                    f"WHERE a.{key} = b.{key} AND {OVERLAP}))")
        pool = f"rest{n}"
    ctes.append("structured AS (SELECT * FROM won0 UNION ALL SELECT * FROM won1 UNION ALL SELECT * FROM won2)")
    p = lit(re2(ENTROPY_CANDIDATE))
    values = (f"list_transform(list_zip(regexp_extract_all(text, {p}, 1), regexp_extract_all(text, {p}, 2)), "
              "lambda z: CASE WHEN z[1] <> '' THEN z[1] ELSE z[2] END)")
    floor = f"CASE WHEN regexp_matches(match, '^[0-9a-fA-F]+$') THEN {min(3.0, threshold)} ELSE {threshold} END"
    ctes.append(f"""candidates AS (SELECT {key}, {len(rules) + 1} AS ord, seq, {lit(ENTROPY_RULE_ID)} AS rule_id,
  {lit(ENTROPY_PROVIDER)} AS provider, 'low' AS confidence, 1 AS rank, start_at, match, entropy FROM (
  SELECT *, {entropy('match')} AS entropy FROM ({matches(source, key, p, values, 'TRUE')})) a
  WHERE entropy >= {floor} AND NOT {placeholder_value('match', prefix)} AND NOT EXISTS (
    SELECT 1 FROM structured b WHERE a.{key} = b.{key} AND {OVERLAP}))""")
    both = "SELECT * FROM structured UNION ALL SELECT * FROM candidates" if with_entropy else "SELECT * FROM structured"
    line = ("string_split(substring(text, 1, CAST(start_at AS BIGINT)), chr(10))[-1] || "
            "string_split(substring(text, CAST(start_at AS BIGINT) + 1), chr(10))[1]")
    pragma_re = lit(rf"(?i)(?:^|[#/*;-]|<!--)\s*{pragma}\s*:\s*(?:allow|ignore|disable)")
    rungs = [f"WHEN {placeholder_value('match', prefix)} THEN 'placeholder value'",
             f"WHEN contains(lower(text), {lit(pragma)}) AND regexp_matches({line}, {pragma_re}) THEN {lit(pragma + ':allow pragma')}"]
    rungs += [f"WHEN regexp_matches(match, {lit(a)}) THEN 'allowlist pattern'" for a in allow_patterns]
    if allow_path_regex:
        rungs.append(f"WHEN regexp_matches({path}, {lit(allow_path_regex)}) THEN 'allowlisted path'")
    test = f"regexp_matches({path}, {lit('(?i)' + P.TEST_PATH)})" if path else "FALSE"
    # Only rows with findings need their text again.
    ctes.append(f"""noted AS (SELECT f.*, CASE {' '.join(rungs)} END AS stop, {test} AS in_test, d.* EXCLUDE ({key})
  FROM ({both}) f JOIN {source} d USING ({key}))""")
    ctes.append(f"""findings AS (SELECT {key}, rule_id, provider, match, CAST(start_at AS INTEGER) AS start_at,
  CAST(start_at + len(match) AS INTEGER) AS end_at, entropy,
  CASE WHEN stop IS NOT NULL THEN 'suppressed' ELSE 'active' END AS status,
  CASE WHEN stop IS NULL AND in_test THEN 'low' ELSE confidence END AS confidence,
  CASE WHEN stop IS NOT NULL THEN stop WHEN in_test THEN 'test/fixture path' END AS note,
  len(substring(text, 1, CAST(start_at AS BIGINT))) - len(replace(substring(text, 1, CAST(start_at AS BIGINT)), chr(10), '')) + 1 AS line,
  (rule_id <> {lit(ENTROPY_RULE_ID)} AND NOT (stop IS NULL AND in_test) AND confidence <> 'low' AND stop IS NULL) AS serious
  FROM noted)""")
    return ",\n".join(ctes)


def kind(rule_id: str) -> str:
    return ("CASE " + " ".join(f"WHEN regexp_matches({rule_id}, {lit(p)}) THEN {lit(k)}" for p, k in KINDS)
            + f" ELSE {lit(DEFAULT_KIND)} END")


def stem(provider: str, rule_id: str, prefix: str = "MASKED") -> str:
    word = f"trim(regexp_replace(upper({provider}), '[^A-Z0-9]+', '_', 'g'), '_')"
    return f"({lit(prefix + '_')} || coalesce(nullif({word}, ''), 'UNKNOWN') || '_' || {kind(rule_id)})"


def digest(secret: str, inner: bytes, outer: bytes) -> str:
    """HMAC-SHA256 from two digests over blobs."""
    return (f"upper(sha256(from_hex({lit(outer.hex())}) || unhex(sha256(from_hex({lit(inner.hex())}) || encode({secret})))))")
