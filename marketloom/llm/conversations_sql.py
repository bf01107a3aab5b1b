"""The repair of conversations in DuckDB SQL: a walk over the rows that keeps the best (cost, audit) of every state."""

from __future__ import annotations


def duckdb_sql() -> str:
    def best(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"

    def step(state: str, cost: str, label: str, line: str = "") -> str:
        """The state's path with one more edit, null where there is none."""
        added = f"list_append({state}.r, {line})" if line else f"{state}.r"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{label}', 'r': {added}}} END"

    insert_user = [step(s, "5", "I", "'user:'") for s in ("s0", "s1", "s3")]
    keep = "CASE WHEN cut THEN 5 ELSE 0 END"
    said = "role || ':' || text"

    def kept(state: str, letter: str) -> str:
        return f"CASE WHEN ok AND initial = '{letter}' THEN {step(state, keep, 'K', said)} END"

    def changed(state: str, role: str) -> str:
        line = f"'{role}:' || text"
        return f"CASE WHEN ok THEN {step(state, f'1 + {keep}', 'R', line)} END"

    def opened(q: int) -> str:
        return f"e{q}"

    into_user = ", ".join(f"{kept(opened(q), 'u')}, {changed(opened(q), 'user')}" for q in (0, 1, 3))
    return f"""WITH RECURSIVE steps AS (SELECT 0 AS k, i AS entry, i::BIGINT AS c FROM range(256) t(i) UNION ALL
        SELECT k + 1, entry, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
      lookup AS (SELECT list(c ORDER BY entry) AS t FROM steps WHERE k = 8),
      said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
      faults AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(key)), '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS fault FROM said, lookup),
      damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM faults WHERE fault > 0),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(0) || text)) AS i
        FROM damaged),
      judged AS (SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
      rows AS (SELECT *, bare = '' AS blank, bare <> '' AND seen AS dup,
        bare <> '' AND NOT seen AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, bare <> '' AND NOT seen AS ok FROM judged),
      report AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
        FROM rows GROUP BY conv_id),
      walk AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS s0,
          NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR[]) AS s1, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR[]) AS s2,
          NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR[]) AS s3 FROM report
        UNION ALL
        SELECT conv_id, i, {best(step("e0", "2", "D"))} AS s0, {best(step("e1", "2", "D"), kept("e0", "s"))} AS s1,
          {best(step("e2", "2", "D"), into_user)} AS s2,
          {best(step("e3", "2", "D"), kept("e2", "a"), changed("e2", "assistant"))} AS s3
        FROM (SELECT b.*, s0 AS e0, s1 AS e1, u AS e2, {best("s3", step("u", "5", "I", "'assistant:'"))} AS e3
          FROM (SELECT r.conv_id, r.i, r.role, r.text, r.initial, r.cut, r.ok, s0, s1, s3, {best("s2", *insert_user)} AS u
            FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1) b)),
      ends AS (SELECT conv_id, {best("s0", "s3", step("u", "5", "I", "'assistant:'"))} AS s FROM (SELECT w.conv_id, s0, s3,
          {best("s2", *insert_user)} AS u FROM walk w JOIN report r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.i))
      SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.c, 0)::BIGINT AS cost,
        coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.r, chr(10)), '')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN report r ON i.conv_id IS NOT DISTINCT FROM r.conv_id
        LEFT JOIN ends e ON i.conv_id IS NOT DISTINCT FROM e.conv_id"""
