"""SQL twin of the conversation repair: a recursive query that takes one row of every conversation a step.

n, s, u and a hold the best (cost, audit, text) that ends with nothing, a system, a user or an assistant row.
"""

from __future__ import annotations


def _one(cost: str, audit: str, text: str) -> str:
    return f"{{'c': {cost}, 'a': {audit}, 'o': {text}}}"


def _line(state: str, row: str) -> str:
    """A state's text with one more row."""
    feed = "" if state == "n" else "chr(10) || "
    return f"{state}.o || {feed}{row}"


def _step(target: str, sources: str, initial: str, given: str) -> str:
    """The best of deleting the row, keeping it, and giving it another role."""
    out = [_one(f"{target}.c + 2", f"{target}.a || 'D'", f"{target}.o")]
    for s in sources:
        kept = _one(f"{s}.c + late", f"{s}.a || 'K'", _line(s, "role || ':' || text"))
        out.append(f"CASE WHEN stays AND initial = '{initial}' THEN {kept} END")
        if given:
            other = _one(f"{s}.c + late + 1", f"{s}.a || 'R'", _line(s, f"'{given}:' || text"))
            out.append(f"CASE WHEN stays THEN {other} END")
    return f"list_min([{', '.join(out)}])"


def _insert(target: str, sources: str, given: str) -> str:
    out = [target] + [_one(f"{s}.c + 5", f"{s}.a || 'I'", _line(s, f"'{given}:'")) for s in sources]
    return f"list_min([{', '.join(out)}])"


OP11_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations
), hashed AS (
  SELECT *, mod(xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(place, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                             lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))), 20) AS kind FROM given
), after AS (
  SELECT conv, turn, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, left(role, 1) AS initial FROM after
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
         lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM ordered
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM seen
), rows AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS late FROM judged
), facts AS (
  SELECT conv, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv
), dp AS (
  SELECT conv, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS n, {{'c': 1000000000::BIGINT, 'a': '', 'o': ''}} AS s,
         {{'c': 5::BIGINT, 'a': 'I', 'o': 'user:'}} AS u, {{'c': 10::BIGINT, 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:'}} AS a
  FROM facts
  UNION ALL
  SELECT conv, i, n, s, u, {into_a} AS a FROM (
    SELECT conv, i, n, s, {into_u} AS u, a FROM (
      SELECT conv, rows.i, {row_n} AS n, {row_s} AS s, {row_u} AS u, {row_a} AS a
      FROM dp JOIN rows USING (conv) WHERE rows.i = dp.i + 1))
), ends AS (
  SELECT conv, list_min([n, a]) AS best FROM dp JOIN facts USING (conv) WHERE i = n_rows
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(best.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM given) g LEFT JOIN facts USING (conv) LEFT JOIN ends USING (conv)
""".format(
    into_u=_insert("u", "nsa", "user"),
    into_a=_insert("a", "u", "assistant"),
    row_n=_step("n", "", "", ""),
    row_s=_step("s", "n", "s", ""),
    row_u=_step("u", "nsa", "u", "user"),
    row_a=_step("a", "u", "a", "assistant"),
)
