"""Conversation structure repair by depth-first branch and bound (operator 11).

The turns of a conversation must read ``(system? (user assistant)+)?``. A search keeps, reroles, deletes
and inserts turns for the least cost, ties for the least audit. It goes depth first over an explicit
stack; a suffix bound (the cheapest way through the rest if it might end anywhere) and the incumbent
(cost, audit) cut branches, and a table per node (turn, state) keeps the best prefix that reached it:
worse ones are dropped. At one node equally cheap prefixes are never beginnings of each other, as inserts
cost, so the smaller prefix stays smaller whatever follows. When the stack is empty the optimum is proved.

Only the kind of each turn enters the search, so conversations of the same shape share one. A long
conversation is searched block by block between the states at its borders; of each state only the best
prefix (cost, audit, hash so far) goes on, so a conversation of any length streams through its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheeltrace.llm.common import table
from wheeltrace.llm.registry import query

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK_TURNS = 512
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
# states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
GOOD_END = (START, ASSISTANT)
NEXT_ROLE = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FULL = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}


def _steps(kind: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of a turn of a kind at a state, in the order of their initials: (initial, cost, next state).

    A kind is the role's initial (``x`` for others), in upper case if truncated, or ``#`` if the turn must go.
    """
    out = [("D", DELETE, state)]
    if kind != "#":
        role, more = kind.lower(), TRUNCATED if kind.isupper() else 0
        wanted = NEXT_ROLE[state]
        if role == wanted or role == "s" and state == START:
            out.append(("K", KEEP + more, AFTER[role]))
        if role != wanted:
            out.append(("R", REROLE + more, AFTER[wanted]))
    return out


def suffix_bounds(kinds: str) -> list[list[int]]:
    """Least cost of the turns from each place on, by state, if every state were a good end."""
    low = [[0] * 4]
    for kind in reversed(kinds):
        after = low[-1]
        here = [min(c + after[s] for _, c, s in _steps(kind, state)) for state in range(4)]
        for _ in range(3):  # inserts before this turn
            here = [min(here[s], INSERT + here[AFTER[NEXT_ROLE[s]]]) for s in range(4)]
        low.append(here)
    return low[::-1]


def _smaller(a, b) -> bool:
    """Whether the edits of prefix ``a`` sort before those of ``b``; a prefix is (edit, length, prefix before)."""
    edit_a = edit_b = ""
    while a is not b:
        longer = a[1] - b[1]
        if longer >= 0:
            edit_a, a = a[0], a[2]
        if longer <= 0:
            edit_b, b = b[0], b[2]
    return edit_a < edit_b  # the first edits after what both share


def _written(path) -> str:
    out = []
    while path[1]:
        out.append(path[0])
        path = path[2]
    return "".join(reversed(out))


@lru_cache(maxsize=50_000)
def search(kinds: str, state: int = START, ends: tuple[int, ...] = GOOD_END) -> tuple[int, str, int] | None:
    """Cheapest repair of turns from a state to one of ``ends``: (cost, audit, end state); None if there is none."""
    n, low = len(kinds), suffix_bounds(kinds)
    best, best_end = None, None
    reached: list[dict] = [{} for _ in range(n + 1)]
    stack = [(0, state, 0, ("", 0, None))]
    while stack:
        at, s, cost, path = stack.pop()
        if best and cost + low[at][s] > best[0]:
            continue
        known = reached[at].get(s)
        if known and (cost > known[0] or cost == known[0] and not _smaller(path, known[1])):
            continue
        reached[at][s] = cost, path
        if at == n and s in ends and (not best or cost < best[0] or cost == best[0] and _smaller(path, best[1])):
            best, best_end = (cost, path), s
        steps = _steps(kinds[at], s) if at < n else []
        nxt = AFTER[NEXT_ROLE[s]]
        found = [(cost + c + low[at + 1][t], e, at + 1, t, cost + c) for e, c, t in steps]
        found.append((cost + INSERT + low[at][nxt], "I", at, nxt, cost + INSERT))
        for bound, e, i, t, c in sorted(found, reverse=True):  # the most promising on top, ties by initial
            if not best or bound <= best[0]:
                stack.append((i, t, c, (e, path[1] + 1, path)))
    return (best[0], _written(best[1]), best_end) if best else None


def _lines(audit: str, state: int, turns: list[tuple[str, str]]) -> Iterator[tuple[str, int | None, str, str]]:
    """Repaired turns that an audit makes of (role, text) turns: (edit, index or None if inserted, role, text)."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        wanted = NEXT_ROLE[state]
        if edit == "I":
            yield edit, None, FULL[wanted], ""
            state = AFTER[wanted]
            continue
        role, text = turns[at]
        initial = role[:1] if edit == "K" else wanted
        yield edit, at, role if edit == "K" else FULL[wanted], text
        state, at = AFTER[initial], at + 1


class _Conversation:
    """Turns of one conversation as they stream by: counts, and the best prefix of every state at block borders."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.kinds, self.seen, self.before = [], [], set(), None
        self.low = self.high = self.last_turn = None
        self.distinct = 0
        # state -> (cost, audit, hash so far, whether a line was hashed)
        self.best: dict[int, tuple] = {START: (0, "", hashlib.sha256(), False)}

    def add(self, turn, role: str, text: str) -> None:
        if turn is not None:
            self.distinct += turn != self.last_turn
            self.last_turn = turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.before = initial
        ink = text.rstrip(BLANKS)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        kind = initial if initial in AFTER else "x"
        if not ink:
            self.blank += 1
            kind = "#"
        elif key in self.seen:
            self.duplicate += 1
            kind = "#"
        elif ink[-1] not in ENDS:
            self.truncated += 1
            kind = kind.upper()
        self.seen.add(key)
        if len(self.kinds) == BLOCK_TURNS:
            self._block(range(4))
        self.turns.append((role, text))
        self.kinds.append(kind)

    def _block(self, ends) -> None:
        kinds, found = "".join(self.kinds), {}
        for s, (cost, audit, _, _) in self.best.items():
            for end in ends:
                way = search(kinds, s, (end,))
                if way and (end not in found or (cost + way[0], audit + way[1]) < found[end][:2]):
                    found[end] = cost + way[0], audit + way[1], s, way[1]
        nxt = {}
        for end, (cost, audit, s, part) in found.items():
            digest, any_line = self.best[s][2].copy(), self.best[s][3]
            for _, _, role, text in _lines(part, s, self.turns):
                digest.update((("\n" if any_line else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                any_line = True
            nxt[end] = cost, audit, digest, any_line
        self.best, self.turns, self.kinds = nxt, [], []

    def report(self) -> tuple:
        self._block(GOOD_END)
        cost, audit, digest, _ = min(self.best.values(), key=lambda x: x[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, turn, role, text or None, new conversation?) of sorted rows."""
    last = begun = None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            new = begun is None or row[0] != last
            last, begun = row[0], True
            yield (*row, new)


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _ordered(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns of each conversation together and in order; a null text marks a conversation that may have no turn."""
    named = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                      F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    # rows of an equal turn go by role and text, so that the result does not depend on the order of the input
    return named.repartition("id").sortWithinPartitions(F.asc_nulls_first("id"), F.asc_nulls_first("turn"), "role", "text")


def repair_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are ordered by turn (null first), equal turns by role and text. Of each turn the first fault counts: blank,
    duplicate (role and text occurred earlier), truncated (does not end on . ! or ?). The cheapest edits (keep 0,
    rerole 1, delete 2, insert 5, an undeleted truncated turn 5 more; blank and duplicate turns must go) that lead to
    ``(system? (user assistant)+)?`` are the audit, ties the least by ASCII. A null role counts as one space; a row with a null text is no
    turn, it only keeps its conversation in the result (no turns: zeros, an empty audit, the hash of nothing). A null
    id is a conversation like others. Other columns are not read; an empty table gives an empty result. One task holds a block of
    turns, the audit and 16 bytes a turn of a conversation, never its texts.
    """
    kind = dict(df.dtypes)[id_col]
    ordered = _ordered(df, id_col, turn_col, role_col, text_col)

    def run(batches):
        ids, rows, now, id_type = [], [], None, None

        def batch():
            cols = list(zip(*rows))
            arrays = [pa.array(ids, id_type), *(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6]), pa.array(cols[7])]
            return pa.RecordBatch.from_arrays(arrays, [id_col, *_REPORT, "audit", "repaired_sha256"])

        def typed(source):
            nonlocal id_type
            for b in source:
                id_type = b.schema.field(0).type
                yield b

        for key, turn, role, text, new in _conversations(typed(batches)):
            if new:
                if now is not None:
                    rows.append(now.report())
                    if len(rows) >= 5000:
                        yield batch()
                        ids, rows = [], []
                ids.append(key)
                now = _Conversation()
            if text is not None:
                now.add(turn, " " if role is None else role, text)
        if now is not None:
            rows.append(now.report())
            yield batch()

    return ordered.mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in _REPORT)}, audit string, repaired_sha256 string")


def repaired_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: one row (id, place, edit, turn, role, text) per turn that is left or inserted.

    ``place`` counts from 0, ``turn`` is null for inserted turns. Rules and orders as in :func:`repair_conversations`;
    conversations without turns have no rows. One task holds the turns of one conversation.
    """
    kind = dict(df.dtypes)[id_col]
    ordered = _ordered(df, id_col, turn_col, role_col, text_col)

    def lines(key, held):
        if not held:
            return []
        now = _Conversation()
        for turn, role, text in held:
            now.add(turn, role, text)
        audit = now.report()[6]
        found = _lines(audit, START, [(role, text) for _, role, text in held])
        return [(key, i, edit, None if at is None else held[at][0], role, text) for i, (edit, at, role, text) in enumerate(found)]

    def run(batches):
        held, last, out, id_type = [], None, [], None

        def batch():
            cols = list(zip(*out))
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [id_col, "place", "edit", "turn", "role", "text"])

        def typed(source):
            nonlocal id_type
            for b in source:
                id_type = b.schema.field(0).type
                yield b

        for key, turn, role, text, new in _conversations(typed(batches)):
            if new:
                out += lines(last, held)
                held, last = [], key
                if len(out) >= 5000:
                    yield batch()
                    out = []
            if text is not None:
                held.append((turn, " " if role is None else role, text))
        out += lines(last, held)
        if out:
            yield batch()

    return ordered.mapInArrow(run, f"`{id_col}` {kind}, place long, edit string, turn long, role string, text string")


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with faults set by the CRC-32 of ``conv_id:turn`` modulo 20 (null ids, turns, roles and texts: one space there).

    0 drops the turn (its row stays with a null text), 1 empties its text, 2 removes all . ! ? from it, 3 repeats it, 4 sets
    its role to user.
    """
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    fault = (F.crc32(key) % 20).alias("fault")
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault)
    fault, text = F.col("fault"), F.col("text")
    text = F.when(fault == 0, None).when(fault == 1, "").when(fault == 2, F.translate(text, ENDS, "")).otherwise(text)
    rows = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


def _sql() -> str:
    """The same optimum by a table over (turn, state), written as recursive SQL."""
    far = "{'c': 1000000000, 'a': '', 't': ''}"

    def step(s: str, cost: str, edit: str, line: str | None = None) -> str:
        more = f"{s}.t || chr(10) || {line}" if line else f"{s}.t"
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {more}}}"

    def inserted(s0, s1, s2, s3):  # states after inserts
        u = f"least({s2}, " + ", ".join(step(s, "5", "I", "'user:'") for s in (s0, s1, s3)) + ")"
        return u, lambda name: f"least({s3}, " + step(name, "5", "I", "'assistant:'") + ")"

    u, a = inserted("s0", "s1", "s2", "s3")
    keep, role_u, role_a = "role || ':' || text", "'user:' || text", "'assistant:' || text"

    def way(ok: str, s: str, cost: str, edit: str, line: str) -> str:
        return f"CASE WHEN NOT gone AND {ok} THEN {step(s, cost, edit, line)} ELSE {far} END"

    to_u = ", ".join(x for s in ("s0", "s1", "v3") for x in (way("ini = 'u'", s, "cut", "K", keep), way("ini <> 'u'", s, "cut + 1", "R", role_u)))
    to_a = ", ".join((way("ini = 'a'", "v2", "cut", "K", keep), way("ini <> 'a'", "v2", "cut + 1", "R", role_a)))
    return f"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, list_transform(range(8), lambda z: CAST(0 AS BIGINT))),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END)) AS tab
), k AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), f AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(unicode(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS fault FROM k, bits
), r AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fault <> 0)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, substr(role, 1, 1) AS ini FROM r
), q AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS bare,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini NOT IN ('su', 'ua', 'au') AS off FROM p
), w AS (
  SELECT *, blank OR again AS gone, CASE WHEN bare THEN 5 ELSE 0 END AS cut FROM q
), d AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': 0, 'a': '', 't': ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, {step('s0', '2', 'D')},
    least({step('s1', '2', 'D')}, {way("ini = 's'", 's0', 'cut', 'K', keep)}),
    least({step('v2', '2', 'D')}, {to_u}), least({step('v3', '2', 'D')}, {to_a})
  FROM (SELECT *, {a('v2')} AS v3 FROM (
    SELECT w.conv_id, w.pos, role, text, ini, gone, cut, s0, s1, s3, {u} AS v2
    FROM d JOIN w ON w.conv_id IS NOT DISTINCT FROM d.conv_id AND w.pos = d.pos + 1))
), e AS (
  SELECT conv_id, arg_max(least(s0, v3), pos) AS s FROM (SELECT *, {a('v2')} AS v3 FROM (SELECT conv_id, pos, s0, s1, s3, {u} AS v2 FROM d)) GROUP BY conv_id
), n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (bare AND NOT blank AND NOT again) AS truncated, count(*) FILTER (off) AS illegal
  FROM w GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(s.c AS BIGINT) AS cost, s.a AS audit, sha256(substr(s.t, 2)) AS repaired_sha256
FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op11_conversation_repair", _sql())
def op11_conversation_repair(spark, sf_dir) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))
