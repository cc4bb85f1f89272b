"""Repair of conversations: the cheapest edits that give them a legal order of roles, found by a Viterbi search that forgets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import pick, small_batches, text_batches

#: What counts as white space, what ends a sentence, and the role of each initial.
WHITE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
ROLES = {"u": "user", "a": "assistant"}
#: Costs of edits; an undeleted truncated row costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: States of the roles kept so far: none, only a system turn, up to a user's, up to an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The role that has to come next (unless a system turn begins), and the state after it.
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
#: Inserts that end the roles legally.
ENDINGS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: By how much a state may cost more than another one and still win: whatever follows it can follow the other one for
#: so much more (an insert or two, or the delete of a system turn). Nothing is given up at a tie.
REACH = {
    (START, SYSTEM): 4, (START, USER): 5, (START, ASSISTANT): 3, (SYSTEM, START): 0, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 0,
    (USER, START): 2, (USER, SYSTEM): 2, (USER, ASSISTANT): 2, (ASSISTANT, START): 0, (ASSISTANT, SYSTEM): 4, (ASSISTANT, USER): 2,
}

EDITS = "conv_id bigint, edit string, role string, text string, turn bigint, initial string, fault string, cost bigint, last boolean"


@cache
def moves(initial: str, fault: str) -> tuple[tuple[int, int, int, str], ...]:
    """(state, next state, cost, edits) over a row whose role has this initial; edits end with the row's own.

    A delete comes before inserts, never after, as that is the lesser of two equal strings.
    """
    found = [(s, s, DELETE, "D") for s in STATES]
    if fault in ("blank", "duplicate"):
        return tuple(found)
    more = TRUNCATED if fault == "truncated" else 0
    for state in STATES:
        at = state
        for inserts in range(3):
            role, after = NEXT[at]
            if initial == role:
                found.append((state, after, INSERT * inserts + more, "I" * inserts + "K"))
            else:
                found.append((state, after, INSERT * inserts + REROLE + more, "I" * inserts + "R"))
            if initial == "s" and at == START:
                found.append((state, SYSTEM, more, "K"))
            at = after
    return tuple(found)


class Node:
    """One row's edits on a way through the rows; nodes count what follows them, so dead ways are cut at once."""

    __slots__ = ("before", "edits", "later", "refs")

    def __init__(self, before: Node | None, edits: str):
        self.before, self.edits, self.refs, self.later = before, edits, 0, None
        if before is not None:
            before.refs += 1
            before.later = self  # of a node with one follower: that follower


class Survivors:
    """The best way to each state, and the edits that all of them share, which are settled.

    Ways are compared by cost, then by their edits as strings. All ways to the same row end with an edit of that row, so none is the
    beginning of another, and the order of two ways stays once it is known: a survivor carries its rank among the survivors, which is
    that of its whole unresolved string, and candidates compare by (cost, rank, edits of this row).
    """

    def __init__(self):
        self.root = Node(None, "")
        self.best: dict[int, tuple[int, int, Node]] = {START: (0, 0, self.root)}
        self.root.refs = 1

    def _drop(self, node: Node) -> None:
        """Give up a way back to where another one branches off."""
        node.refs -= 1
        while not node.refs and node.before is not None:
            node, gone = node.before, node
            node.refs -= 1
            gone.before = None

    def step(self, initial: str, fault: str) -> list[str]:
        """Take a row in; returns the edits of the rows that are settled by it, oldest first."""
        found: dict[int, tuple[int, int, str, Node]] = {}
        for state, after, cost, edits in moves(initial, fault):
            own = self.best.get(state)
            if own is not None:
                way = (own[0] + cost, own[1], edits)
                if after not in found or way < found[after][:3]:
                    found[after] = (*way, own[2])
        for (state, other), most in REACH.items():
            if state in found and other in found and found[other][0] + most < found[state][0]:
                del found[state]
        order = sorted(found, key=lambda s: found[s][1:3])
        nodes = {s: Node(found[s][3], found[s][2]) for s in found}
        before = [own[2] for own in self.best.values()]
        self.best = {s: (found[s][0], order.index(s), nodes[s]) for s in found}
        for node in nodes.values():
            node.refs += 1
        for node in before:
            self._drop(node)
        return self._settle()

    def _settle(self) -> list[str]:
        settled = []
        while self.root.refs == 1 and (then := self._only()) is not None:
            settled.append(then.edits)
            then.before, self.root = None, then
        return settled

    def _only(self) -> Node | None:
        """What alone follows the root; none where the root is a survivor itself."""
        if any(own[2] is self.root for own in self.best.values()):
            return None
        then = self.root.later
        if then is not None and then.before is self.root:
            return then
        # The latest follower was given up: mark the way to a survivor once.
        node = next(iter(self.best.values()))[2]
        while node is not self.root:
            node.before.later, then = node, node
            node = node.before
        return then

    def end(self) -> tuple[int, list[str], str]:
        """The cost, the edits of all unsettled rows and the inserts after the last one, of the best legal way."""
        state = min(self.best, key=lambda s: (self.best[s][0] + INSERT * len(ENDINGS[s]), self.best[s][1]))
        cost, _, node = self.best[state]
        rest = []
        while node is not self.root:
            rest.append(node.edits)
            node = node.before
        return cost + INSERT * len(ENDINGS[state]), rest[::-1], ENDINGS[state]


class Repair:
    """Edits of one conversation as its rows come in; holds only rows whose edits aren't settled."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.ways, self.waiting, self.done = conv_id, START, Survivors(), [], 0

    def row(self, turn: int | None, role: str, text: str, fault: str) -> Iterator[tuple]:
        initial = role[:1]
        self.waiting.append((turn, role, text, initial, fault))
        settled = self.ways.step(initial if initial in "sua" else "", fault)
        for edits, row in zip(settled, self.waiting, strict=False):
            yield from self._written(edits, row)
        del self.waiting[: len(settled)]

    def _inserted(self) -> tuple:
        role, self.state = NEXT[self.state]
        return (self.conv_id, "I", ROLES[role], "", None, None, None, INSERT, False)

    def _written(self, edits: str, row: tuple) -> Iterator[tuple]:
        turn, role, text, initial, fault = row
        for _ in edits[:-1]:
            yield self._inserted()
        edit, more = edits[-1], TRUNCATED if fault == "truncated" else 0
        if edit == "D":
            yield (self.conv_id, "D", None, None, turn, initial, fault, DELETE, False)
        elif edit == "R":
            role, self.state = NEXT[self.state]
            yield (self.conv_id, "R", ROLES[role], text, turn, initial, fault, REROLE + more, False)
        else:
            self.state = SYSTEM if initial == "s" else NEXT[self.state][1]
            yield (self.conv_id, "K", role, text, turn, initial, fault, more, False)

    def end(self) -> Iterator[tuple]:
        _, rest, ending = self.ways.end()
        for edits, row in zip(rest, self.waiting, strict=True):
            yield from self._written(edits, row)
        for _ in ending:
            yield self._inserted()
        yield (self.conv_id, None, None, None, None, None, None, 0, True)


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and fault (blank, duplicate, truncated or null), each conversation whole and in order in one partition.

    Rows go by turn, null first; rows of one turn by role, then text. Only the first of a conversation's rows with the same role and
    text is none's duplicate. One shuffle by conversation serves the numbering and the order; both sorts spill.
    """
    order = [F.col("turn").asc_nulls_first()]
    own = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(*order)) > 1
    body = F.btrim("text", F.lit(WHITE))
    fault = F.when(body == "", "blank").when(F.col("again"), "duplicate").when(~F.right(body, F.lit(1)).isin(*STOPS), "truncated")
    judged = own.withColumn("again", again).withColumn("fault", fault)
    return judged.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order, "role", "text", "again").drop("again")


def repair(conversations: DataFrame) -> DataFrame:
    """The edits of every conversation in order, by which its roles become `(s?(ua)+)?` at the least cost, ties to the lesser string of edits.

    Takes conv_id, turn, role and text (further columns are left out) and gives, a row an edit: edit (K keep, R rerole, D delete, I insert);
    role and text as repaired (null where deleted, empty text where inserted); turn, initial and fault of the row it edits (null for inserts);
    cost. After a conversation's edits comes a row with last = true. The edits of a conversation lie in one
    partition, in order, so what reads them there needs no shuffle.

    Costs: keep 0, rerole to user or assistant 2, delete 3, insert a user or assistant with empty text 2; rows that are blank (no character but
    white space) or duplicates (role and text seen earlier in the conversation) have to be deleted; a kept or reroled row whose
    last character but white space is none of `.!?` costs 1 more. Null roles and texts are one space; a null conv_id is a conversation of its own; rows with a null turn come first, rows that
    share a turn go by role and text; an empty table gives an empty one.

    A conversation streams through its task: a row is held until all surviving ways have the same edit for it, and ways that can't win or
    tie any more are given up at once, so memory follows the unresolved rows, not the conversation.
    """
    small_batches(conversations.sparkSession)
    space = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *space)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Repair | None = None
        for batch in text_batches(batches):
            out = []
            for conv_id, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                if own is None or own.conv_id != conv_id:
                    out += own.end() if own else ()
                    own = Repair(conv_id)
                out += own.row(turn, role, text, fault)
            if out:
                yield _batch(out)
        if own:
            yield _batch(list(own.end()))

    return faults(rows).mapInArrow(edited, EDITS)


_FIELDS = pa.schema(
    [("conv_id", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("turn", pa.int64())]
    + [("initial", pa.string()), ("fault", pa.string()), ("cost", pa.int64()), ("last", pa.bool_())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


LEGAL_NEIGHBOURS = ("su", "ua", "au")
DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def digest(edits: DataFrame) -> DataFrame:
    """A row a conversation from its edits: what was wrong, the cost, the edits' initials and the hash of what stays (`role:text`, newline-joined)."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def begun() -> dict:
            return {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "kept": 0, "first": None, "turn": None, "turns": 0, "initial": None}

        own = begun()
        for batch in batches:
            out = []
            for conv_id, edit, role, text, turn, initial, fault, cost, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last:
                    gaps = own["turn"] - own["first"] + 1 - own["turns"] if own["turns"] else 0
                    out.append((conv_id, gaps, *(own[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(own["audit"]), own["hash"].hexdigest()))
                    own = begun()
                    continue
                own["audit"].append(edit)
                own["cost"] += cost
                if edit != "D":
                    own["hash"].update((f"\n{role}:{text}" if own["kept"] else f"{role}:{text}").encode())
                    own["kept"] += 1
                if edit == "I":
                    continue
                if fault:
                    own[fault] += 1
                if own["initial"] is not None:
                    own["illegal"] += own["initial"] + initial not in LEGAL_NEIGHBOURS
                own["initial"] = initial
                if turn is not None:
                    own["turns"] += turn != own["turn"]
                    own["first"], own["turn"] = turn if own["first"] is None else own["first"], turn
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return edits.mapInArrow(digested, DIGEST)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by the checksum of `conv_id:turn`, modulo 20: 0 drops a row, 1 empties it, 2 takes its `.!?`, 3 repeats it, 4 makes it the user's.

    Nulls are one space, in the checksum's text too; conv_id and turn stay as they are.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("kind", F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20).filter("kind <> 0")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, STOPS, "")).otherwise(text)
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, edits and repaired hash of every conversation after damage; edge cases as in repair, without rows zeros and empty strings."""
    given = pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    given = given.withColumn("conv_id", F.col("conv_id").cast("long"))
    found = digest(repair(damaged(given)))
    every = given.select(F.col("conv_id").alias("id")).distinct()
    joined = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


OP13_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM range(256) t(i)
),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
  FROM conversations
),
kinds AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM named, crc_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
),
judged AS (
  SELECT *, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS body
  FROM damaged
),
rows_in AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS neighbours
  FROM judged
),
inserts(state, k, reached, lines) AS (
  VALUES (0, 0, 0, []), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
    (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])
),
edits(edit) AS (VALUES ('D'), ('K'), ('R')),
ways AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM conversations
  UNION ALL
  SELECT conv_id, n, state, cost, audit, lines FROM (
    SELECT w.conv_id, r.n, CASE WHEN edit = 'D' THEN reached WHEN edit = 'K' AND initial = 's' THEN 1 WHEN reached = 2 THEN 3 ELSE 2 END AS state,
      w.cost + 2 * k + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
      w.audit || repeat('I', k) || edit AS audit,
      list_concat(w.lines, i.lines, CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE reached WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END) AS lines
    FROM ways w JOIN rows_in r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = w.n + 1 JOIN inserts i ON i.state = w.state CROSS JOIN edits
    WHERE edit = 'D' OR (coalesce(fault, '') NOT IN ('blank', 'duplicate')
      AND (edit = 'R' OR initial = CASE reached WHEN 2 THEN 'a' ELSE 'u' END OR (initial = 's' AND reached = 0)))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
),
ended AS (
  SELECT w.conv_id, cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost, audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    list_concat(lines, CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END) AS lines
  FROM ways w JOIN (SELECT c.conv_id, count(r.n) AS rows FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rows_in r ON c.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY 1) s
    ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.n = s.rows
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, w.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END) = 1
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (neighbours NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_in GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, e.cost AS cost, e.audit AS audit, sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
