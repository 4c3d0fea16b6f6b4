"""Conversation structure repair: the cheapest edits that make the roles legal, with an audit of every edit.

A dynamic programme walks over the rows of a conversation and keeps, for each place in the grammar ``(s?(ua)+)?``, the cheapest
edits so far; among equally cheap ones the audit that comes first.  Audits are linked nodes that share their
prefixes: a node knows its ancestors 1, 2, 4, 8 … steps up and a rolling hash of the whole audit, so two audits are compared
by a binary search for their longest common prefix, and the letters decide.  Equal hashes are verified letter by
letter.  What all places have in common is settled from time to time, so the nodes in memory are those that still differ.

Letters of an audit: ``K`` keep, ``R`` give another role, ``D`` delete, ``I`` insert an empty turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.llm.common import materialize, table

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows between two attempts to settle the common beginning of all audits.
SETTLE = 1024

_MODULUS = (1 << 61) - 1
_BASE = 0x1B873593CC9E2D51
#: Places in the grammar, and where an initial leads from each; the role that a changed or inserted turn gets there.
START, SYSTEM, USER, ASSISTANT = range(4)
_MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_ROLE = ("user", "user", "assistant", "user")
_INTO = (USER, USER, ASSISTANT, USER)


class Node:
    """The last letter of an audit; the letters before are its ancestors."""

    __slots__ = ("up", "letter", "depth", "hash")

    def __init__(self, parent: Node | None = None, letter: str = "") -> None:
        self.letter = letter
        if parent is None:
            self.up, self.depth, self.hash = (), 0, 0
            return
        up = [parent]
        while len(up[-1].up) >= len(up):
            up.append(up[-1].up[len(up) - 1])
        self.up, self.depth = tuple(up), parent.depth + 1
        self.hash = (parent.hash * _BASE + ord(letter)) % _MODULUS

    def letters(self) -> str:
        found, node = [], self
        while node.up:
            found.append(node.letter)
            node = node.up[0]
        return "".join(reversed(found))


def lifted(node: Node, depth: int) -> Node:
    """The ancestor at a depth."""
    steps = node.depth - depth
    while steps:
        k = steps.bit_length() - 1
        node, steps = node.up[k], steps - (1 << k)
    return node


def same(x: Node, y: Node) -> bool:
    """Whether two audits of one length are the same: up to where they are one node."""
    while x is not y:
        if x.letter != y.letter:
            return False
        x, y = x.up[0], y.up[0]
    return True


def first(a: Node, b: Node) -> bool:
    """Whether the audit of ``a`` comes before that of ``b``."""
    depth = min(a.depth, b.depth)
    x, y = lifted(a, depth), lifted(b, depth)
    if x.hash == y.hash:
        return a.depth < b.depth if same(x, y) else a.letters() < b.letters()
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if same(x.up[0], y.up[0]):
        return x.letter < y.letter
    return a.letters() < b.letters()


def _common(nodes: list[Node]) -> Node:
    """The last node that all audits share."""
    depth = min(n.depth for n in nodes)
    x = lifted(nodes[0], depth)
    for other in nodes[1:]:
        y = lifted(other, x.depth)
        while x is not y:
            k = next((k for k in reversed(range(len(x.up))) if x.up[k] is not y.up[k]), None)
            x, y = (x.up[0], y.up[0]) if k is None else (x.up[k], y.up[k])
    return x


class Repair:
    """The programme over one conversation; rows come in order, as (initial of the role, must go, truncated)."""

    def __init__(self) -> None:
        self.settled: list[str] = []
        self.rows = 0
        self.best: list[tuple[int, Node] | None] = [(0, Node()), None, None, None]
        self._insert()

    def _offer(self, layer: list, place: int, cost: int, parent: Node, letter: str) -> None:
        held = layer[place]
        if held is not None and held[0] < cost:
            return
        node = Node(parent, letter)
        if held is None or cost < held[0] or first(node, held[1]):
            layer[place] = (cost, node)

    def _insert(self) -> None:
        for place in (START, SYSTEM, ASSISTANT, USER):
            if self.best[place] is not None:
                cost, node = self.best[place]
                self._offer(self.best, _INTO[place], cost + INSERT, node, "I")

    def add(self, initial: str, must_go: bool, truncated: bool) -> None:
        layer: list[tuple[int, Node] | None] = [None] * 4
        extra = TRUNCATED if truncated else 0
        for place, held in enumerate(self.best):
            if held is None:
                continue
            cost, node = held
            self._offer(layer, place, cost + DELETE, node, "D")
            if must_go:
                continue
            if initial in _MOVES[place]:
                self._offer(layer, _MOVES[place][initial], cost + extra, node, "K")
            self._offer(layer, _INTO[place], cost + REROLE + extra, node, "R")
        self.best = layer
        self._insert()
        self.rows += 1
        if self.rows % SETTLE == 0:
            self._settle()

    def _settle(self) -> None:
        live = [held[1] for held in self.best if held is not None]
        root = _common(live)
        if 2 * root.depth < max(n.depth for n in live):
            return
        self.settled.append(root.letters())
        fresh = {id(root): Node()}

        def renewed(node: Node) -> Node:
            chain = []
            while id(node) not in fresh:
                chain.append(node)
                node = node.up[0]
            for x in reversed(chain):
                fresh[id(x)] = Node(fresh[id(x.up[0])], x.letter)
            return fresh[id(chain[0])] if chain else fresh[id(node)]

        self.best = [held and (held[0], renewed(held[1])) for held in self.best]

    def result(self) -> tuple[int, str]:
        """Cost and audit of the cheapest repair, which leaves nothing or ends after an assistant turn."""
        (cost, node), other = self.best[START], self.best[ASSISTANT]
        if other is not None and (other[0] < cost or other[0] == cost and first(other[1], node)):
            cost, node = other
        return cost, "".join(self.settled) + node.letters()


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that a checksum of conversation and turn asks for.

    Null roles and texts become one space, and so do null ids and turns in the checksum.  By the checksum's rest at 20: 0 drops the row,
    1 empties the text, 2 removes its full stops, exclamation and question marks, 3 repeats the row, 4 makes it the user's.
    """
    def spaced(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("_f"))
    text = F.when(F.col("_f") == 1, "").when(
        F.col("_f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_f") == 3, 2).otherwise(1)
    return rows.where("_f != 0").select(
        "conv_id", "turn", F.when(F.col("_f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_copy"),
    ).drop("_copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows with what puts them in order; null roles and texts are one space, as in :func:`damaged`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
        F.unhex(F.md5(text)).alias("_key"),
    )


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LEGAL = {"su", "ua", "au"}


class _Audit:
    """What is counted over one conversation, row by row."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.turns = 0
        self.least = self.most = self.before = None

    def add(self, turn, initial: str, fault: str | None) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if self.before is not None and self.before + initial not in _LEGAL:
            self.illegal += 1
        self.before = initial
        if fault:
            self.faults[fault] += 1
        self.repair.add(initial, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self, conv) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        cost, audit = self.repair.result()
        return (conv, gaps, *self.faults.values(), self.illegal, cost, audit)


def _audit_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, audit, kind = None, None, None

    def packed(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:-1]], pa.array(columns[-1], pa.string())],
            names=["conv_id", *_COUNTS, "audit"],
        )

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for conv, turn, initial, fault in zip(*[c.to_pylist() for c in batch.columns]):
            if audit is None or conv != current:
                if audit is not None:
                    done.append(audit.row(current))
                current, audit = conv, _Audit()
            audit.add(turn, initial, fault)
        if done:
            yield packed(done)
    if audit is not None:
        yield packed([audit.row(current)])


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    Rows of a conversation stand by turn, null turns first, those of one turn by role and by the checksum of the text.  A row's
    fault is the first that holds: blank (nothing but white space), duplicate (role and text stood
    before), truncated (its last character that isn't white space is none of ``.!?``).  ``illegal`` counts neighbours whose roles' first letters
    aren't su, ua or au; ``gaps`` the turn numbers that are missing.  ``cost`` and ``audit`` are those of the cheapest edits
    after which the first letters are ``(s?(ua)+)?``; a role without a letter of these is never kept.  Null roles and texts
    are one space; a null id is a conversation; an empty table gives an empty result; other columns aren't looked at.

    Faults are found before Python sees a row, which gets a letter and a word of it.  An audit needs its rows in order,
    so a conversation streams sorted through one task; what grows with it there is the audit itself, a byte a row.
    """
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    rows = _ordered(turns).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "_key", last.alias("_last")
    ).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "_key").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = (
        F.when(F.col("_last") == "", "blank").when(F.col("_again"), "duplicate")
        .when(~F.col("_last").isin(".", "!", "?"), "truncated")
    )
    kind = turns.schema["conv_id"].dataType.simpleString()
    return (
        rows.withColumn("_again", again)
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "_key", "_again")
        .select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
        .mapInArrow(_audit_batches, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")
    )


def _repair_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, audit, role, text), the row with the audit first, to the turns that the audit leaves."""
    conv, audit, at, place, position = None, "", 0, START, 0
    for batch in batches:
        out: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal place, position
            out.append((conv, position, role, text))
            place, position = _MOVES[place][role[0]], position + 1

        def inserted() -> None:
            nonlocal at
            while audit[at: at + 1] == "I":
                put(_ROLE[place], "")
                at += 1

        for now, edits, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if edits is not None:
                conv, audit, at, place, position = now, edits, 0, START, 0
                inserted()
                continue
            letter, at = audit[at], at + 1
            if letter == "K":
                put(role, text)
            elif letter == "R":
                put(_ROLE[place], text)
            inserted()
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
                names=["conv_id", "position", "role", "text"],
            )


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, position, role, text``: the turns after the edits of ``found`` (of :func:`audits` over the same turns).

    The rows of each partition come out by conversation and position.  Texts stream; an audit is held at a time.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = _ordered(turns).select(
        "conv_id", F.lit(None).cast("string").alias("audit"), F.col("turn").cast("long").alias("turn"), "role", "text", "_key"
    )
    heads = found.select(
        "conv_id", "audit", *[F.lit(None).cast(t).alias(c) for c, t in
                              (("turn", "long"), ("role", "string"), ("text", "string"), ("_key", "binary"))],
    )
    return (
        rows.unionByName(heads).repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "_key")
        .select("conv_id", "audit", "role", "text")
        .mapInArrow(_repair_batches, f"conv_id {kind}, position long, role string, text string")
    )


def _digest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, digest, kind = None, None, None

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in rows], kind), pa.array([d for _, d in rows], pa.string())],
            names=["conv_id", "repaired_sha256"],
        )

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for conv, position, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if position == 0:
                if digest is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield packed(done)
    if digest is not None:
        yield packed([(current, digest.hexdigest())])


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of what :func:`repaired_turns` returned, while it streams by."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.mapInArrow(_digest_batches, f"conv_id {kind}, repaired_sha256 string")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(damaged(given), given)


def repair_report(turns: DataFrame, given: DataFrame) -> DataFrame:
    """:func:`audits` and the digest of the repaired turns for every conversation of ``given``, also those without turns."""
    found = materialize(audits(turns), "repair-audits")
    hashed = digests(repaired_turns(turns, found))
    convs = given.select(F.col("conv_id").alias("_conv")).distinct()
    report = convs.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    report = report.join(hashed, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    nothing = hashlib.sha256().hexdigest()
    return report.select(
        F.col("_conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


#: The checksum is followed byte by byte; the programme keeps the least (cost, audit) of each place row by row.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS rest, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN rest & 1 = 1 THEN xor(rest >> 1, 3988292384) ELSE rest >> 1 END, step + 1 FROM bits WHERE step < 8
), rests AS (SELECT i, rest FROM bits WHERE step = 8),
given AS (
  SELECT row_number() OVER () AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), walk AS (
  SELECT k, name, 1 AS at, CAST(4294967295 AS BIGINT) AS crc FROM given
  UNION ALL
  SELECT w.k, w.name, w.at + 1, xor(w.crc >> 8, r.rest)
  FROM walk w JOIN rests r ON w.at <= length(w.name) AND r.i = xor(w.crc & 255, unicode(substr(w.name, w.at, 1)))
), faulty AS (
  SELECT g.*, xor(w.crc, 4294967295) % 20 AS f FROM given g JOIN walk w ON w.k = g.k AND w.at = length(g.name) + 1
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM faulty)
), placed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS c, substr(role, 1, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM damaged
), rows_ AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated'
            ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS step FROM placed
), moves(place, initial, next) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
best AS (
  SELECT c, CAST(0 AS BIGINT) AS i, place, x FROM (SELECT DISTINCT c FROM rows_), (VALUES
    ('', {'cost': 0, 'audit': '', 'out': CAST([] AS VARCHAR[])}), ('u', {'cost': 2, 'audit': 'I', 'out': ['user:']}),
    ('a', {'cost': 4, 'audit': 'II', 'out': ['user:', 'assistant:']})) t(place, x)
  UNION ALL
  SELECT c, i, place, min(x) FROM (
    WITH edited AS (
      SELECT b.c, r.i, b.place, {'cost': b.x.cost + 3, 'audit': b.x.audit || 'D', 'out': b.x.out} AS x
      FROM best b JOIN rows_ r ON r.c = b.c AND r.i = b.i + 1
      UNION ALL
      SELECT b.c, r.i, m.next, {'cost': b.x.cost + CAST(r.fault = 'truncated' AS INT), 'audit': b.x.audit || 'K',
                                'out': list_append(b.x.out, r.role || ':' || r.text)}
      FROM best b JOIN rows_ r ON r.c = b.c AND r.i = b.i + 1 JOIN moves m ON m.place = b.place AND m.initial = r.initial
      WHERE r.fault IN ('', 'truncated')
      UNION ALL
      SELECT b.c, r.i, m.next, {'cost': b.x.cost + 2 + CAST(r.fault = 'truncated' AS INT), 'audit': b.x.audit || 'R',
             'out': list_append(b.x.out, CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text)}
      FROM best b JOIN rows_ r ON r.c = b.c AND r.i = b.i + 1 JOIN moves m ON m.place = b.place AND m.initial <> 's'
      WHERE r.fault IN ('', 'truncated')
    )
    SELECT * FROM edited
    UNION ALL
    SELECT c, i, m.next, {'cost': x.cost + 2, 'audit': x.audit || 'I',
                          'out': list_append(x.out, CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END)}
    FROM edited e JOIN moves m ON m.place = e.place AND m.initial <> 's'
    UNION ALL
    SELECT c, i, 'a', {'cost': x.cost + 4, 'audit': x.audit || 'II', 'out': list_concat(x.out, ['user:', 'assistant:'])}
    FROM edited WHERE place <> 'u'
  ) GROUP BY c, i, place
), done AS (
  SELECT b.c, min(b.x) AS x FROM best b JOIN (SELECT c, max(i) AS n FROM rows_ GROUP BY c) s ON s.c = b.c AND s.n = b.i
  WHERE b.place IN ('', 'a') GROUP BY b.c
), counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY c
)
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(d.x.cost, 0) AS BIGINT) AS cost,
       coalesce(d.x.audit, '') AS audit, sha256(coalesce(array_to_string(d.x.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS c FROM conversations) g
LEFT JOIN counts USING (c) LEFT JOIN done d USING (c)
"""
