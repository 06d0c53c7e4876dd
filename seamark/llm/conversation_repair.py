"""Repair of the role structure of conversations by generalised LR parsing.

The role grammar (an optional system turn, then pairs of user and assistant) is
turned into SLR tables. A conversation's rows are read in turn order while a
graph-structured stack holds every parse that some edits allow: rows are kept,
given another role or deleted, and turns are inserted, each at a price. Stacks
are shared nodes (state, rest of the stack), so parses with equal stacks meet in
one node, where the least (cost, audit) stays. Both parts grow from the left and
equal costs never stand with audits of which one begins the other, so what is
least for a stack is least for all that follows.

Spark deals conversations to tasks and sorts their rows; faults are columns of
windows. A task streams the rows: once all stacks agree on the edits of the
rows so far, these are handed on, so it holds a batch and the rows still open,
however long a conversation is.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_SPACE = " \t\n\x0b\x0c\r"
#: An optional system turn, then pairs; terminals are the initials of roles.
ROLE_GRAMMAR = (("turns", ()), ("turns", ("pairs",)), ("turns", ("s", "pairs")), ("pairs", ("u", "a")), ("pairs", ("pairs", "u", "a")))
#: Roles that a row can be given and that a new turn can have, by their initials.
ROLES = {"u": "user", "a": "assistant"}
#: Undecided edits after which stacks are asked what they agree on.
OPEN_EDITS = 64
#: Output rows and bytes of text in a batch.
BATCH_ROWS, BATCH_BYTES = 4096, 1 << 22


@dataclass(frozen=True)
class Prices:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


class Tables:
    """SLR tables of a grammar: ``actions`` by (state, terminal), ``gotos`` by (state, symbol). ``$`` ends the input."""

    def __init__(self, rules: tuple[tuple[str, tuple[str, ...]], ...]):
        self.rules = (("", (rules[0][0],)), *rules)
        heads = {head for head, _ in self.rules}
        follow = self._follow(heads)
        states = [self._closed({(0, 0)}, heads)]
        self.gotos: dict[tuple[int, str], int] = {}
        self.actions: dict[tuple[int, str], tuple[str, int]] = {}
        for k, items in enumerate(states):  # grows while it is read
            for symbol in sorted({self.rules[r][1][dot] for r, dot in items if dot < len(self.rules[r][1])}):
                to = self._closed({(r, dot + 1) for r, dot in items if self.rules[r][1][dot : dot + 1] == (symbol,)}, heads)
                if to not in states:
                    states.append(to)
                self.gotos[k, symbol] = states.index(to)
                if symbol not in heads:
                    self._put(k, symbol, ("shift", states.index(to)))
            for r, dot in items:
                head, body = self.rules[r]
                if dot == len(body):
                    for terminal in follow[head]:
                        self._put(k, terminal, ("reduce", r) if r else ("accept", 0))

    def _put(self, state: int, terminal: str, action: tuple[str, int]) -> None:
        if self.actions.setdefault((state, terminal), action) != action:
            raise ValueError(f"the grammar has a conflict at {terminal!r}")

    def _closed(self, items: set[tuple[int, int]], heads: set[str]) -> frozenset[tuple[int, int]]:
        waiting = list(items)
        while waiting:
            r, dot = waiting.pop()
            for symbol in self.rules[r][1][dot : dot + 1]:
                new = {(k, 0) for k, (head, _) in enumerate(self.rules) if head == symbol} - items
                items |= new
                waiting += new
        return frozenset(items)

    def _follow(self, heads: set[str]) -> dict[str, set[str]]:
        empty: set[str] = set()
        first: dict[str, set[str]] = {h: set() for h in heads}
        follow: dict[str, set[str]] = {h: set() for h in heads} | {"": {"$"}}
        changed = True
        while changed:
            was = (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))
            for head, body in self.rules:
                if all(x in empty for x in body):
                    empty.add(head)
                for x in body:
                    first[head] |= first.get(x, {x})
                    if x not in empty:
                        break
                after = set(follow[head])
                for x in reversed(body):
                    if x in heads:
                        follow[x] |= after
                        after = first[x] | (after if x in empty else set())
                    else:
                        after = {x}
            changed = was != (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))
        return follow


class Stacks:
    """Shared stack nodes; ``after`` and ``accepts`` are found once for each node."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.number = {self.nodes[0]: 0}
        self.known: dict[tuple[int, str], int | None] = {}

    def _push(self, state: int, below: int) -> int:
        node = (state, below)
        if node not in self.number:
            self.number[node] = len(self.nodes)
            self.nodes.append(node)
        return self.number[node]

    def after(self, node: int, terminal: str) -> int | None:
        """The node once ``terminal`` is shifted (``$``: accepted); None where the grammar does not allow it."""
        at = (node, terminal)
        if at not in self.known:
            self.known[at] = self._read(node, terminal)
        return self.known[at]

    def _read(self, node: int, terminal: str) -> int | None:
        while True:
            kind, arg = self.tables.actions.get((self.nodes[node][0], terminal), ("error", 0))
            if kind == "shift":
                return self._push(arg, node)
            if kind != "reduce":
                return node if kind == "accept" else None
            head, body = self.tables.rules[arg]
            for _ in body:
                node = self.nodes[node][1]
            node = self._push(self.tables.gotos[self.nodes[node][0], head], node)


class Repair:
    """The edits of one conversation, row by row."""

    def __init__(self, stacks: Stacks, prices: Prices):
        self.stacks, self.prices = stacks, prices
        # what one stack can still do any other can do for two more inserted turns and a deleted system turn
        self.reach = 2 * prices.insert + prices.delete
        #: node: (cost, audit, the initials that edits lead to), of what is not handed on yet
        self.tops: dict[int, tuple[int, str, str]] = {0: (0, "", "")}

    def _insert(self) -> None:
        waiting = list(self.tops)
        while waiting:
            node = waiting.pop()
            cost, audit, roles = self.tops[node]
            for role in ROLES:
                to = self.stacks.after(node, role)
                new = (cost + self.prices.insert, audit + "I", roles + role)
                if to is not None and (to not in self.tops or new < self.tops[to]):
                    self.tops[to] = new
                    waiting.append(to)

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        self._insert()
        more = self.prices.truncated if truncated else 0
        tops: dict[int, tuple[int, str, str]] = {}

        def offer(to: int | None, new: tuple[int, str, str]) -> None:
            if to is not None and (to not in tops or new < tops[to]):
                tops[to] = new

        for node, (cost, audit, roles) in self.tops.items():
            offer(node, (cost + self.prices.delete, audit + "D", roles + "-"))
            if not must_go:
                offer(self.stacks.after(node, initial), (cost + more, audit + "K", roles + initial))
                for role in ROLES:
                    offer(self.stacks.after(node, role), (cost + self.prices.rerole + more, audit + "R", roles + role))
        most = min(cost for cost, _, _ in tops.values()) + self.reach
        self.tops = {node: top for node, top in tops.items() if top[0] <= most}

    def agreed(self) -> tuple[str, str]:
        """The edits that all stacks share, with the initials they lead to; later calls go on from there."""
        k = min(len(os.path.commonprefix([top[i] for top in self.tops.values()])) for i in (1, 2))
        _, audit, roles = next(iter(self.tops.values()))
        self.tops = {node: (cost, a[k:], r[k:]) for node, (cost, a, r) in self.tops.items()}
        return audit[:k], roles[:k]

    def undecided(self) -> int:
        return min(len(audit) for _, audit, _ in self.tops.values())

    def end(self) -> tuple[str, str]:
        self._insert()
        return min(top for node, top in self.tops.items() if self.stacks.after(node, "$") is not None)[1:]


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (``conv``, ``turn``, ``role``, ``text``) with ``fault``, ``illegal`` and ``new_turn``, sorted in partitions by conversation and turn."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("nth")]
    nth = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    dealt = rows.repartition("conv").withColumn("nth", nth)
    shown = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    first = F.when(F.length(shown) == 0, "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated")
    own = Window.partitionBy("conv").orderBy(*order)
    pair = F.concat(F.lag(F.substring("role", 1, 1)).over(own), F.substring("role", 1, 1))
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(own))
    marked = dealt.withColumn("fault", first)
    marked = marked.withColumns({"illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)), "new_turn": new_turn})
    return marked.sortWithinPartitions("conv", *order)


def _edits(rows: Iterable[tuple], prices: Prices) -> Iterator[tuple]:
    """Output rows of sorted input rows (conv, turn, role, text, fault, illegal, new_turn)."""
    stacks = Stacks(Tables(ROLE_GRAMMAR))
    conv, repair, held, seq = None, None, [], 0

    def told(edits: tuple[str, str]) -> Iterator[tuple]:
        nonlocal seq
        at = 0
        for action, initial in zip(*edits):
            seq += 1
            if action == "I":
                yield (conv, seq, action, ROLES[initial], "", prices.insert, None, None, None, False, False)
                continue
            turn, role, text, fault, illegal, new_turn = held[at]
            at += 1
            cost = prices.delete if action == "D" else (prices.rerole if action == "R" else 0) + (prices.truncated if fault == "truncated" else 0)
            yield (conv, seq, action, ROLES[initial] if action == "R" else role, text, cost, fault, role, turn, illegal, new_turn)
        del held[:at]

    for row in rows:
        if repair is None or row[0] != conv:
            if repair is not None:
                yield from told(repair.end())
            conv, repair, held, seq = row[0], Repair(stacks, prices), [], 0
        held.append(row[1:])
        _, _, role, _, fault, _, _ = row
        repair.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        if repair.undecided() >= OPEN_EDITS:
            yield from told(repair.agreed())
    if repair is not None:
        yield from told(repair.end())


def repair(turns: DataFrame, prices: Prices = Prices(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations, one row per edit: the conversation's id, ``seq``, ``action``, ``role``, ``text``, ``cost``, ``fault``, ``was``, ``turn``, ``illegal``, ``new_turn``.

    Rows of a conversation are taken by turn (nulls first; ties by role and
    text). ``action`` is K (kept), R (given another role; ``was`` has the old
    one), D (deleted, and no part of the repaired conversation) or I (inserted,
    with an empty text). The edits are the cheapest that lead to the role
    grammar, and of these the first in ASCII order. ``fault`` is the first of
    blank, duplicate (role and text seen before in the conversation) and
    truncated (no ``.``, ``!`` or ``?`` at the end); blank and duplicate rows
    are deleted, truncated ones cost more unless deleted. ``illegal`` marks a
    row whose initial may not follow the one before it, ``new_turn`` the first
    row of a turn. Null roles and texts count as one space, a null id is a
    conversation of its own, an empty role has no initial and fits nowhere. An
    empty table gives an empty result; other columns are not read.
    """
    space = F.lit(" ")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"))
    kind = rows.schema["conv"].dataType
    fields = [("conv", kind), ("seq", T.LongType()), ("action", T.StringType()), ("role", T.StringType()), ("text", T.StringType()), ("cost", T.LongType()), ("fault", T.StringType()), ("was", T.StringType()), ("turn", T.LongType()), ("illegal", T.BooleanType()), ("new_turn", T.BooleanType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type = None

        def rows_of() -> Iterator[tuple]:
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns))

        text = pa.string()
        waiting: list[tuple] = []
        room = BATCH_BYTES

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            types = [conv_type, pa.int64(), text, text, text, pa.int64(), text, text, pa.int64(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[n for n, _ in fields])

        for out in _edits(rows_of(), prices):
            waiting.append(out)
            room -= len(out[4])
            if len(waiting) >= BATCH_ROWS or room < 0:
                yield batch_of(waiting)
                waiting, room = [], BATCH_BYTES
        if waiting:
            yield batch_of(waiting)

    return faults(rows).select("conv", "turn", "role", "text", "fault", "illegal", "new_turn").mapInArrow(edit, schema).withColumnRenamed("conv", conv_col)


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with known faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of
    it, 3 repeats the row, 4 makes it the user's. Nulls count as one space.
    """
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    hurt = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    hurt = hurt.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return hurt.drop("copy")


def digest(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation of ``conversations``: counts of faults, cost, audit and the SHA-256 of the repaired turns.

    ``repaired`` comes from ``repair``. The audit and the hash are of a whole
    conversation, so its rows meet in one group. A conversation without rows
    has zeros, an empty audit and the hash of the empty string.
    """

    def count(what: Column) -> Column:
        return F.count_if(what)

    edits = F.array_sort(F.collect_list(F.struct("seq", "action", "role", "text")))
    per = repaired.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("new_turn")), F.lit(0)).alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
        F.sum("cost").alias("cost"),
        edits.alias("edits"),
    )
    lines = F.transform(F.filter("edits", lambda e: e["action"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    per = per.select(
        F.col("conv_id").alias("conv"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        F.array_join(F.transform("edits", lambda e: e["action"]), "").alias("audit"),
        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )
    every = conversations.select("conv_id").distinct()
    full = every.join(per, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return full.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def oracle() -> str:
    """SQL of ``digest(repair(damage(conversations)), conversations)``: the cheapest edits by states of the grammar, row by row."""
    return r"""
        WITH RECURSIVE
        tab AS MATERIALIZED (
            SELECT list_transform(range(256), lambda n: list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t),
        raw AS MATERIALIZED (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        kinds AS (
            SELECT raw.*, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT),
                                      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM raw, tab),
        hurt AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM kinds, range(2) AS copies(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)),
        placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
        told AS (
            SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM placed),
        faulty AS MATERIALIZED (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
                           WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM told),
        -- states: e nothing yet, s after the system turn, u a user waits, a whole pairs
        moves(was, role, state) AS (VALUES ('e', 's', 's'), ('e', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
        filled(was, state, names) AS (
            VALUES ('e', 'e', []::VARCHAR[]), ('s', 's', []), ('u', 'u', []), ('a', 'a', []), ('e', 'u', ['user:']), ('s', 'u', ['user:']), ('a', 'u', ['user:']),
                   ('u', 'a', ['assistant:']), ('e', 'a', ['user:', 'assistant:']), ('s', 'a', ['user:', 'assistant:'])),
        edits AS MATERIALIZED (
            SELECT conv_id, i, s AS was, s AS state, 4 AS price, 'D' AS action, NULL AS line FROM faulty, unnest(['e', 's', 'u', 'a']) AS states(s)
            UNION ALL
            SELECT conv_id, i, was, state, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K', f.role || ':' || text
            FROM faulty AS f JOIN moves ON moves.role = f.role[1] WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate')
            UNION ALL
            SELECT conv_id, i, was, state, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R', CASE moves.role WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text
            FROM faulty, moves WHERE moves.role IN ('u', 'a') AND coalesce(fault, '') NOT IN ('blank', 'duplicate')),
        best AS (
            SELECT conv_id, 0::BIGINT AS i, 'e' AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS v FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT b.conv_id, d.i, d.state, min({'cost': b.v.cost + 3 * len(names) + price, 'audit': b.v.audit || repeat('I', len(names)) || action,
                                                 'lines': b.v.lines || names || CASE WHEN line IS NULL THEN [] ELSE [line] END})
            FROM best AS b JOIN filled ON filled.was = b.state
            JOIN edits AS d ON d.conv_id IS NOT DISTINCT FROM b.conv_id AND d.i = b.i + 1 AND d.was = filled.state
            GROUP BY b.conv_id, d.i, d.state),
        stats AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
        ends AS (
            SELECT b.conv_id, min({'cost': b.v.cost + 3 * len(names), 'audit': b.v.audit || repeat('I', len(names)), 'lines': b.v.lines || names}) AS v
            FROM best AS b JOIN filled ON filled.was = b.state AND filled.state IN ('e', 'a')
            LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i = coalesce(n, 0) GROUP BY b.conv_id)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, v.cost AS cost, v.audit AS audit, sha256(array_to_string(v.lines, chr(10))) AS repaired_sha256
        FROM ends AS e LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM e.conv_id
    """
