"""Conversation structure repair: the cheapest edits that make roles go system?, (user, assistant)+, for all conversations at once.

Each row has a letter: what its role begins with (s, u, a or something else) and whether it must go (blank or seen before) or is
cut short. A conversation's letters are its signature, and that alone decides its edits. Distinct signatures are dealt by
ranges of their letters read from the end and gone through in that order. Signatures with a common end then stand together, and
the automaton of all of them, minimised from the end, is built as they come: a node stands for what is left of a
conversation, and those with the same rest share it. Of each node and each state of the grammar the cost to go, the best next
edit and what it leads to are worked out once; the edits that follow are the shared node's own, so the best audit is
a path through the nodes. Only the nodes of the current signature are held. A range's first signature repeats
its neighbour's last nodes; all others are built once for all conversations.

A node's edits in one state all have different letters, so of equal costs the edit whose letter is least in ASCII wins (D, I, K,
R), which makes the whole audit the least. A role put in or renamed follows from the state, so an audit says all.

Rows go to their conversation's task and are packed in order as they stream by, ``PIECE`` bytes or a little more in a row,
so that no task holds a conversation's texts. A signature and an audit have one letter a row of a conversation and
are one value each. The repaired text's digest runs from a conversation's first row to its last: that pass is one task's, by its nature.

Null roles and texts count as one space. Rows go by turn (nulls first), then role and text. Null ids are one
conversation named null. Rows that repeat are duplicates. An empty table gives an empty result; other columns are not
read, whatever their names.
"""

import hashlib
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chat_format import in_order, pieces_in_order
from .common import WORD, freeze, slices

#: Bytes of texts after which a packed row ends.
PIECE = 1 << 18
#: What an edit costs, and what a row that is cut short adds if it stays.
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States of the grammar: nothing so far, after the system's, the user's and the assistant's turn. Which role each one waits for, and the state after it.
_WAITS, _AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Of one node by state: the cost to go above the least state's, and the letter of the best next edit. At the end of a conversation nothing may
#: stand or an assistant's turn be the last.
Node = tuple[tuple[int, ...], tuple[str, ...]]
END: Node = ((0, INSERT * 2, INSERT, 0), ("", "I", "I", ""))


def kept(letter: str, state: int) -> int | None:
    """The state after a row of that letter stays as it is, None if it may not."""
    role = letter.lower()
    if role == "s":
        return 1 if state == 0 else None
    return _AFTER[state] if role == _WAITS[state][0] else None


@lru_cache(4096)
def node(letter: str, rest: Node) -> Node:
    """The node ahead of rest. letter: D for a row that must go, else s, u, a or x for its role, a capital if it is cut short.

    Costs are counted from the least one on, so few nodes differ, and the same letter ahead of the same node is worked out once."""
    costs, goes = rest[0], []
    for state in range(4):
        options = [(DELETE + costs[state], "D")]
        if letter != "D":
            more, stays = CUT * letter.isupper(), kept(letter, state)
            options.append((more + RENAME + costs[_AFTER[state]], "R"))
            if stays is not None:
                options.append((more + costs[stays], "K"))
        goes.append(min(options))
    # turns put in ahead of the row: one or two, as a third would come back to a state that was there before
    put = lambda ahead: [min(own, (INSERT + ahead[_AFTER[s]][0], "I")) for s, own in enumerate(goes)]
    best = put(put(goes))
    least = min(cost for cost, _ in best)
    return tuple(cost - least for cost, _ in best), tuple(edit for _, edit in best)


class Automaton:
    """The nodes of one signature, from its end; those that it shares with the next one stay."""

    def __init__(self):
        self.back, self.nodes, self.built = "", [END], 0

    def turn_to(self, back: str) -> None:
        """back: a signature read from its end."""
        same = len(os.path.commonprefix([self.back, back]))
        del self.nodes[same + 1 :]
        for letter in back[same:]:
            self.nodes.append(node(letter, self.nodes[-1]))
        self.built += len(back) - same
        self.back = back

    def audit(self) -> tuple[int, str]:
        """The least cost and the edits, along the best edits of the nodes."""
        edits, cost, state, at = [], 0, 0, len(self.back)
        while edit := self.nodes[at][1][state]:
            edits.append(edit)
            if edit == "I":
                cost, state = cost + INSERT, _AFTER[state]
                continue
            letter, at = self.back[at - 1], at - 1
            if edit == "D":
                cost += DELETE
            else:
                cost += CUT * letter.isupper() + RENAME * (edit == "R")
                state = _AFTER[state] if edit == "R" else kept(letter, state)
        return cost, "".join(edits)


def edited(audit: str, rows, state: int = 0):
    """edit, role, text (none of a deleted row) and the state then, of each edit in order. rows: role, text in bytes."""
    rows = iter(rows)
    for edit in audit:
        if edit == "I":
            role, text = _WAITS[state].encode(), b""
        else:
            role, text = next(rows)
            if edit == "D":
                yield edit, None, None, state
                continue
        if edit == "K":
            state = kept(role[:1].decode("latin-1"), state)
        else:
            role, state = _WAITS[state].encode(), _AFTER[state]
        yield edit, role, text, state


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """<conv_col>, <turn_col>, <role_col>, <text_col> with planted faults. By crc32 of "id:turn" mod 20: 0 drops the row, 1 empties its text,
    2 takes all of .!? out of it, 3 repeats the row, 4 makes its role the user's. A null of any column counts as one space, but the turn stays null."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col))) % 20
    rows = conversations.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), spaced(role_col).alias("r"), spaced(text_col).alias("x"), kind.alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("x", "[.!?]", "")).otherwise(F.col("x"))
    rows = rows.select("c", "t", F.when(F.col("k") == 4, "user").otherwise(F.col("r")).alias("r"), text.alias("x"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))))
    return rows.select(F.col("c").alias(conv_col), F.col("t").alias(turn_col), F.col("r").alias(role_col), F.col("x").alias(text_col))


def _lettered(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, fault (b, d, t or empty), letter: in order, the rows of a conversation in one task."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"))
    again = F.row_number().over(Window.partitionBy("conv", "role", "digest").orderBy("turn")) > 1
    rows = rows.repartition("conv").withColumn("digest", F.sha2("text", 256)).withColumn("again", again)  # both windows use the one exchange
    blank, cut = ~F.col("text").rlike(WORD), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "b").when(F.col("again"), "d").when(cut, "t").otherwise("")
    first = F.substring("role", 1, 1)
    letter = F.when(F.col("fault").isin("b", "d"), "D").otherwise(F.when(F.col("fault") == "t", F.upper("first")).otherwise(F.col("first")))
    rows = rows.withColumn("fault", fault).withColumn("first", F.when(first.isin("s", "u", "a"), first).otherwise("x"))
    rows = rows.select("conv", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "fault", letter.alias("letter"), "first")
    return rows.sortWithinPartitions("conv", "turn", "role", "text")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


class Packer:
    """Packs the rows of conversations that come in order. The counts so far are in each row, those of the whole conversation in its last."""

    def __init__(self, most: int):
        self.most, self.done, self.weight, self.open = most, [], 0, False

    def row(self, conv, turn, role: bytes, text: bytes, fault: str, letter: str, first: str) -> None:
        if not self.open or conv != self.conv:
            self.close()
            self.conv, self.open, self.piece, self.ahead = conv, True, 0, ""
            self.counts, self.low, self.turn, self.distinct = dict.fromkeys("bdt!", 0), None, None, 0
            self._new()
        elif self.size >= self.most:
            self._end(False)
            self.piece += 1
            self._new()
        if turn is not None and turn != self.turn:
            self.low, self.turn, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        if fault:
            self.counts[fault] += 1
        self.counts["!"] += bool(self.ahead) and self.ahead + first not in ("su", "ua", "au")
        self.ahead = first
        self.letters.append(letter)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(role) + len(text)

    def _new(self) -> None:
        self.letters, self.roles, self.texts, self.size = [], [], [], 0

    def _end(self, last: bool) -> None:
        gaps = self.turn - self.low + 1 - self.distinct if self.distinct else 0
        self.done.append((self.conv, self.piece, last, "".join(self.letters), self.roles, self.texts, gaps, *self.counts.values()))
        self.weight += self.size + 64 * len(self.letters)

    def close(self) -> None:
        if self.open:
            self._end(True)
            self.open = False

    def take(self) -> list:
        done, self.done, self.weight = self.done, [], 0
        return done


def pack(conversations: DataFrame, *columns: str) -> DataFrame:
    """conv, piece (from 0), last, letters, roles, texts, counts: kept in the shared folder."""
    rows, most = _lettered(conversations, *columns), PIECE
    kind = rows.schema["conv"].dataType

    def each(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        own, types = Packer(most), [to_arrow_type(kind), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.binary()), *[pa.int64()] * len(_COUNTS)]

        def made():
            done = own.take()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=["conv", "piece", "last", "letters", "roles", "texts", *_COUNTS])

        for batch in slices(batches, 64):
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.row(*r)
            if own.weight >= 4 * most:
                yield made()
        own.close()
        yield made()

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return freeze(rows.mapInArrow(each, f"conv {kind.simpleString()}, piece int, last boolean, letters string, roles array<binary>, texts array<binary>, {counts}"), "packed")


def audits(signatures: DataFrame) -> DataFrame:
    """letters, cost, audit of each distinct signature."""
    distinct = signatures.groupBy("letters").agg(F.reverse("letters").alias("back"))

    def each(batches):
        own = Automaton()
        for batch in slices(batches):
            found = []
            for letters, back in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.turn_to(back)
                found.append((letters, *own.audit()))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["letters", "cost", "audit"])

    return distinct.repartitionByRange("back").sortWithinPartitions("back").select("letters", "back").mapInArrow(each, "letters string, cost long, audit string")


class Repair:
    """The repair of all conversations: :meth:`report` has a row for each, :meth:`turns` the repaired turns."""

    def __init__(self, conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        self.conv_col = conv_col
        self.packed = pack(conversations, conv_col, turn_col, role_col, text_col)
        self.kind = self.packed.schema["conv"].dataType
        alone, long = pieces_in_order(self.packed, "conv")
        parts = F.sort_array(F.collect_list(F.struct("piece", "letters")))
        long_signs = freeze(long.select("conv", "piece", "letters").groupBy("conv").agg(F.array_join(F.transform(parts, lambda p: p["letters"]), "").alias("letters")), "signatures")
        of = freeze(audits(alone.select("letters").union(long_signs.select("letters"))), "audits")
        self.whole = alone.join(of, "letters")
        # of a conversation in many rows the first one gets the audit
        first = long_signs.join(of, "letters").select(F.col("conv").alias("own"), F.lit(0).alias("at"), "cost", "audit")
        rows = long.join(first, F.col("conv").eqNullSafe(F.col("own")) & (F.col("piece") == F.col("at")), "left").select(*self.packed.columns, "cost", "audit")
        self.long = in_order(rows, "conv", "piece")

    def _each(self, make, schema: str) -> DataFrame:
        columns = ["conv", "last", "roles", "texts", "cost", "audit", *_COUNTS]
        out = [rows.select(*columns).mapInArrow(make, schema) for rows in (self.whole, self.long)]
        return out[0].unionByName(out[1]).withColumnRenamed("conv", self.conv_col)

    def report(self) -> DataFrame:
        """<conv_col>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        kind = self.kind

        def each(batches):
            from pyspark.sql.pandas.types import to_arrow_type

            types = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]
            for done in _streamed(batches, _Digest):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=["conv", *_COUNTS, "cost", "audit", "repaired_sha256"])

        counts = ", ".join(f"{c} long" for c in _COUNTS)
        return self._each(each, f"conv {kind.simpleString()}, {counts}, cost long, audit string, repaired_sha256 string")

    def turns(self) -> DataFrame:
        """<conv_col>, place (from 0), edit, role, text: the repaired conversations."""
        kind = self.kind

        def each(batches):
            from pyspark.sql.pandas.types import to_arrow_type

            types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.binary(), pa.binary()]
            for done in _streamed(batches, _Turns):
                columns = [pa.array([r[i] for r in done], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*columns[:3], *(c.view(pa.string()) for c in columns[3:])], names=["conv", "place", "edit", "role", "text"])

        return self._each(each, f"conv {kind.simpleString()}, place long, edit string, role string, text string")


class _Digest:
    """Of one conversation, whose rows come piece by piece: its row of the report."""

    def __init__(self, conv, cost: int, audit: str):
        self.conv, self.cost, self.audit, self.sha, self.begun = conv, cost, audit, hashlib.sha256(), False

    def take(self, edit, role, text) -> list:
        if role is not None:
            self.sha.update(b"\n" * self.begun + role + b":" + text)
            self.begun = True
        return []

    def close(self, counts: tuple) -> list:
        return [(self.conv, *counts, self.cost, self.audit, self.sha.hexdigest())]


class _Turns:
    def __init__(self, conv, cost: int, audit: str):
        self.conv, self.place = conv, 0

    def take(self, edit, role, text) -> list:
        if role is None:
            return []
        self.place += 1
        return [(self.conv, self.place - 1, edit, role, text)]

    def close(self, counts: tuple) -> list:
        return []


def _streamed(batches, kind, most: int = 2048):
    """Lists of what kind's objects make of each conversation's edits."""
    done, own = [], None
    for batch in slices(batches, 64):
        columns = ("conv", "last", "roles", "texts", "cost", "audit", *_COUNTS)
        for conv, last, roles, texts, cost, audit, *counts in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if own is None:
                own, letters, at, state = kind(conv, cost, audit), audit, 0, 0
            end, n = at, len(roles)
            while end < len(letters) and (n or letters[end] == "I"):  # with the turns that are put in behind the piece's last row
                n -= letters[end] != "I"
                end += 1
            for edit, role, text, state in edited(letters[at:end], zip(roles, texts, strict=True), state):  # noqa: B020
                done += own.take(edit, role, text)
            at = end
            if last:
                done += own.close(tuple(counts))
                own = None
            if len(done) >= most:
                yield done
                done = []
    yield done
