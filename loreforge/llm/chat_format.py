"""Chat formatting: conversations as marked-up texts with a loss flag on each segment, and back.

A :class:`Template` declares for each role what stands ahead of and behind a turn and whether its text counts for the loss,
and which role may follow which. :class:`Grammar` makes a finite-state machine of that: its states are the roles, it starts in
``START``, and a turn that no arc allows is a fault; it goes on from that turn's role, so one fault isn't told twice. Faulty
conversations are formatted like all others and carry the place of their first fault.

Control strings inside texts get a backslash behind their first character, one more if they had some already, so that each
text has just one escaped form and each escaped form one text; no template string can then be found in a text. A role that
the template doesn't name is written out between marks of its own, so that it can be read back.

Rows go to their conversation's task and are formatted in order as they stream by. Output rows hold whole turns, ``PIECE`` bytes
or a little more in each; conversations that fill more than one row are put in order again only to be read. So
a task never holds a conversation, whatever its length. A digest of one conversation's text runs from its first byte to its
last: that pass is one task's, by its nature.

Turns go by turn (null first), then role and text. Null texts and null roles count as empty, null ids are one conversation
named null. Rows that repeat are turns that repeat. An empty table gives an empty result; other columns are not
read, whatever their names.
"""

import hashlib
import itertools
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, slices

#: Bytes of formatted text after which an output row ends.
PIECE = 1 << 18
START = "^"


@dataclass(frozen=True)
class Turn:
    """Of one role: what stands ahead of its text and behind it, and whether the text counts for the loss."""

    ahead: str
    behind: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: at most one of them has nothing ahead of its text. other: marks ahead of any other role's name, between it and its text, and behind that.
    follows: (role, roles that may come next); the pseudo-role START is ahead of the first turn. ends: roles that may be the last."""

    begin: str
    roles: dict[str, Turn]
    other: tuple[str, str, str]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = {self.begin, *self.other, *(m for t in self.roles.values() for m in (t.ahead, t.behind))} - {""}
        object.__setattr__(self, "controls", tuple(sorted(marks)))
        for a in marks:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"a control string has two characters at least and no backslash: {a}")
            for b in marks:
                if (a != b and a in b) or any(a[i:] == b[: len(a) - i] for i in range(1, len(a)) if len(a) - i < len(b)):
                    raise ValueError(f"control strings overlap: {a} and {b}")
        if any(not t.behind for t in self.roles.values()) or sum(not t.ahead for t in self.roles.values()) > 1:
            raise ValueError("each turn needs an end, and all roles but one a beginning")


INSTRUCT = Template(
    begin="<s>",
    roles={"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("", "</s>", loss=True)},
    other=("[ROLE]", "[/ROLE]", "[/TURN]"),
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


class Grammar:
    """The state machine of a template's roles."""

    def __init__(self, template: Template):
        self.arcs = {(a, b) for a, after in template.follows.items() for b in after}
        self.ends = set(template.ends)

    def fault(self, state: str, role: str) -> bool:
        return (state, role) not in self.arcs


class Codec:
    """Escapes and unescapes texts, formats turns and reads them back. All in bytes, so that any text survives."""

    def __init__(self, template: Template):
        parts = [(re.escape(c[:1].encode()), re.escape(c[1:].encode())) for c in template.controls]
        self.inside = re.compile(b"|".join(b"(?<=" + first + rb")\\*(?=" + rest + b")" for first, rest in parts))
        self.marked = re.compile(b"|".join(b"(?<=" + first + rb")\\(?=\\*" + rest + b")" for first, rest in parts))
        self.turns = {role.encode(): (t.ahead.encode(), t.behind.encode(), t.loss) for role, t in template.roles.items()}
        self.other, self.begin = [m.encode() for m in template.other], template.begin.encode()

    def escape(self, text: bytes) -> bytes:
        return self.inside.sub(lambda m: m[0] + b"\\", text)

    def unescape(self, text: bytes) -> bytes:
        return self.marked.sub(b"", text)

    def segments(self, role: bytes, text: bytes) -> list[tuple[bytes, bool]]:
        """A turn's formatted parts, each with its loss flag."""
        text = self.escape(text)
        if role in self.turns:
            ahead, behind, loss = self.turns[role]
        else:
            ahead, behind, loss = self.other[0] + self.escape(role) + self.other[1], self.other[2], False
        return [(part, own) for part, own in ((ahead, False), (text, loss), (behind, False)) if part]

    def read(self, formatted: bytes):
        """role and text of each turn of formatted text that begins and ends with whole turns."""
        at = len(self.begin) if self.begin and formatted.startswith(self.begin) else 0
        plain = next((r for r, t in self.turns.items() if not t[0]), None)
        while at < len(formatted):
            if formatted.startswith(self.other[0], at):
                at += len(self.other[0])
                end = formatted.index(self.other[1], at)
                role, at, behind = self.unescape(formatted[at:end]), end + len(self.other[1]), self.other[2]
            else:
                role = next((r for r, t in self.turns.items() if t[0] and formatted.startswith(t[0], at)), plain)
                if role is None:
                    raise ValueError("no turn begins here")
                ahead, behind, _ = self.turns[role]
                at += len(ahead)
            end = formatted.index(behind, at)
            yield role, self.unescape(formatted[at:end])
            at = end + len(behind)


class Formatter:
    """Formats turns that come in the order of their conversations. Rows that are done wait to be taken."""

    def __init__(self, codec: Codec, grammar: Grammar, most: int):
        self.codec, self.grammar, self.most, self.done, self.weight, self.open = codec, grammar, most, [], 0, False

    def turn(self, conv, role: bytes, text: bytes) -> None:
        if not self.open or conv != self.conv:
            self.close()
            self.conv, self.open, self.state, self.n, self.fault = conv, True, START, 0, None
            self.piece, self.size, self.segments = 0, 0, [(self.codec.begin, False)] if self.codec.begin else []
        elif self.size >= self.most:
            self._row(False)
            self.piece, self.size, self.segments = self.piece + 1, 0, []
        name = role.decode("utf-8", "replace")
        if self.fault is None and self.grammar.fault(self.state, name):
            self.fault = self.n
        own = self.codec.segments(role, text)
        self.segments += own
        self.size, self.state, self.n = self.size + sum(len(s) for s, _ in own), name, self.n + 1

    def close(self) -> None:
        if self.open:
            if self.fault is None and self.state not in self.grammar.ends:
                self.fault = self.n
            self._row(True)
            self.open = False

    def _row(self, last: bool) -> None:
        self.done.append((self.conv, self.piece, last, self.fault if last else None, self.segments))
        self.weight += self.size + 64 * len(self.segments)

    def take(self) -> list:
        done, self.done, self.weight = self.done, [], 0
        return done


def in_order(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of one key in one task, in order."""
    return rows.repartition(key).sortWithinPartitions(key, *order)


_FORMATTED = "piece int, last boolean, first_fault long, segments array<struct<text:string,loss:boolean>>"


def format_conversations(conversations: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """<conv_col>, piece (from 0), last, first_fault, segments (text, loss): the formatted conversations in rows of whole turns, kept in the shared folder.

    first_fault, in the last row: the place (from 0) of the first turn that the grammar doesn't allow, the number of turns if the conversation may not end where it does, else null."""
    named = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = in_order(named, "conv", "turn", "role", "text").select("conv", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))
    kind, codec, grammar, most = rows.schema["conv"].dataType, Codec(template), Grammar(template), PIECE

    def each(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        part = pa.struct([("text", pa.string()), ("loss", pa.bool_())])
        schema = pa.schema([("conv", to_arrow_type(kind)), ("piece", pa.int32()), ("last", pa.bool_()), ("first_fault", pa.int64()), ("segments", pa.list_(part))])
        own = Formatter(codec, grammar, most)

        def made():
            done = own.take()
            flat = [s for r in done for s in r[4]]
            texts, flags = pa.array([s for s, _ in flat], pa.binary()).view(pa.string()), pa.array([f for _, f in flat], pa.bool_())
            ends = list(itertools.accumulate((len(r[4]) for r in done), initial=0))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([texts, flags], fields=list(part)))
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in done], schema.field(i).type) for i in range(4)), lists], schema=schema)

        for batch in slices(batches, 64):
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.turn(conv, role, text)
            if own.weight >= 4 * most:
                yield made()
        own.close()
        yield made()

    made = rows.mapInArrow(each, f"conv {kind.simpleString()}, {_FORMATTED}")
    return freeze(made.withColumnRenamed("conv", conv_col), "formatted")


def pieces_in_order(pieces: DataFrame, conv_col: str) -> tuple[DataFrame, DataFrame]:
    """Conversations that are one row, as they are, and the rows of all others, of one conversation in one task and in order."""
    alone = F.col("last") & (F.col("piece") == 0)
    return pieces.where(alone), in_order(pieces.where(~alone), conv_col, "piece")


def digest(formatted: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id") -> DataFrame:
    """<conv_col>, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, first_fault: read back from :func:`format_conversations`' rows."""
    kind, codec = formatted.schema[conv_col].dataType, Codec(template)
    schema = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, first_fault long"

    def each(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        chars = lambda b: len(b.decode("utf-8", "replace"))
        names, state = ["conv", *(c.split()[0] for c in schema.split(", "))], None
        for batch in slices(batches, 64):
            done = []
            for conv, last, fault, segments in zip(*(batch.column(c).to_pylist() for c in ("conv", "last", "first_fault", "segments")), strict=True):
                n, turns, n_loss, loss, n_chars = state or (0, hashlib.sha256(), 0, hashlib.sha256(), 0)
                parts = [s["text"].encode("utf-8", "surrogatepass") for s in segments]
                for part, s in zip(parts, segments, strict=True):
                    if s["loss"]:
                        own = codec.unescape(part)
                        loss.update(own)
                        n_loss += chars(own)
                whole = b"".join(parts)
                for role, text in codec.read(whole):
                    turns.update(role + b"\n" + text + b"\n")
                    n += 1
                state = (n, turns, n_loss, loss, n_chars + chars(whole))
                if last:
                    done.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), state[4], fault))
                    state = None
            types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)

    rows = formatted.select(F.col(conv_col).alias("conv"), "piece", "last", "first_fault", "segments")
    whole, long = (x.mapInArrow(each, f"conv {kind.simpleString()}, {schema}") for x in pieces_in_order(rows, "conv"))
    return whole.unionByName(long).withColumnRenamed("conv", conv_col)
