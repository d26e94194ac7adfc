"""Chat formatting: turns with typed content parts become marked text, and are read back from it.

A message has an ordered list of parts: text, image, audio, document. A visitor per type turns a part
into text: texts are escaped, attachments become a placeholder that is repeated once per token they
expand to. Attachment references, token counts and offsets are kept beside the text.

    ### user:\\n ... </turn>\\n

Control strings can't occur in texts or roles: the backslash, '#', '<' and '|' are written as
backslash and a letter, and back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongbox.llm.tables import Rows, arrow_schema, partitions

OPEN, AFTER_ROLE, CLOSE = "### ", ":\n", "</turn>\n"
#: The backslash first: it marks the others.
ESCAPES = {"\\": "\\b", "#": "\\h", "<": "\\l", "|": "\\p"}
ROLE_ESCAPES = ESCAPES | {":": "\\c", "\n": "\\n", "\r": "\\r"}

PART = "type string, text string, ref string, width int, height int, seconds double, pages int"


def escaped(text: Column, escapes: dict[str, str] = ESCAPES) -> Column:
    for plain, code in escapes.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: str, escapes: dict[str, str] = ROLE_ESCAPES) -> str:
    if "\\" not in text:
        return text
    back = {code[1]: plain for plain, code in escapes.items()}
    first, *rest = text.split("\\")
    return first + "".join(back[x[0]] + x[1:] for x in rest)


def image_tokens(part: Column, tile: int = 448, per_tile: int = 256) -> Column:
    """One token block per tile that the image touches; an image of unknown size counts as one tile."""
    tiles = [F.greatest(F.lit(1), F.ceil(F.coalesce(part[side], F.lit(1)) / tile)) for side in ("width", "height")]
    return (tiles[0] * tiles[1] * per_tile).cast("int")


def audio_tokens(part: Column, per_second: int = 25) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * per_second)).cast("int")


def document_tokens(part: Column, per_page: int = 512) -> Column:
    return (F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(1))) * per_page).cast("int")


#: Tokens that an attachment of each type expands to.
ATTACHMENTS: dict[str, Callable[[Column], Column]] = {
    "image": image_tokens, "audio": audio_tokens, "document": document_tokens,
}


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit("<|"), kind, F.lit("|>"))


def visit(part: Column) -> Column:
    """A part as struct(kind, ref, tokens, piece). A part of no known type, or null, is an empty text."""
    kind = F.when(part["type"].isin(*ATTACHMENTS), part["type"]).otherwise(F.lit("text"))
    tokens = F.lit(0)
    for name, of in ATTACHMENTS.items():
        tokens = F.when(part["type"] == name, of(part)).otherwise(tokens)
    plain = F.when(part["type"] == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(F.lit(""))
    piece = F.when(kind == "text", plain).otherwise(F.repeat(placeholder(kind), tokens))
    return F.struct(kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"), piece.alias("piece"))


def text_part(text: Column) -> Column:
    """One part of type text, for messages that are plain texts."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))


def format_chat(messages: DataFrame, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formats messages (conv_id, turn, role, parts array<PART>), each on its own.

    Returns conv_id, turn, role, formatted, body_start and body_length (code points of what lies
    between the marks), in_loss (whether that is learnt from), attachments (kind, ref, tokens, the
    code point in ``formatted`` where the placeholders start) and expanded_tokens. Null roles and
    texts count as empty, null or empty lists of parts as an empty text. Further columns are left out.
    """
    visited = F.transform(F.coalesce(F.col("parts"), F.array().cast(f"array<struct<{_typed(PART)}>>")), visit)
    role = F.coalesce(F.col("role"), F.lit(""))
    one = messages.select(
        F.col("conv_id"), F.col("turn"), role.alias("role"),
        F.concat(F.lit(OPEN), escaped(role, ROLE_ESCAPES), F.lit(AFTER_ROLE)).alias("head"), visited.alias("visited"),
    )
    one = one.withColumn("body", F.array_join(F.col("visited.piece"), ""))
    attachments = F.aggregate(
        F.col("visited"),
        F.struct(F.array().cast("array<struct<kind:string,ref:string,tokens:int,start:int>>").alias("found"), F.length("head").alias("at")),
        lambda done, p: F.struct(
            F.when(p["kind"] == "text", done["found"])
            .otherwise(F.concat(done["found"], F.array(F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), done["at"].alias("start")))))
            .alias("found"),
            (done["at"] + F.length(p["piece"])).alias("at"),
        ),
        lambda done: done["found"],
    )
    return one.select(
        "conv_id", "turn", "role", F.concat("head", "body", F.lit(CLOSE)).alias("formatted"),
        F.length("head").alias("body_start"), F.length("body").alias("body_length"),
        F.col("role").isin(*learnt).alias("in_loss"), attachments.alias("attachments"),
        F.aggregate(F.col("visited.tokens"), F.lit(0), lambda a, b: a + b).alias("expanded_tokens"),
    )


def _typed(columns: str) -> str:
    return ", ".join(":".join(c.split()) for c in columns.split(", "))


READ = arrow_schema(
    conv_id=pa.int64(), n_turns=pa.int64(), turns_sha256=pa.string(), loss_chars=pa.int64(), loss_sha256=pa.string(),
    formatted_chars=pa.int64(),
)


class _Reading:
    """What has been read of one conversation: running digests, no texts."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str, body_start: int, body_length: int, in_loss: bool) -> None:
        self.chars += len(formatted)
        if not formatted.startswith(OPEN) or not formatted.endswith(CLOSE):
            raise ValueError(f"conversation {self.conv_id}: a turn without its marks")
        role, _, body = formatted[len(OPEN) : -len(CLOSE)].partition(AFTER_ROLE)
        self.turns += 1
        self.all.update(f"{unescaped(role)}\n{unescaped(body)}\n".encode())
        if in_loss:
            learnt = unescaped(formatted[body_start : body_start + body_length])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_chat(formatted: DataFrame) -> DataFrame:
    """Reads formatted turns back: per conversation its turns, what the loss sees, and digests of both.

    Turns are read in the order of turn, those of the same turn by their text. A conversation is read
    in one pass with running digests, however long it is; nothing of it is kept in memory. Rows
    without conv_id are one conversation. No rows give no rows.
    """
    wanted = ["conv_id", "formatted", "body_start", "body_length", "in_loss"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = Rows(READ), None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).to_pydict()
                for conv_id, *turn in zip(*(part[c] for c in wanted), strict=True):
                    if now is None or now.conv_id != conv_id:
                        if now is not None:
                            out.add(*now.row())
                            if out.full():
                                yield from out.take()
                        now = _Reading(conv_id)
                    now.read(*turn)
        if now is not None:
            out.add(*now.row())
        yield from out.take()

    ordered = (
        formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *wanted[1:])
        .repartition(partitions(formatted.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "formatted")
    )
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select(*wanted).mapInArrow(read, schema)


def conversations_to_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages of one text part."""
    return conversations.select("conv_id", "turn", "role", F.array(text_part(F.col("text"))).alias("parts"))


#: The same in SQL, for conversations of plain texts and one more: digests of the turns, and lengths with
#: a character more for each that is escaped.
CHAT_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
sized as (
  select *, length(text) + length(text) - length(translate(text, '\#<|', '')) as body,
    length(role) + length(role) - length(translate(role, '\#<|:' || chr(10) || chr(13), '')) as head from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### ') + head + length(':') + 1 + body + length('</turn>') + 1) as bigint) as formatted_chars
from sized group by conv_id
"""
