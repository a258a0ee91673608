"""Chat formatting: a state machine over roles and a declarative template."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class RoleFormat:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """What stands before and after the texts of each role, and which role may follow which.

    A role that is not listed is written as ``other``, with its name between
    ``name_marks``. ``moves`` maps (state, role) to the next state; a
    conversation is valid if every turn has a move and it ends in ``final``.
    """

    roles: dict[str, RoleFormat]
    other: RoleFormat
    name_marks: tuple[str, str]
    moves: dict[tuple[str, str], str]
    start: str = "start"
    final: frozenset = field(default_factory=frozenset)

    def control_strings(self) -> list[str]:
        formats = [*self.roles.values(), self.other]
        return sorted({s.strip() for f in formats for s in (f.before, f.after)} | set(self.name_marks))

    def first_characters(self) -> str:
        return "".join(sorted({s[0] for s in self.control_strings()}))


INSTRUCTION_TEMPLATE = ChatTemplate(
    roles={
        "system": RoleFormat("<<SYS>>", "<</SYS>>\n"),
        "user": RoleFormat("<s>[INST]", "[/INST]"),
        "assistant": RoleFormat("[ANSWER]", "</s>\n", loss=True),
    },
    other=RoleFormat("[ROLE]", "</s>\n"),
    name_marks=("[NAME]", "[/NAME]"),
    moves={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    final=frozenset({"assistant"}),
)


def character_class(template: ChatTemplate) -> str:
    return "([" + "".join("\\" + c for c in template.first_characters()) + "])"


def escaped(text: Column, template: ChatTemplate) -> Column:
    """Every character that can begin a control string is followed by a backslash, which breaks it."""
    return F.regexp_replace(text, character_class(template), "$1\\\\")


def unescaped(text: Column, template: ChatTemplate) -> Column:
    return F.regexp_replace(text, character_class(template) + r"\\", "$1")


def segments_of(turn: Column, template: ChatTemplate) -> Column:
    """Text segments of a turn, each with its loss flag; the text is a segment of its own."""

    def pieces(before: Column, after: str, loss: bool) -> Column:
        def piece(text: Column, flag: bool) -> Column:
            return F.struct(text.alias("text"), F.lit(flag).alias("loss"))

        return F.array(piece(before, False), piece(escaped(turn["text"], template), loss), piece(F.lit(after), False))

    opened, closed = template.name_marks
    named = F.concat(F.lit(template.other.before + opened), escaped(turn["role"], template), F.lit(closed))
    result = pieces(named, template.other.after, template.other.loss)
    for role, form in template.roles.items():
        result = F.when(turn["role"] == role, pieces(F.lit(form.before), form.after, form.loss)).otherwise(result)
    return result


def walked(turns: Column, template: ChatTemplate) -> Column:
    """The end of the walk: state and the number of the first turn without a move (null: none)."""
    moves = F.create_map(*(F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)))
    states = sorted(set(template.moves.values()))

    def step(at: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(at["state"], F.lit("\n"), turn["role"]))
        known = F.when(turn["role"].isin(states), turn["role"]).otherwise(at["state"])
        return F.struct(
            F.coalesce(to, known).alias("state"),
            (at["n"] + 1).alias("n"),
            F.coalesce(at["bad"], F.when(to.isNull(), at["n"])).alias("bad"),
        )

    start = F.struct(
        F.lit(template.start).alias("state"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("bad")
    )
    return F.aggregate(turns, start, step)


def format_chats(
    df: DataFrame,
    template: ChatTemplate = INSTRUCTION_TEMPLATE,
    conversation: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: its segments with loss flags, the formatted text, the verdict on its turns.

    Turns go by ``order``, ties by role and text, null first; repeated rows are
    turns of their own. A null role or text is empty. A null conversation key is
    a conversation. Turns out of order are formatted all the same; ``valid`` is
    false then and ``first_bad`` the number of the first (from 0; null if only
    the end is wrong). Other columns are not looked at; no rows give no rows.
    A conversation is one output row, so its turns meet in one task.
    """
    turn = F.struct(
        F.col(order).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    gathered = df.groupBy(F.col(conversation).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    walk = walked(F.col("turns"), template)
    parts = gathered.select(
        "conv_id",
        walk.alias("walk"),
        F.flatten(F.transform("turns", lambda t: segments_of(t, template))).alias("segments"),
    )
    return parts.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("walk.bad").isNull() & F.col("walk.state").isin(sorted(template.final))).alias("valid"),
        F.col("walk.bad").alias("first_bad"),
    )


def quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c.isascii() and c != "\n" else c for c in text)


def read_turns(formatted: Column, template: ChatTemplate = INSTRUCTION_TEMPLATE) -> Column:
    """The turns (role, text) of a formatted text, found by the marks of the template alone."""
    opened, closed = template.name_marks
    other = template.other
    forms = [f"{quoted(f.before)}.*?{quoted(f.after)}" for f in template.roles.values()]
    forms.append(f"{quoted(other.before + opened)}.*?{quoted(closed)}.*?{quoted(other.after)}")
    found = F.regexp_extract_all(formatted, F.lit(f"(?s){'|'.join(forms)}"), F.lit(0))

    def inside(turn: Column, before: Column, after: str) -> Column:
        return unescaped(turn.substr(before + 1, F.length(turn) - before - len(after)), template)

    def read(turn: Column) -> Column:
        head = F.instr(turn, closed) + len(closed) - 1
        name = turn.substr(F.lit(len(other.before + opened) + 1), head - len(other.before + opened + closed))
        result = F.struct(unescaped(name, template).alias("role"), inside(turn, head, other.after).alias("text"))
        for role, form in template.roles.items():
            known = F.struct(
                F.lit(role).alias("role"), inside(turn, F.lit(len(form.before)), form.after).alias("text")
            )
            result = F.when(turn.startswith(form.before), known).otherwise(result)
        return result

    return F.transform(found, read)


def read_loss(segments: Column, template: ChatTemplate = INSTRUCTION_TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, in order."""
    counted = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(counted, lambda s: unescaped(s["text"], template)), "")
