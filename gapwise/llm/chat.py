"""Chat formatting with a grammar round trip: what is rendered must parse back to its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before_each, column_or_null, let

OPEN, CLOSE, ESCAPED = "<|im_start|>", "<|im_end|>\n", "<|im_esc|>"
#: One turn: OPEN, role, ESCAPED if the texts are escaped, newline, text, CLOSE.
CLOSE_PATTERN = r"<\|im_end\|>\n"


def escape(text: Column) -> Column:
    r"""Puts a backslash before each backslash, before the bar of each "<|", and writes newlines as \n."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Undoes escape(): a backslash and what follows are read as one, from left to right."""
    pairs = F.split(text, r"\\\\", -1)  # an escaped backslash never takes part in another escape
    return F.array_join(F.transform(pairs, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))), "\\")


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        return F.concat(F.lit(OPEN), escape(role), F.lit(ESCAPED + "\n"), escape(text), F.lit(CLOSE))
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(rendered: Column) -> Column:
    """The turns of a rendered text as array<struct<role, text>>, by a grammar with one reading.

    A text is a sequence of turns, each ended by the first CLOSE. A turn is OPEN, a head up to the first newline,
    and a body; a head that ends in ESCAPED says that head and body are escaped. A piece that breaks the grammar
    gives a null turn, which equals no source turn.
    """
    pieces = F.split(rendered, CLOSE_PATTERN, -1)
    turns = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(OPEN) + 1))
        head = F.substring_index(inner, "\n", 1)
        body = F.substr(inner, F.length(head) + 2)
        is_escaped = F.endswith(head, F.lit(ESCAPED))
        bare = F.substr(head, F.lit(1), F.length(head) - len(ESCAPED))
        good = F.startswith(piece, F.lit(OPEN)) & F.contains(inner, F.lit("\n"))
        return F.when(
            good,
            F.struct(
                F.when(is_escaped, unescape(bare)).otherwise(head).alias("role"),
                F.when(is_escaped, unescape(body)).otherwise(body).alias("text"),
            ),
        )

    return F.transform(turns, turn)


def _is_turn(rendered: Column, role: Column, text: Column) -> Column:
    """Whether the rendered text parses to exactly this turn."""
    read = parse(rendered)
    return F.coalesce((F.size(read) == 1) & (F.get(read, F.lit(0))["role"] == role) & (F.get(read, F.lit(0))["text"] == text), F.lit(False))


def format_turns(turns: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Adds `formatted`, the rendered turn, to each row; turns need not be gathered to be rendered.

    Each turn is rendered as it is and parsed again. Where the parse isn't exactly this one turn, with the same
    role and text, it is rendered escaped and parsed again; a turn that still differs is an error. Since a rendered
    turn ends in the only CLOSE it holds, the concatenation of rendered turns parses to their sequence.

    Null role or text: empty. Long texts are read and written whole. Repeated rows: each is rendered. An existing
    column `formatted` is replaced. Empty table: no rows.
    """
    role = F.coalesce(column_or_null(turns, role_col, "string"), F.lit(""))
    text = F.coalesce(column_or_null(turns, text_col, "string"), F.lit(""))
    plain, escaped = render_turn(role, text, escaped=False), render_turn(role, text, escaped=True)
    # OPEN inside a turn can't mislead the parser, but a reader that knows only the marks would see a turn there
    marks = F.contains(text, F.lit("<|im_")) | F.contains(role, F.lit("<|im_"))
    failed = F.raise_error(F.concat(F.lit("no rendering of this turn parses back to it: "), F.substr(text, F.lit(1), F.lit(200)))).cast("string")
    return turns.withColumn("formatted", F.when(_is_turn(plain, role, text) & ~marks, plain).when(_is_turn(escaped, role, text), escaped).otherwise(failed))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Whole conversations: id, formatted, read (what the parser recovers, equal to the source), loss_spans.

    A conversation's turns are ordered by (turn, role, text), so ties and repeated rows have one order. The parse of
    the whole is compared with the source turns; a difference is an error. loss_spans are the places of the
    assistant's texts in `formatted`, as array<struct<start, end>> in code points, end exclusive.

    A conversation becomes one row, since its format is one string; format_turns() itself needs no grouping. Null
    ids form one conversation; null turns come first. Empty table: no rows. Other columns are ignored.
    """
    rows = format_turns(
        turns.select(
            column_or_null(turns, id_col, "long").alias("id"),
            column_or_null(turns, turn_col, "long").alias("turn"),
            F.coalesce(column_or_null(turns, role_col, "string"), F.lit("")).alias("role"),
            F.coalesce(column_or_null(turns, text_col, "string"), F.lit("")).alias("text"),
        )
    )
    whole = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "formatted"))).alias("turns"))
    whole = whole.select("id", "turns", F.array_join(F.col("turns.formatted"), "").alias("formatted"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    failed = F.raise_error(F.concat(F.lit("parsed turns differ from their source in conversation "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    read = let(parse(F.col("formatted")), lambda r: F.when(r == source, r).otherwise(failed))
    ends = before_each(F.transform("turns", lambda t: F.length(t["formatted"])))

    def place(t: Column, k: Column, at: Column) -> Column:
        """The text stands between the first newline and CLOSE."""
        head = F.length(F.substring_index(t["formatted"], "\n", 1)) + 1
        return F.struct(t["role"].alias("role"), (F.get(at, k) + head).alias("start"), (F.get(at, k + 1) - len(CLOSE)).alias("end"))

    places = let(ends, lambda at: F.transform("turns", lambda t, k: place(t, k, at)))
    spans = F.transform(F.filter(places, lambda p: p["role"] == "assistant"), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return whole.select(F.col("id").alias(id_col), "formatted", read.alias("read"), spans.alias("loss_spans"))


def conversation_digests(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Digests of what format_conversations() reads back: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The loss mask covers each text whose role is "assistant", once and in order.
    """
    back = format_conversations(turns, id_col, turn_col, role_col, text_col)
    spoken = F.array_join(F.transform(F.filter("read", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        id_col,
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(spoken).cast("long").alias("loss_chars"),
        F.sha2(spoken.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
