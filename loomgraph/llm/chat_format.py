"""Conversations as marked-up training texts with a loss mask, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._shared import delete, materialise, same_text

#: Marks of the template; NEXT stands between the texts of merged turns.
OPEN, CLOSE, NEXT = "<|im_start|>", "<|im_end|>\n", "<|im_next|>"
#: Turns that one fold takes, as a fold copies its list of pieces at every step.
CHUNK = 64
#: Conversations of more turns or bytes are put together from parts; how, not what, it decides.
LONG_TURNS, LONG_BYTES = 4096, 32 << 20


def escape(text: Column) -> Column:
    """One backslash more between ``<`` and ``|``, so that ``<|`` starts marks of the template alone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """The text before ``escape``."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


#: A chunk of sorted turns folded: texts and marks in order, its bytes, and the bytes under the loss mask.
#: What opens the chunk's first turn and closes its last is left to the chunks beside it.
FOLD = f"""
transform(sequence(0, (size(turns) - 1) div {CHUNK}), k -> transform(array(aggregate(
  slice(turns, k * {CHUNK} + 1, {CHUNK}),
  named_struct('last', cast(null AS string), 'pieces', cast(array() AS array<string>), 'bytes', 0L,
    'loss', cast(array() AS array<struct<start: bigint, bytes: bigint>>)),
  (s, t) -> transform(array(if(s.last IS NULL, '', if(s.last = t.role, '{NEXT}', concat({{close}}, '{OPEN}', t.role, '\\n')))),
    mark -> named_struct('last', t.role, 'pieces', concat(s.pieces, array(mark, t.text)),
      'bytes', s.bytes + octet_length(mark) + octet_length(t.text),
      'loss', if(t.role = '{{trained}}', array_append(s.loss, named_struct('start', s.bytes + octet_length(mark), 'bytes', cast(octet_length(t.text) AS bigint))), s.loss)))[0])),
  s -> named_struct('first', turns[k * {CHUNK}].role, 'last', s.last, 'body', array_join(s.pieces, ''), 'bytes', s.bytes, 'loss', s.loss))[0])
"""


def _chunks(trained: str) -> Column:
    return F.expr(FOLD.format(close="'" + CLOSE.replace("\n", "\\n") + "'", trained=trained))


def _assembled(folded: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of (conv_id, chunks), the chunks in order."""
    close = "'" + CLOSE.replace("\n", "\\n") + "'"
    marked = folded.withColumn(
        "marks",
        F.expr(f"transform(chunks, (c, k) -> if(k > 0 AND c.first = chunks[k - 1].last, '{NEXT}', concat(if(k > 0, {close}, ''), '{OPEN}', c.first, '\\n')))"),
    ).withColumn(
        "starts",
        F.expr("aggregate(sequence(0, size(chunks) - 1), named_struct('at', 0L, 'starts', cast(array() AS array<bigint>)), (s, k) -> named_struct('at', s.at + octet_length(marks[k]) + chunks[k].bytes, 'starts', array_append(s.starts, s.at + octet_length(marks[k])))).starts"),
    )
    return marked.select(
        "conv_id",
        F.expr(f"concat(array_join(transform(chunks, (c, k) -> concat(marks[k], c.body)), ''), {close})").alias("formatted"),
        F.expr("flatten(transform(chunks, (c, k) -> transform(c.loss, x -> named_struct('start', x.start + starts[k], 'bytes', x.bytes))))").alias("loss"),
    )


def format_chats(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    r"""(conv_id, formatted, loss) per conversation of ``conversations`` (conv_id, turn, role, text).

    Turns are sorted by number, then role, then text; neighbours of one role
    become one turn of the template, with a mark between their texts:
    ``<|im_start|>user\nfirst<|im_next|>second<|im_end|>\n``.  In texts a
    backslash goes between ``<`` and ``|`` (one more where there are some), and
    roles are URL-encoded, so ``read_back`` gives every turn as it was.  ``loss``
    lists (start, bytes): places of the texts of role ``trained`` in the UTF-8
    bytes of ``formatted``, marks left out.

    A null text or role is empty; null conv_ids are one conversation; null turn
    numbers come first; repeated rows are turns of their own; other columns are
    ignored; an empty table gives none.  A conversation is one row of the result,
    so its text must stay under Spark's 2 GB a value.  Most conversations are
    sorted and folded in one group.  Those of over ``LONG_TURNS`` turns or
    ``LONG_BYTES`` bytes are cut into ranges of turns, folded by range, and only
    the folded parts meet.
    """
    spark = conversations.sparkSession
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.url_encode(same_text("role")).alias("role"),
        escape(same_text("text")).alias("text"),
    )
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    long = materialise(sizes.where((F.col("turns") > LONG_TURNS) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv_id").alias("long_id")), "long-conversations")
    turn = F.struct("turn", "role", "text")
    whole = lambda rows, *by: rows.groupBy("conv_id", *by).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    if long.isEmpty():
        delete(spark, long._written_to)
        return _assembled(whole(turns).select("conv_id", _chunks(trained).alias("chunks")))
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = whole(turns.join(long, is_long, "left_anti")).select("conv_id", _chunks(trained).alias("chunks"))
    ranged = turns.join(long, is_long, "left_semi").repartitionByRange("conv_id", "turn", "role", "text").withColumn("part", F.spark_partition_id())
    parts = whole(ranged, "part").select("conv_id", "part", _chunks(trained).alias("chunks"))
    met = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "chunks"))).alias("parts"))
    return _assembled(short.unionByName(met.select("conv_id", F.flatten("parts.chunks").alias("chunks"))))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars) of a table of ``format_chats``.

    ``turns`` is an array of (role, text), merged ones taken apart; ``loss_texts``
    are the texts under the loss mask in order; both unescaped.
    """
    blocks = F.expr(r"""transform(filter(split(formatted, '<\\|im_end\\|>\n', -1), b -> b <> ''), b -> split(b, '\n', 2))""")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(b[1], r"<\|im_next\|>", -1),
                lambda t: F.struct(F.url_decode(F.substr(b[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    raw = formatted.withColumn("raw", F.col("formatted").cast("binary"))
    text = lambda x: unescape(F.substring(F.col("raw"), (x["start"] + 1).cast("int"), x["bytes"].cast("int")).cast("string"))
    return raw.select("conv_id", turns.alias("turns"), F.transform("loss", text).alias("loss_texts"), F.char_length("formatted").cast("long").alias("formatted_chars"))
